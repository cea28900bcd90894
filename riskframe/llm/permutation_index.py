"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order. An index block posts its vectors in one inverted file a pivot
with the pivot's place in their order. A query adds up, over the files of its own nearest pivots, what each shared pivot takes off the
footrule distance (places beyond the prefix count as the prefix's length); the share of the block with the least
distance is ranked again by the cosine of the original vectors. Every block sees every query block, so all rows are searched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import checkpointed, whole_runs
from riskframe.llm.vectors import commonest_size, cosines, matrix, some, vectors

PIVOTS, PREFIX, SHARE, LEAST = 256, 64, 0.12, 1024
BLOCK, QUERY_BLOCK = 16_384, 2_048


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row by cosine, in order."""
    similarity = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ pivots.T
    first = np.argpartition(-similarity, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.tile(np.arange(len(pivots)), (len(x), 1))
    order = np.argsort(-np.take_along_axis(similarity, first, 1), axis=1, kind="stable")
    return np.take_along_axis(first, order, 1)


class Block:
    """The inverted files of one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, prefix: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.pivots, self.prefix = ids[order], x[order], pivots, prefix
        near = nearest_pivots(self.x, pivots, prefix)
        flat = near.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.row, self.place = by_pivot // prefix, (by_pivot % prefix).astype(np.int32)
        self.start = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def footrule(self, near: np.ndarray) -> np.ndarray:
        """How much the pivots shared with a query take off the largest footrule distance, for each vector."""
        saved = np.zeros(len(self.ids))
        for place, p in enumerate(near.tolist()):
            a, b = self.start[p], self.start[p + 1]
            saved[self.row[a:b]] += 2 * (self.prefix - np.maximum(self.place[a:b], place))
        return saved

    def search(self, query: int, q: np.ndarray, near: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest found; of equal distances and cosines the smaller id comes first."""
        budget = max(least, int(np.ceil(share * len(self.ids)))) + 1
        order = np.argsort(-self.footrule(near), kind="stable")[:budget]
        order = np.sort(order[self.ids[order] != query])
        score = cosines(self.x[order], q)
        best = np.lexsort((self.ids[order], -score))[:k]
        return self.ids[order][best], score[best]


def spread(x: np.ndarray, count: int, alike: float = 0.8) -> np.ndarray:
    """Up to ``count`` of the unit vectors, in order, none of which has a cosine above ``alike`` with one before it.

    Pivots from one group of near copies would all stand at one place in every order. If too few are left, others fill up.
    """
    kept: list[int] = []
    near = np.full(len(x), -1.0)
    for k in range(len(x)):
        if len(kept) < count and near[k] <= alike:
            kept.append(k)
            near = np.maximum(near, x @ x[k])
    rest = [k for k in np.unique(np.round(x, 6), axis=0, return_index=True)[1].tolist() if k not in set(kept)]
    return x[kept + sorted(rest)[:count - len(kept)]]


def choose_pivots(rows: DataFrame, count: int, n: int) -> np.ndarray:
    """Up to ``count`` directions, spread out, among about 4 x count of the n vectors, chosen by a hash of the id."""
    found = sorted(some(rows, "vec_id", 4 * count, n).select("vec_id", "v").collect(), key=lambda r: r.vec_id)
    x = np.array([r.v for r in found])
    x = x[np.random.default_rng(1).permutation(len(x))]
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return spread(x, count)


def search(rows: DataFrame, every: int = 50, k: int = 5, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST,
           block: int = BLOCK, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every vector whose id ``every`` divides, by cosine.

    Candidates are all rows with another id. Null, zero and non-finite vectors, null ids and vectors of another than the commonest
    length take no part; a repeated id stands for its least vector. ``share`` of each block is compared exactly (``least``
    rows at least); a larger share or prefix raises recall. Empty tables give no rows.
    """
    points = vectors(rows, id_col, vector_col)
    width = commonest_size(points)
    points = checkpointed(points.where(F.col("vec_id").isNotNull() & (F.size("v") == width)).groupBy("vec_id").agg(F.min("v").alias("v")))
    schema = "query_id long, vec_id long, score double"
    n = points.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = points.where(F.col("vec_id") % every == 0)
    blocks, query_blocks = -(-n // block), max(1, -(-queries.count() // query_block))
    near_to = choose_pivots(points, pivots, n)
    shared = rows.sparkSession.sparkContext.broadcast(near_to)  # pivots x width doubles
    size = min(prefix, len(near_to))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    query_place = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(query_blocks)).cast("int")
    every_block = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = points.select(place.alias("b"), every_block(query_blocks).alias("q"), F.lit(False).alias("query"), "vec_id", "v")
    asked = queries.select(every_block(blocks).alias("b"), query_place.alias("q"), F.lit(True).alias("query"), "vec_id", "v")
    both = index.unionAll(asked).select((F.col("b").cast("long") * query_blocks + F.col("q")).alias("cell"), "query", "vec_id", "v")

    def work(batches):
        for group in whole_runs(batches, 0):
            for cell in pa.compute.unique(group.column(0)).to_pylist():
                here = group.filter(pa.compute.equal(group.column(0), cell))
                asks = here.column(1).to_numpy()
                ids, x = here.column(2).to_numpy(), matrix(here.column(3), width)
                if asks.all() or not asks.any():
                    continue
                found = Block(ids[~asks], x[~asks], shared.value, size)
                wanted, q = ids[asks], x[asks]
                out = [found.search(int(i), v, near, k, share, least) for i, v, near in zip(wanted, q, nearest_pivots(q, shared.value, size), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(wanted, [len(i) for i, _ in out])), pa.array(np.concatenate([i for i, _ in out])),
                                                  pa.array(np.concatenate([s for _, s in out]))], names=["query_id", "vec_id", "score"])

    found = both.repartition(blocks * query_blocks, "cell").sortWithinPartitions("cell").mapInArrow(work, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
