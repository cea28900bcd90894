"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal components is learned on a bounded sample so that signs lose as little as possible; a vector's signs
are its code, 64 bits at most. The code is cut into four parts, each a table. Two codes that differ in at most 11 bits agree but
for two bits on one part, so if each is posted under its part and under the part with any one bit flipped, they meet. A pair counts in one
bucket only: that of the first part that is close enough, at a key that both codes determine. Candidates are compared by the cosine of the
original vectors. Small buckets give candidate pairs (a bounded number a vector); in large ones, cut into pairs of sub-blocks, vectors
are compared in place, and only counts of links and a spanning forest come out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import (
    checkpointed,
    components,
    hot_keys,
    least_member,
    local_components,
    lookup,
    runs,
    whole_runs,
)
from riskframe.llm.vectors import commonest_size, matrix, some, vectors

PARTS = 4
NEAR_BITS = 16  # codes further apart are not compared
SMALL, SUB_BLOCK = 256, 2048


def learn_rotation(x: np.ndarray, bits: int = 64, steps: int = 40, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (width, bits) of unit vectors: principal components, turned towards balanced signs."""
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    axes = axes[:, ::-1][:, :min(bits, x.shape[1])]
    v = (x - mean) @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))
    for _ in range(steps):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, axes @ turn


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Signs of the rotated unit vectors as 64-bit words."""
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    bits = np.zeros((len(x), 64), np.uint8)
    bits[:, :projection.shape[1]] = (unit - mean) @ projection >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def met_here(a: np.ndarray, b: np.ndarray, bucket: np.ndarray, width: int) -> np.ndarray:
    """Whether ``bucket`` (part << width | key) is the one where the pair of codes counts."""
    ok, open_ = np.zeros(len(a), bool), np.ones(len(a), bool)
    mask = np.uint64((1 << width) - 1)
    part, key = bucket >> np.uint64(width), bucket & mask
    for t in range(PARTS):
        pa_, pb = (a >> np.uint64(width * t)) & mask, (b >> np.uint64(width * t)) & mask
        gap = pa_ ^ pb
        apart = np.bitwise_count(gap)
        low = gap & (~gap + np.uint64(1))
        one_flip = np.minimum(pa_ ^ low, pb ^ low)  # two bits apart: a code between them
        want = np.where(apart <= 1, np.minimum(pa_, pb), one_flip)
        near = open_ & (apart <= 2)
        ok |= near & (part == t) & (key == want)
        open_ &= ~near
    return ok


def candidate_pairs(bucket: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of a bucket that count there, for rows sorted by bucket."""
    starts, ends = runs(bucket)
    left = np.repeat(ends, ends - starts) - np.arange(len(bucket))
    at, d, out_i, out_j = np.flatnonzero(left > 1), 1, [], []
    while len(at):
        near = at[np.bitwise_count(code[at] ^ code[at + d]) <= NEAR_BITS]
        near = near[met_here(code[near], code[near + d], bucket[near], width)]
        out_i.append(near)
        out_j.append(near + d)
        d += 1
        at = at[left[at] > d]
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.empty(0, np.int64),) * 2


def _classes(points: DataFrame, width: int) -> DataFrame:
    """(c, k, n, least_id, v) for every different vector."""
    key = F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)
    rows = points.where(F.size("v") == width).select("vec_id", "v", key.alias("k"))
    found = rows.groupBy("k", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
    return checkpointed(found.select(F.monotonically_increasing_id().alias("c"), "k", "n", "least_id", "v"))


def links(classes: DataFrame, width: int, least_cosine: float, most: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(c, n_links) and edges (a, b): vectors that a class links to, copies counted, and pairs that connect all linked classes.

    ``most``: about how many vectors the rotation is learned on, chosen by a hash.
    """
    spark = classes.sparkSession
    chosen = some(classes, "k", most, classes.count()).select("k", "v").collect()
    x = np.array([r.v for r in sorted(chosen, key=lambda r: r.k)])
    mean, projection = learn_rotation(x / np.sqrt((x * x).sum(axis=1))[:, None])
    part = -(-projection.shape[1] // PARTS)

    def encode(batches):
        for batch in batches:
            code = codes(matrix(batch.column(1), width), mean, projection)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.view(np.int64)), batch.column(2)], names=["c", "code", "n"])

    coded = checkpointed(classes.select("c", "v", "n").mapInArrow(encode, "c long, code long, n long"))
    keys = []
    for t in range(PARTS):
        own = F.shiftrightunsigned("code", part * t).bitwiseAND(F.lit((1 << part) - 1))
        keys += [own.bitwiseOR(F.lit(t << part))] + [own.bitwiseXOR(F.lit(1 << b)).bitwiseOR(F.lit(t << part)) for b in range(part)]
    posted = coded.select("c", "code", "n", F.explode(F.array(*keys)).alias("bucket"))
    large = checkpointed(posted.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > SMALL))

    def pairs(batches):
        for group in whole_runs(batches, 0):
            bucket, code, c = (group.column(k).to_numpy() for k in range(3))
            i, j = candidate_pairs(bucket.view(np.uint64), code.view(np.uint64), part)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(c[i]), pa.array(c[j])], names=["a", "b"])

    some_large = not large.isEmpty()
    small = posted.join(large, "bucket", "left_anti") if some_large else posted
    found = small.select("bucket", "code", "c").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pairs, "a long, b long")
    side = lambda name: classes.select(F.col("c").alias(name), F.col("n").alias(f"{name}_n"), F.col("v").alias(f"{name}_v"))
    found = found.join(side("a"), "a").join(side("b"), "b")

    def check(batches):
        for batch in batches:
            va, vb = matrix(batch.column(2), width), matrix(batch.column(3), width)
            cos = (va * vb).sum(axis=1) / (np.sqrt((va * va).sum(axis=1)) * np.sqrt((vb * vb).sum(axis=1)))
            keep = pa.array(cos >= least_cosine)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1, 4, 5)], names=["a", "b", "a_n", "b_n"])

    near = found.select("a", "b", "a_v", "b_v", "a_n", "b_n").mapInArrow(check, "a long, b long, a_n long, b_n long")
    near = checkpointed(near)
    counts = near.select(F.col("a").alias("c"), F.col("b_n").alias("n")).unionAll(near.select(F.col("b").alias("c"), F.col("a_n").alias("n")))
    edges = near.select("a", "b")
    if some_large:
        inside = _inside_large(posted, large, classes, width, part, least_cosine)
        counts = counts.unionAll(inside.where("n > 0").select("c", "n"))
        edges = edges.unionAll(inside.where("a != c").select("a", F.col("c").alias("b")))
    return counts.groupBy("c").agg(F.sum("n").alias("n_links")), edges


def _inside_large(posted: DataFrame, large: DataFrame, classes: DataFrame, width: int, part: int, least_cosine: float) -> DataFrame:
    """(a, c, n) for rows of large buckets: the least class that c is connected to in its cell, and the vectors it links to there."""
    parts = F.ceil(F.col("rows") / SUB_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("c"), parts).cast("int")
    split = (posted.join(large, "bucket").select("bucket", "code", "c", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
             .select("bucket", "code", "c", "n", F.col("own").cast("long").alias("own"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
             .withColumn("cell", F.xxhash64("bucket", "lo", "hi")))
    rows = split.join(classes.select("c", "v"), "c").select("cell", "bucket", "lo", "hi", "own", "code", "c", "n", "v")

    def work(batches):
        for group in whole_runs(batches, 0):
            cell = [group.column(k).to_numpy() for k in range(8)]
            x = matrix(group.column(8), width)
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            _, bucket, lo, hi, own, code, c, n = cell
            # cells are told apart by what they were made of, should hashes be equal
            order = np.lexsort((c, hi, lo, bucket))
            new = np.any(np.diff(np.stack([bucket, lo, hi])[:, order], axis=1) != 0, axis=0)
            for rows_ in np.split(order, np.flatnonzero(new) + 1):
                side = own[rows_]
                left, right = (rows_, rows_) if lo[rows_[0]] == hi[rows_[0]] else (rows_[side == lo[rows_[0]]], rows_[side == hi[rows_[0]]])
                spot = np.full(len(order), -1)
                spot[rows_] = np.arange(len(rows_))
                linked, lab = np.zeros(len(rows_), np.int64), np.arange(len(rows_))
                for a in range(0, len(left), 512):
                    la = left[a:a + 512]
                    gap = np.bitwise_count(code[la].view(np.uint64)[:, None] ^ code[right].view(np.uint64)[None, :])
                    i, j = np.nonzero(gap <= NEAR_BITS)
                    i, j = la[i], right[j]
                    if left is right:
                        i, j = i[i != j], j[i != j]
                        once = c[i] < c[j]
                        i, j = i[once], j[once]
                    met = met_here(code[i].view(np.uint64), code[j].view(np.uint64), bucket[i].view(np.uint64), part)
                    i, j = i[met], j[met]
                    cos = np.concatenate([(x[i[k:k + 65_536]] * x[j[k:k + 65_536]]).sum(axis=1) for k in range(0, len(i), 65_536)]) if len(i) else np.empty(0)
                    i, j = spot[i[cos >= least_cosine]], spot[j[cos >= least_cosine]]
                    np.add.at(linked, i, n[rows_][j])
                    np.add.at(linked, j, n[rows_][i])
                    lab = local_components(len(rows_), i, j, lab)
                some = np.flatnonzero((linked > 0) | (lab != np.arange(len(rows_))))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(c[rows_][lab[some]]), pa.array(c[rows_][some]), pa.array(linked[some])], names=["a", "c", "n"])

    return checkpointed(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(work, "a long, c long, n long"))


def groups(rows: DataFrame, least_cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: vectors linked directly, the least id reachable, and whether it is that.

    Null, zero and non-finite vectors, and those of another than the commonest length, link with nothing: no links, their own
    component, kept. Equal vectors link with each other. Null ids are kept and name a component only if it has no other;
    repeated rows are kept. Links below 12 differing code bits are never missed; above that a pair is missed if every part of
    its codes differs in three bits or more.
    """
    points = vectors(rows, id_col, vector_col)
    width = commonest_size(points)
    alone = F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    if not width:
        return points.select("vec_id", *alone, F.lit(True).alias("kept"))
    classes = _classes(points, width)
    counted, edges = links(classes, width, least_cosine)
    linked = components(edges)
    least = least_member(linked, classes.select(F.col("c").alias("node"), "least_id"), "least_id").select(F.col("node").alias("c"), "least")
    found = classes.select("c", "k", "n", "least_id").join(counted, "c", "left").join(least, "c", "left")
    found = checkpointed(found.select("k", "n", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "least_id").alias("component_id")))
    key = F.when(F.size("v") == width, F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    named = points.select("vec_id", key.alias("k"))
    total = classes.agg(F.sum("n").alias("n")).first().n
    out = lookup(named.where("k is not null"), found.select("k", "n_links", "component_id"), "k", hot_keys(found, "k", "n", total))
    out = out.select("vec_id", "n_links", "component_id").unionAll(named.where("k is null").select("vec_id", *alone))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
