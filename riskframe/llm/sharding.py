"""A uniform shuffle into shards of exact sizes, planned by a hypergeometric communication matrix.

How many rows go from each input partition to each destination follows a multivariate hypergeometric law, so that every
arrangement is equally likely and every destination gets exactly its size. The matrix is never built: the rows of a range of
partitions are split between its halves by one draw, and a task walks down that tree to its own row. The task deals
its rows to the destinations by a local permutation, rows are exchanged, and each destination is permuted again. A
destination is a block of a shard, small enough for one task, and a shard's blocks are numbered through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.stored import stored

BLOCK_ROWS = 16_384
LIBRARY_MOST = 900_000_000  # population up to which numpy draws


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items without replacement are good, for populations of any size."""
    if good + bad <= LIBRARY_MOST:
        return int(rng.hypergeometric(good, bad, drawn))
    # inversion over the part of the law that holds all but a vanishing share of it
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    mid = drawn * good / total
    width = 12 * math.sqrt(max(1.0, mid * (bad / total) * ((total - drawn) / max(1, total - 1)))) + 10
    low, high = max(low, int(mid - width)), min(high, int(mid + width))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    law = np.concatenate([[0.0], np.cumsum(steps)])
    law = np.cumsum(np.exp(law - law.max()))
    return low + int(np.searchsorted(law, rng.random() * law[-1], side="right"))


def draw(rng: np.random.Generator, counts: np.ndarray, drawn: int) -> np.ndarray:
    """A multivariate hypergeometric draw: how many of ``drawn`` items come from each class."""
    if int(counts.sum()) <= LIBRARY_MOST:
        return rng.multivariate_hypergeometric(counts, drawn, method="marginals")
    out, rest = np.zeros_like(counts), int(counts.sum())
    for k, n in enumerate(counts.tolist()):
        if not drawn:
            break
        rest -= n
        out[k] = hypergeometric(rng, n, rest, drawn) if rest else drawn
        drawn -= int(out[k])
    return out


def matrix_row(seed: int, sizes: np.ndarray, capacities: np.ndarray, partition: int) -> np.ndarray:
    """One partition's row of the communication matrix: its rows for each destination."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    low, high, mine = 0, len(sizes), capacities
    while high - low > 1:
        mid = (low + high) // 2
        left = draw(np.random.default_rng([seed, low, high]), mine, int(ends[mid] - ends[low]))
        low, high, mine = (low, mid, left) if partition < mid else (mid, high, mine - left)
    return mine


def block_sizes(rows: int, shards: int, block_rows: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of every block; sizes of shards, and of a shard's blocks, are at most one apart."""
    out = []
    for shard in range(shards):
        size = rows // shards + (shard < rows % shards)
        blocks = -(-size // block_rows)
        at = 0
        for b in range(blocks):
            n = size // blocks + (b < size % blocks)
            out.append((shard, at, n))
            at += n
    return out


def shuffle(rows: DataFrame, shards: int = 8, seed: int = 11, block_rows: int = BLOCK_ROWS, stable: bool = False) -> DataFrame:
    """(shard, slot, row): every row of ``rows``, as a struct, at a uniformly random place.

    Shards hold floor or ceiling of rows / shards; slots run from 0 without gaps. Nulls, repeated rows and any column names are
    carried along as they are; an empty table gives no rows. The input must give the same partitions each time it is
    computed: it is written to the shared folder first unless ``stable`` says that it is a plain scan of files.
    """
    rows = rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("row")) if len(set(rows.columns)) == len(rows.columns) else rows
    if not stable:
        rows = stored(rows, "shards")
    spark = rows.sparkSession
    counted = rows.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()  # one row a partition
    sizes = np.zeros(max([x.p for x in counted], default=-1) + 1, np.int64)
    for x in counted:
        sizes[x.p] = x.n
    blocks = block_sizes(int(sizes.sum()), shards, block_rows)
    capacities = np.array([n for _, _, n in blocks], np.int64)
    shared = spark.sparkContext.broadcast((sizes, capacities))
    names = [f.name for f in rows.schema]

    def work(batches):
        all_sizes, room = shared.value
        p = TaskContext.get().partitionId()
        left, rng = None, np.random.default_rng([seed, p, -1 & 0xFFFF])
        for batch in batches:
            if left is None:
                left = matrix_row(seed, all_sizes, room, p) if p < len(all_sizes) else np.zeros(len(room), np.int64)
            n = batch.num_rows
            if int(left.sum()) < n:
                raise ValueError("the input gave other partitions than when it was counted")
            mine = draw(rng, left, n)
            left = left - mine
            to = rng.permutation(np.repeat(np.arange(len(mine), dtype=np.int32), mine))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.int32()), pa.array(rng.integers(0, 2**62, n), pa.int64())],
                                             names=[*names, "_to", "_order"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.mapInArrow(work, f"{fields}, _to int, _order long")
    at = Window.partitionBy("_to").orderBy("_order", F.xxhash64("row"))
    plan = spark.createDataFrame([(k, s, a) for k, (s, a, _) in enumerate(blocks)], "_to int, shard int, _first long")
    # a task a block, however many there are
    placed = dealt.repartition(max(1, len(blocks)), "_to").withColumn("_place", F.row_number().over(at) - 1)
    return placed.join(F.broadcast(plan), "_to").select("shard", (F.col("_first") + F.col("_place")).alias("slot"), "row")
