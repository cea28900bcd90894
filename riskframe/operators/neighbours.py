"""Exact nearest neighbours among minority rows, and synthetic minority rows made from them.

Rows are grouped around pivots (Voronoi cells) and cells are cut into blocks of bounded
size. A first pass finds an upper bound of each row's neighbour distance inside its own
block; only cells that can hold something closer are looked at in the second pass: by the
triangle inequality with the cell's pivot, its nearest and its farthest row, and by the plane
half way between two pivots. In few dimensions that leaves a small share of the cells; with
many and no structure it cannot exclude any, and the work is that of all pairs. Copies of one vector are compared once. Distances are rounded to
nine decimals, and equal distances are ordered by the key.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import hash_unit, key_hash
from riskframe.operators.sampling import chosen, class_counts, hash_cutoffs
from riskframe.sources.lineage import checkpointed

# the functions below travel with their tasks, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 2048
DIGITS = 9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two small blocks, without cancellation."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _reachable(v: np.ndarray, pivots: np.ndarray, counts: np.ndarray, radius: np.ndarray, hole: np.ndarray, k: int,
               slack: float) -> np.ndarray:
    """Which cells may hold one of the k nearest others of each row; the rows of v are of one block."""
    to_pivot = _distances(v, pivots)
    roomy = counts > k
    limit = ((to_pivot + radius)[:, roomy].min(axis=1) if roomy.any() else np.full(len(v), np.inf))
    if len(v) > k:
        limit = np.minimum(limit, np.partition(_distances(v, v), k, axis=1)[:, k])
    least = np.maximum(np.maximum(to_pivot - radius, hole - to_pivot), (to_pivot - to_pivot.min(axis=1)[:, None]) / 2)
    return (least <= limit[:, None] + slack) & (counts > 0)


def nearest_neighbours(df: DataFrame, key: str, cols: Sequence[str], k: int = 5, block: int = BLOCK) -> DataFrame:
    """(key, vector, neighbours): the k nearest other rows as (distance, key, vector), nearest first."""
    points = df.select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    return vector_neighbours(points, k, block)


def vector_neighbours(points: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """As nearest_neighbours, for rows (key, v) with a vector as array<double>."""
    spark = points.sparkSession
    kind = points.schema["key"].dataType.simpleString()
    # of all copies of a vector only the first k + 1 keys can be anybody's neighbours
    first = Window.partitionBy("v").orderBy("key")
    copies = points.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    reps = checkpointed(copies.groupBy("v").agg(F.sort_array(F.collect_list("key")).alias("keys"))
                        .withColumn("rep", F.element_at("keys", 1)))
    n = reps.count()
    if n <= block:  # everything fits one block
        whole = reps.withColumns({c: F.lit(0) for c in GROUP})
        return _finish(points, reps, _nearest_in_blocks(whole, whole, k, kind), k)
    n_pivots = max(1, int(math.sqrt(n)))  # so many cells of so many rows
    pivots = np.array([r["v"] for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(n_pivots).select("v").collect()])

    def place(batches):
        for pdf in batches:
            d = _distances(_matrix(pdf["v"]), pivots)
            cell = d.argmin(axis=1) if len(pdf) else np.zeros(0, int)
            yield pdf.assign(cell=cell.astype("int32"), reach=d[np.arange(len(pdf)), cell])

    placed = reps.mapInPandas(place, f"v array<double>, keys array<{kind}>, rep {kind}, cell int, reach double")
    stats = {r["cell"]: (r["n"], r["radius"], r["hole"]) for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius"), F.min("reach").alias("hole")).collect()}
    counts, radius, hole = (np.array([stats.get(c, (0, 0.0, 0.0))[i] for c in range(len(pivots))]) for i in range(3))
    blocks = np.maximum(1, -(-counts // block))
    sizes = spark.createDataFrame([(c, int(b)) for c, b in enumerate(blocks)], "cell int, n_blocks int")
    data = placed.join(F.broadcast(sizes), "cell").withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    slack = 1e-8 + 1e-9 * float(radius.max(initial=0.0))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        near = _reachable(_matrix(pdf["v"]), pivots, counts, radius, hole, k, slack)
        return pd.DataFrame({"rep": pdf["rep"], "v": pdf["v"], "cells": [np.flatnonzero(r).tolist() for r in near]})

    asked = checkpointed(data.groupBy("cell", "block").applyInPandas(
        bound, f"rep {kind}, v array<double>, cells array<int>").select("rep", "v", F.explode("cells").alias("cell")))
    load = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    chunks = spark.createDataFrame([(c, int(b), max(1, -(-load.get(c, 0) // block))) for c, b in enumerate(blocks)],
                                   "cell int, n_blocks int, n_chunks int")
    queries = asked.join(F.broadcast(chunks), "cell").select(
        "rep", "v", "cell", F.pmod(F.xxhash64("rep"), F.col("n_chunks")).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"))
    sides = data.join(F.broadcast(chunks.select("cell", "n_chunks")), "cell").select(
        "keys", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))

    return _finish(points, reps, _nearest_in_blocks(queries, sides, k, kind), k)


GROUP = ["cell", "block", "chunk"]


def _nearest_in_blocks(queries: DataFrame, sides: DataFrame, k: int, kind: str) -> DataFrame:
    """(rep, distance, key, v): the k + 1 nearest of each query within each block it was sent to."""

    def best(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(ask) and len(have):
            vectors = have["have_v"].to_numpy()
            keys = [list(x) for x in have["have_keys"]]
            d = np.round(_distances(_matrix(ask["v"]), _matrix(have["have_v"])), DIGITS)
            take = min(k + 1, len(have))
            edge = np.partition(d, take - 1, axis=1)[:, take - 1]
            for i, rep in enumerate(ask["rep"]):
                found = sorted((d[i, j], key, j) for j in np.flatnonzero(d[i] <= edge[i]) for key in keys[j])[:k + 1]
                rows.extend((rep, dist, key, vectors[j]) for dist, key, j in found)
        return pd.DataFrame(rows, columns=["rep", "distance", "key", "v"])

    ask = queries.select("rep", "v", *GROUP)
    # new names keep the two sides apart where they come from one table
    have = sides.select(*[F.col(c).alias(f"have_{c}") for c in ("keys", "v", *GROUP)])
    return ask.groupBy(*GROUP).cogroup(have.groupBy(*[f"have_{c}" for c in GROUP])).applyInPandas(
        best, f"rep {kind}, distance double, key {kind}, v array<double>")


def _finish(points: DataFrame, reps: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Merge the blocks' answers and hand them to every copy of the vector."""
    order = Window.partitionBy("rep").orderBy("distance", "key")
    top = (found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
           .groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("distance", "key", "v"))).alias("near")))
    by_vector = reps.select("v", "rep").join(top, "rep").select("v", "near")
    others = F.slice(F.filter("near", lambda e: e["key"] != F.col("key")), 1, k)
    return points.join(by_vector, "v").select("key", F.col("v").alias("vector"), others.alias("neighbours"))


def smote(df: DataFrame, key: str, label: str, cols: Sequence[str], k: int = 5, seed: int = 42,
          minority=None, block: int = BLOCK) -> DataFrame:
    """(key, copy, cols, label): all rows (copy 0) and synthetic minority rows up to class balance.

    A synthetic row lies at a random place between a minority row and one of its k nearest
    minority neighbours; both choices follow from the hash of (key, copy).
    """
    counts = class_counts(df, label)
    if minority is None:
        minority = min(counts, key=lambda c: (counts[c], str(c)))
    few, most = counts[minority], max(counts.values())
    if few < k + 1:
        raise ValueError(f"{few} minority rows are too few for {k} neighbours")
    small = df.where(F.col(label) == F.lit(minority))
    each, rest = divmod(most - few, few)
    more = chosen([key], seed, hash_cutoffs(small, [key], seed, {None: rest})).cast("int")
    near = nearest_neighbours(small, key, cols, k, block).withColumnRenamed("key", key)
    copies = near.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(each) + more))).where("copy > 0")
    h = key_hash(seed, [key, "copy"])
    pick = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")
    made = copies.select(key, "copy", "vector", F.element_at("neighbours", pick + 1)["v"].alias("_n"),
                         hash_unit(h, 9).alias("_u"))
    values = [(F.col("vector")[i] + F.col("_u") * (F.col("_n")[i] - F.col("vector")[i])).alias(c)
              for i, c in enumerate(cols)]
    label_type = df.schema[label].dataType
    synthetic = made.select(key, "copy", *values, F.lit(minority).cast(label_type).alias(label))
    real = df.select(key, F.lit(0).alias("copy"), *[F.col(c).cast("double").alias(c) for c in cols], label)
    return real.unionByName(synthetic)
