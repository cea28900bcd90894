"""What the operators share: reading columns, caches in workers, joins with hot keys, connected components."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions import skew
from riskframe.functions.skew import HOT_SHARE, lookup  # noqa: F401  (the operators take them from here)
from riskframe.sources.lineage import checkpointed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) and nothing else, so that no further column can clash; a null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, so that tasks of one worker share what they load."""
    module = sys.modules.setdefault("_riskframe_llm_cache", types.ModuleType("_riskframe_llm_cache"))
    return module.__dict__.setdefault("items", {})


def slices(batch: pa.RecordBatch, column: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``limit`` bytes of the text column (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    which = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(which)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
        yield batch.slice(a, b - a)


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame | None:
    """Of one row a key, those with more than total / HOT_SHARE rows; None if there are none."""
    return skew.hot_keys(counts, key, F.col(n) > max(total / HOT_SHARE, 1000))


def _order(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), c.alias("v"))


FEW = 200_000  # edges that one task connects


def _connected(batches):
    """(node, root) of a few edges, in one task."""
    both = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not both:
        return
    a, b = (np.concatenate([x[k] for x in both]) for k in (0, 1))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    lab = local_components(len(names), at[:len(a)], at[len(a):])
    for k in range(0, len(names), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(names[k:k + 65_536].tolist()), pa.array(names[lab[k:k + 65_536]].tolist())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): equal roots mean connected.

    Contraction: every node hooks onto the smallest of its neighbours and itself, in an order given by a hash; edges
    are carried over to the hooks and loops fall away, so a constant share of the nodes goes in each round. Once no more than
    FEW edges are left, one task connects them. The rounds' hooks are composed afterwards. Self loops and null ends are ignored; no edges give no rows.
    """
    now = checkpointed(edges.select("a", "b").where("a != b").distinct())
    levels: list[DataFrame] = []
    while total := now.count():
        if total <= FEW:
            kind = now.schema["a"].dataType.simpleString()
            levels.append(checkpointed(now.coalesce(1).mapInArrow(_connected, f"node {kind}, root {kind}")))
            break
        ends = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.min(_order(F.col("b"))).alias("m"), F.count("*").alias("n"))
        hooks = checkpointed(least.select(
            F.col("a").alias("node"), F.when(_order(F.col("a")) < F.col("m"), F.col("a")).otherwise(F.col("m.v")).alias("root"), "n"))
        levels.append(hooks.select("node", "root"))
        hot = hot_keys(hooks, "node", "n", total)
        for end in ("a", "b"):
            to = hooks.select(F.col("node").alias(end), F.col("root").alias("to"))
            now = lookup(now, to, end, None if hot is None else hot.withColumnRenamed("node", end)).drop(end).withColumnRenamed("to", end)
        now = checkpointed(now.select("a", "b").where("a != b").distinct())
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    found = levels.pop()
    while levels:
        sizes = levels[-1].groupBy("root").agg(F.count("*").alias("n"))
        hot = hot_keys(sizes, "root", "n", levels[-1].count())
        up = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
        found = lookup(levels.pop(), up, "root", hot).select("node", F.coalesce("to", "root").alias("root"))
    return checkpointed(found)


def least_member(components_of: DataFrame, members: DataFrame, value: str) -> DataFrame:
    """(node, least): the least ``value`` over the node's component; members has (node, value)."""
    least = components_of.join(members, "node").groupBy("root").agg(F.min(value).alias("least"))
    sizes = components_of.groupBy("root").agg(F.count("*").alias("n"))
    hot = hot_keys(sizes, "root", "n", components_of.count())
    return lookup(components_of, least, "root", hot).select("node", "least")


def local_components(n: int, i: np.ndarray, j: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Least connected index of each of n items; labels: what earlier links gave."""
    lab = np.arange(n) if labels is None else labels
    while len(i):
        a, b = lab[i], lab[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(lab, a, low)
        np.minimum.at(lab, b, low)
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
    return lab


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])


def whole_runs(batches, column: int = 0):
    """Regroup batches sorted by a column, so that no run of equal values is cut between two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column)
        last = pa.compute.equal(key, key[batch.num_rows - 1]).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(last))
        if cut == 0 and held and held[-1].column(column)[0].as_py() == key[0].as_py():
            held.append(batch)
            continue
        head = [*held, batch.slice(0, cut)] if cut else held
        if head:
            yield pa.Table.from_batches(head).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
