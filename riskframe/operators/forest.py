"""Forests of unlimited depth: the top of a tree on the cluster, the rest of it in tasks.

Rows are packed once into blocks of numpy columns. While a node holds more rows than a task should, its sums by (feature, bin) are added up
over the cluster and only its split reaches the driver. Once all nodes are small, every node's sampled rows travel to one task, which grows the
subtree to its end on the values themselves. A subtree is one row of a table, so no tree is part of a task's code.

A split sends values up to its threshold left. Missing values count as smaller than all others. A node ends when its labels are equal, its rows
cannot be told apart, or the settings end it; a split need not lower the impurity. A row's weight in a tree is drawn from its hash and the tree's
number, so a tree is the same wherever its rows lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from riskframe.sources.lineage import checkpointed

PASS_BYTES = 128 << 20  # sums that a task holds at once; more nodes take more passes
BROADCAST_BYTES = 128 << 20  # a larger forest is joined with the rows instead
BLOCK_ROWS = 1 << 20  # rows whose equal features a task takes together at once
SLACK = 1e-10
KNOWN_ROWS = 1 << 18  # different features whose values a scoring task remembers
MOST_CLASSES = 100
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])  # a row's copies in a sample of n out of n rows

SUBTREE = ("tree long, node long, nodes long, feature binary, threshold binary, left binary, right binary, value binary, rows binary, weight binary, "
           "importance array<double>")


@dataclass(frozen=True)
class Settings:
    """``max_features``: None (the root of their number for classes, all for numbers), "sqrt", "log2", "all", a share or a number."""

    task: str = "regression"
    n_estimators: int = 100
    max_depth: int | None = None
    min_samples_leaf: int = 1
    min_samples_split: int = 2
    max_features: str | float | int | None = None
    bootstrap: bool = True
    max_bins: int = 255  # of the tops of trees; subtrees look at every value
    subtree_rows: int = 250_000  # a node with fewer rows is grown by one task
    seed: int = 42

    def __post_init__(self):
        if self.task not in ("classification", "regression"):
            raise ValueError(f"unknown task {self.task!r}")
        if min(self.n_estimators, self.min_samples_leaf, self.subtree_rows) < 1 or self.min_samples_split < 2 or self.max_bins < 2:
            raise ValueError("trees, leaf rows and subtree rows must be positive, split rows and bins at least 2")

    def tried(self, width: int) -> int:
        """How many features that can split a node are looked at."""
        m = self.max_features or ("sqrt" if self.task == "classification" else "all")
        named = {"sqrt": math.sqrt(width), "auto": math.sqrt(width), "log2": math.log2(max(width, 1)), "onethird": width / 3, "all": width}
        if m in named:
            m = named[m]
        elif isinstance(m, str) or isinstance(m, float):
            m = float(m) * width if float(m) <= 1 else float(m)
        return min(width, max(1, int(m)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def _named(*parts: int) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = _mix(h ^ np.array([p % 2**64], np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    return h


def copies(u: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """How often a tree sees each row."""
    if not s.bootstrap:
        return np.ones(len(u))
    share = _mix(_mix(u ^ _named(s.seed, tree))) / 2.0**64
    return np.searchsorted(POISSON, share, side="right").astype(float)


def _looked_at(names: np.ndarray, valid: np.ndarray, tried: int) -> np.ndarray:
    """Which features (nodes, features) a node may use: of those that can split it, the first by the node's own order."""
    order = np.argsort(_mix(names[:, None] ^ np.concatenate([_named(7, f) for f in range(valid.shape[1])])[None, :]), axis=1)
    seen = np.cumsum(np.take_along_axis(valid, order, 1), axis=1)
    out = np.zeros_like(valid)
    np.put_along_axis(out, order, seen <= tried, 1)
    return out & valid


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A threshold t with a <= t < b."""
    with np.errstate(invalid="ignore", over="ignore"):
        t = a + (b - a) / 2
    return np.where(np.isfinite(t) & (t >= a) & (t < b), t, a)


def _first_best(gain: np.ndarray) -> np.intp:
    """The first of the greatest; sums over the cluster differ in their last digits from run to run, and that must not decide."""
    most = gain.max()
    return np.argmax(gain >= most - 1e-10 * abs(most)) if np.isfinite(most) else gain.argmax()


def _nearly(most: np.ndarray, slack: float) -> np.ndarray:
    return most - slack * np.abs(most) if slack else most


def _parts(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    """What is summed up besides weights: the weighted label, or the weight of each class."""
    return w[:, None] * (y[:, None] == np.arange(classes) if classes else y[:, None])


class _Grown:
    """Columns of a tree under growth, whole levels at a time."""

    names = ("feature", "threshold", "left", "right", "value", "rows", "weight")

    def __init__(self):
        self.levels: list[tuple] = []
        self.size = 0

    def add(self, value, rows, weight) -> int:
        m = len(rows)
        self.levels.append((np.full(m, -1, np.int32), np.zeros(m), np.full(m, -1, np.int32), np.full(m, -1, np.int32), value, rows.astype(float), weight))
        self.size += m
        return self.size - m

    def columns(self) -> dict[str, np.ndarray]:
        return {n: np.concatenate([lv[k] for lv in self.levels]) for k, n in enumerate(self.names)}


@dataclass
class Cells:
    """Rows of equal features taken together, or single rows: sums of parts and weights, how many rows, their least and greatest label."""

    x: np.ndarray
    parts: np.ndarray
    w: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of_rows(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> Cells:
        return cls(x, _parts(y, w, classes), w, np.ones(len(y), np.int64), y, y)

    @classmethod
    def of_table(cls, table: np.ndarray, width: int) -> Cells:
        x, parts, (w, n, low, high) = table[:, :width], table[:, width:-4], table[:, -4:].T
        return cls(x, parts, w, n.astype(np.int64), low, high)

    def cells(self, classes: int) -> Cells:
        return self

    def table(self) -> np.ndarray:
        return np.column_stack([self.x, self.parts, self.w, self.n, self.low, self.high])

    def merged(self) -> Cells:
        """Cells of equal features become one; their order does not matter."""
        table = np.column_stack([self.parts, self.w, self.n, self.low, self.high, self.x])
        order = np.lexsort(table.T)
        x = self.x[order]
        at = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)]))
        return Cells(x[at], np.add.reduceat(self.parts[order], at, axis=0), np.add.reduceat(self.w[order], at), np.add.reduceat(self.n[order], at),
                     np.minimum.reduceat(self.low[order], at), np.maximum.reduceat(self.high[order], at))


@dataclass
class Rows:
    """Single rows; as a table they take less room than cells."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray

    def table(self) -> np.ndarray:
        return np.column_stack([self.x, self.y, self.w])

    def cells(self, classes: int) -> Cells:
        return Cells.of_rows(self.x, self.y, self.w, classes)


def grow(cells: Cells, s: Settings, name: np.ndarray, depth: int = 0, slack: float = 0.0,
         blind: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A subtree over some rows, level by level, and the impurity that each feature takes away.

    All nodes of a level are split together: a feature's cells (node, value) are sorted and summed, running sums inside a node are its left sides.
    ``blind``: a node's features are drawn without a look at which can split it. ``slack``: gains that differ by this share only are equal, where sums depend on the order of partial sums; the first of them counts.
    """
    x, parts, w, held, low, high = cells.x, cells.parts, cells.w, cells.n, cells.low, cells.high
    width, tried = x.shape[1], s.tried(x.shape[1])
    values, rank = [], np.zeros(x.shape, np.int64)
    for f in range(width):
        v, rank[:, f] = np.unique(x[:, f], return_inverse=True)
        values.append(v)
    out, importance = _Grown(), np.zeros(width)
    rows, at, m = np.arange(len(x)), np.zeros(len(x), np.int64), 1
    names = name
    while m:
        n = np.bincount(at, minlength=m)  # rows lie in the order of their nodes, and no node is empty
        starts = np.cumsum(n) - n
        n = np.add.reduceat(held[rows], starts)
        weight, sums = np.add.reduceat(w[rows], starts), np.add.reduceat(parts[rows], starts, axis=0)
        number = out.add(sums / weight[:, None], n, weight)
        level = out.levels[-1]
        wanted = (np.minimum.reduceat(low[rows], starts) < np.maximum.reduceat(high[rows], starts)) & (n >= max(s.min_samples_split, 2 * s.min_samples_leaf))
        if (s.max_depth is not None and depth >= s.max_depth) or not wanted.any():
            break
        depth += 1
        slot = np.cumsum(wanted) - 1
        rows, at = rows[wanted[at]], slot[at[wanted[at]]]
        opened = np.flatnonzero(wanted)
        k = len(opened)
        total_w, total_s, total_n = weight[opened], sums[opened], n[opened]
        gains, cuts = np.full((k, width), -np.inf), np.zeros((k, width))
        for f in range(width):
            key = at * len(values[f]) + rank[rows, f]
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            node, of = np.divmod(key[first], len(values[f]))
            ends = np.append(node[1:] != node[:-1], True)
            if ends.all():
                continue
            own = np.flatnonzero(np.concatenate([[True], ends[:-1]]))  # a node's first cell

            def running(cells, own=own, node=node):
                up = np.cumsum(cells, axis=0)
                return up - (up[own] - cells[own])[node]

            sorted_rows = rows[order]
            lw = running(np.add.reduceat(w[sorted_rows], first))
            ls = running(np.add.reduceat(parts[sorted_rows], first, axis=0))
            ln = running(np.add.reduceat(held[sorted_rows], first))
            fits = ~ends & (ln >= s.min_samples_leaf) & (total_n[node] - ln >= s.min_samples_leaf)
            rw = np.where(fits, total_w[node] - lw, 1.0)
            gain = np.where(fits, (ls**2).sum(1) / lw + ((total_s[node] - ls) ** 2).sum(1) / rw, -np.inf)
            best = np.maximum.reduceat(gain, own)
            hit = np.flatnonzero((gain >= _nearly(best, slack)[node]) & fits)
            found, where = np.unique(node[hit], return_index=True)
            cell = hit[where]
            gains[found, f] = best[found]
            cuts[found, f] = _between(values[f][of[cell]], values[f][of[cell + 1]])
        gains = np.where(_looked_at(names[opened], (gains > -np.inf) | blind, tried), gains, -np.inf)
        feature = (gains >= _nearly(gains.max(axis=1), slack)[:, None]).argmax(axis=1)
        most = gains[np.arange(k), feature]
        split = most > -np.inf
        if not split.any():
            break
        np.add.at(importance, feature[split], most[split] - (total_s[split] ** 2).sum(1) / total_w[split])
        child = np.cumsum(split) - 1
        to = opened[split]
        level[0][to], level[1][to] = feature[split], cuts[np.arange(k), feature][split]
        level[2][to] = out.size + 2 * np.arange(len(to))
        level[3][to] = level[2][to] + 1
        names = _mix(np.stack([names[to] * np.uint64(2), names[to] * np.uint64(2) + np.uint64(1)], axis=1).ravel())
        stay = split[at]
        rows, at = rows[stay], at[stay]
        right = x[rows, feature[at]] > cuts[at, feature[at]]
        at = 2 * child[at] + right
        order = np.argsort(at, kind="stable")
        rows, at, m = rows[order], at[order], 2 * len(to)
        assert number + n.size == out.size
    return out.columns(), importance


class _Top:
    """A tree's upper part on the driver: as many nodes as its rows make subtrees."""

    def __init__(self, name: np.ndarray):
        self.feature, self.threshold, self.left, self.right = [-1], [0.0], [-1], [-1]
        self.depth, self.name = [0], [name]

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        kids = (len(self.feature), len(self.feature) + 1)
        self.feature[node], self.threshold[node], (self.left[node], self.right[node]) = feature, threshold, kids
        for side in range(2):
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
            self.depth.append(self.depth[node] + 1)
            self.name.append(_mix(self.name[node] * np.uint64(2) + np.uint64(side)))
        return kids

    def columns(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int32), np.array(self.threshold), np.array(self.left, np.int32), np.array(self.right, np.int32)


def ends_at(columns: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The node where each row ends."""
    feature, threshold, left, right = columns
    at = np.zeros(len(x), np.int64)
    todo = np.arange(len(x)) if feature[0] >= 0 else np.empty(0, np.int64)
    while len(todo):
        node = at[todo]
        at[todo] = np.where(x[todo, feature[node]] <= threshold[node], left[node], right[node])
        todo = todo[feature[at[todo]] >= 0]
    return at


def _matrix(column: pa.Array | pd.Series, width: int) -> np.ndarray:
    if isinstance(column, pa.ListArray) and not column.null_count:
        values = column.flatten()
        if not values.null_count and len(values) == len(column) * width and (np.diff(column.offsets.to_numpy()) == width).all():
            x = values.to_numpy().reshape(len(column), width)
            return np.where(np.isnan(x), -np.inf, x)
    rows = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    x = np.array(rows, dtype=float).reshape(len(rows), width)
    return np.where(np.isnan(x), -np.inf, x)


def _free(df: DataFrame, name: str) -> str:
    """A name like this that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _features(df: DataFrame, features: str):
    return vector_to_array(features) if df.schema[features].dataType.typeName() != "array" else F.col(features).cast("array<double>")


def fit(data: DataFrame, settings: Settings | None = None, features: str = "features", label: str = "label", weight: str | None = None,
        key: str | None = None) -> ForestModel:
    """Grow a forest on a table with a vector (or array) of features.

    Rows without a label and rows with a weight of zero or none are left out; classes are whole numbers from 0. ``key`` makes samples repeat on
    any partitioning; without it a row's hash takes in its place. An empty table gives a forest without trees, which predicts nothing.
    """
    s = settings or Settings()
    place = F.xxhash64(F.lit(s.seed), F.col(key)) if key else F.xxhash64(F.lit(s.seed), F.monotonically_increasing_id())
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = data.where(F.col(label).isNotNull() & (w > 0)).select(_features(data, features).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"),
                                                                place.alias("u"))
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max("y").alias("most"), F.min("y").alias("least"),
                     F.avg("y").alias("mean"), F.max((F.col("y") != F.floor("y")).cast("int")).alias("broken"),
                     F.approx_count_distinct(F.xxhash64("x")).alias("distinct")).first()
    n, width = about["n"], about["width"] or 0
    classes, base = 0, float(f"{about['mean'] or 0.0:.6g}")  # labels are taken from about their mean; its last digits depend on the partitioning
    if s.task == "classification":
        if n and (about["broken"] or about["least"] < 0 or about["most"] >= MOST_CLASSES):
            raise ValueError(f"classes must be whole numbers from 0 to {MOST_CLASSES - 1}")
        classes, base = max(2, int(about["most"] or 0) + 1), 0.0
    spark = data.sparkSession
    if n == 0:
        return ForestModel(spark.createDataFrame([], SUBTREE), s, width, classes, base, [])
    # a tree cannot tell rows of equal features apart: where most repeat in a large table, their sums stand for them
    collapse = width > 0 and n > s.subtree_rows and about["distinct"] <= (min(n, BLOCK_ROWS) if s.bootstrap else n) // 2
    packed = checkpointed(_packed(rows, s, width, classes, base, collapse))
    tops, importance = _grow_tops(packed, s, about["distinct"] if collapse else n, width, classes, collapse)
    sent = spark.sparkContext.broadcast([t.columns() for t in tops])  # nodes that hold more rows than a task should, and their children
    names = spark.sparkContext.broadcast([(t.name, t.depth) for t in tops])

    def deal(batches: Iterator[pa.RecordBatch]):
        for block in _unpacked(batches, width, classes):
            for tree, columns in enumerate(sent.value):
                cells = block(tree, s)
                at = ends_at(columns, cells.x)
                order = np.argsort(at, kind="stable")
                table, at = cells.table()[order], at[order]
                cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else []
                out = [{"tree": tree, "node": int(at[a]), "rows": table[a:b].tobytes()} for a, b in zip(cut, [*cut[1:], len(at)], strict=True)]
                if out:
                    yield pa.RecordBatch.from_pylist(out)

    def subtree(which, chunks):
        tree, node = int(which[0]), int(which[1])
        # the order of chunks differs between runs, that of the rows must not
        if collapse:
            cells = Cells.of_table(np.frombuffer(b"".join(chunks["rows"]), np.float64).reshape(-1, width + max(classes, 1) + 4), width).merged()
        else:
            table = np.frombuffer(b"".join(chunks["rows"]), np.float64).reshape(-1, width + 2)
            table = table[np.lexsort(table.T)]
            cells = Cells.of_rows(table[:, :width], table[:, width], table[:, width + 1], classes)
        name, depth = names.value[tree]
        columns, gains = grow(cells, s, name[node], depth[node], SLACK if collapse else 0.0)
        columns["value"] = columns["value"] + base
        return pd.DataFrame([{"tree": tree, "node": node, "nodes": len(columns["feature"]), **{k: v.tobytes() for k, v in columns.items()},
                              "importance": gains.tolist()}])

    chunks = packed.mapInArrow(deal, "tree long, node long, rows binary")
    return ForestModel(checkpointed(chunks.groupBy("tree", "node").applyInPandas(subtree, SUBTREE)), s, width, classes, base,
                       [t.columns() for t in tops], importance)


def counted_cells(data: DataFrame, features: str, label: str, classes: int) -> Cells:
    """A table of classes as its different features with the rows of each class, in the order of the features, on the driver."""
    counts = [F.count(F.when(F.col(label) == c, 1)).cast("double").alias(f"c{c}") for c in range(classes)]
    found = data.groupBy(_features(data, features).alias("x")).agg(*counts).toArrow().combine_chunks()
    width = len(found.column("x")[0]) if found.num_rows else 0
    x = _matrix(found.column("x").combine_chunks(), width) if width else np.zeros((found.num_rows, 0))
    parts = np.column_stack([found.column(f"c{c}").to_numpy() for c in range(classes)])
    order = np.lexsort(x.T) if width else np.arange(len(x))
    return _of_counts(x[order], parts[order])


def _of_counts(x: np.ndarray, parts: np.ndarray) -> Cells:
    n = parts.sum(axis=1)
    return Cells(x, parts, n, n.astype(np.int64), (parts > 0).argmax(axis=1), parts.shape[1] - 1 - (parts > 0)[:, ::-1].argmax(axis=1))


def cell_importance(spark: SparkSession, cells: Cells, settings: Settings) -> np.ndarray:
    """What ``featureImportances`` of a forest of classes says, grown on counted cells, a tree a task.

    As in Spark's forests, a node's features are drawn among all, not among those that can split it. n rows that a sample holds
    once each on average are in it a Poisson number of times with mean n, so that number is drawn for a cell and class.
    """
    s, width = settings, cells.x.shape[1]
    sent = spark.sparkContext.broadcast((cells.x, cells.parts))

    def trees(batches):
        for b in batches:
            for tree in b.column(0).to_pylist():
                x, parts = sent.value
                if s.bootstrap:
                    parts = np.random.default_rng([s.seed, tree]).poisson(parts).astype(float)
                there = parts.any(axis=1)
                gains = grow(_of_counts(x[there], parts[there]), s, _named(s.seed, tree, 1), blind=True)[1] if there.any() else np.zeros(width)
                yield pa.RecordBatch.from_pydict({"tree": [tree], "importance": pa.array([gains.tolist()], pa.list_(pa.float64()))})

    parts = min(s.n_estimators, 4 * spark.sparkContext.defaultParallelism)
    grown = spark.range(0, s.n_estimators, 1, parts).mapInArrow(trees, "tree long, importance array<double>").orderBy("tree").collect()  # a row a tree
    sent.unpersist()
    total = np.zeros(width)
    for one in (np.array(row["importance"]) for row in grown):
        total += one / one.sum() if one.sum() > 0 else 0.0
    return total / total.sum() if total.sum() > 0 else total


def _packed(rows: DataFrame, s: Settings, width: int, classes: int, base: float, collapse: bool) -> DataFrame:
    """Blocks of rows (x, y, w, u). With ``collapse`` a block has each x once: with the sums of its rows if all trees see the same rows, else with its rows.

    ``starts``: where the rows of each x start, if x is there once; ``cells``: the sums.
    """
    names = ("x", "y", "w", "u", "starts", "cells")
    schema = f"n long, {', '.join(f'{c} binary' for c in names)}"

    def block(x, **more):
        row = {"n": len(x), "x": x.tobytes(), **{c: more[c].tobytes() for c in more}}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("n", pa.int64()), *[(c, pa.binary()) for c in names]]))

    def plain(batches):
        for b in batches:
            if b.num_rows:
                y, w, u = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                yield block(_matrix(b.column(0), width), y=y - base, w=w, u=u)

    def grouped(batches):
        def out(held):
            x, y, w, u = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort(x.T)
            x = x[order]
            starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)]))
            return block(x[starts], y=y[order], w=w[order], u=u[order], starts=starts)

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                y, w, u = (b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                held.append((_matrix(b.column(0), width), y - base, w, u))
                size += b.num_rows
                if size >= BLOCK_ROWS:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    def summed(batches):
        for b in batches:
            if b.num_rows:
                yield block(_matrix(b.column(0), width), cells=np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]]))

    if not collapse:
        return rows.mapInArrow(plain, schema)
    if s.bootstrap:
        return rows.mapInArrow(grouped, schema)
    y = F.col("y") - F.lit(base)
    parts = [F.sum(F.when(F.col("y") == c, F.col("w")).otherwise(0.0)) for c in range(classes)] or [F.sum(F.col("w") * y)]
    return rows.groupBy("x").agg(*[p.alias(f"p{k}") for k, p in enumerate(parts)], F.sum("w").alias("w"), F.count("*").alias("n"), F.min(y).alias("low"),
                                 F.max(y).alias("high")).mapInArrow(summed, schema)


def _unpacked(batches, width: int, classes: int):
    """For each block a function of a tree that gives the cells that the tree sees: its rows, or its distinct features with the sums of their rows."""
    for b in batches:
        for row in b.to_pylist():
            x = np.frombuffer(row["x"], np.float64).reshape(row["n"], width)
            if row["cells"] is not None:
                seen = Cells.of_table(np.column_stack([x, np.frombuffer(row["cells"], np.float64).reshape(len(x), -1)]), width)
                yield lambda tree, s, seen=seen: seen
                continue
            y, w, u = np.frombuffer(row["y"], np.float64), np.frombuffer(row["w"], np.float64), np.frombuffer(row["u"], np.uint64)
            starts = None if row["starts"] is None else np.frombuffer(row["starts"], np.int64)
            yield lambda tree, s, x=x, y=y, w=w, u=u, starts=starts: _seen(x, y, w, copies(u, tree, s), starts, classes)


def _seen(x: np.ndarray, y: np.ndarray, w: np.ndarray, times: np.ndarray, starts: np.ndarray | None, classes: int) -> Cells | Rows:
    there = times > 0
    if starts is None:
        use = np.flatnonzero(there)
        return Rows(x[use], y[use], w[use] * times[use])
    ww = w * times
    parts = [ww * (y == c) for c in range(classes)] or [ww * y]
    n = np.add.reduceat(there, starts, dtype=np.int64)
    use = np.flatnonzero(n)
    return Cells(x[use], np.stack([np.add.reduceat(p, starts)[use] for p in parts], axis=1), np.add.reduceat(ww, starts)[use], n[use],
                 np.minimum.reduceat(np.where(there, y, np.inf), starts)[use], np.maximum.reduceat(np.where(there, y, -np.inf), starts)[use])


def _grow_tops(packed: DataFrame, s: Settings, n: int, width: int, classes: int, collapse: bool) -> tuple[list[_Top], np.ndarray]:
    """Split nodes by sums over bins until every node has few enough rows (or cells, with ``collapse``) for a task, or cannot be split."""
    tops = [_Top(_named(s.seed, t, 1)) for t in range(s.n_estimators)]
    importance = np.zeros(width)
    large = [(t, 0) for t in range(s.n_estimators)] if n > s.subtree_rows else []
    if not large or not width:
        return tops, importance
    k = max(classes, 1) + 3
    cuts = _cuts(packed, s, width, classes)
    per_pass = max(1, PASS_BYTES // (width * k * (s.max_bins + 1) * 8))
    while large:
        found = [row for i in range(0, len(large), per_pass) for row in _node_sums(packed, s, tops, large[i:i + per_pass], cuts, width, classes, collapse)]
        by_node: dict[tuple[int, int], list] = {}
        for row in found:
            by_node.setdefault((row["tree"], row["node"]), []).append(row)
        fresh = []
        for (t, node), rows in sorted(by_node.items()):
            top = tops[t]
            if (s.max_depth is not None and top.depth[node] >= s.max_depth) or rows[0]["pure"]:
                continue
            valid = np.zeros((1, width), bool)
            gain = np.full(width, -np.inf)
            for row in rows:
                if row["gain"] is not None:
                    valid[0, row["feature"]], gain[row["feature"]] = True, row["gain"]
            if valid.any():
                gain = np.where(_looked_at(top.name[node], valid, s.tried(width))[0], gain, -np.inf)
                row = next(r for r in rows if r["feature"] == int(_first_best(gain)))
                importance[row["feature"]] += row["gain"] - row["before"]
                at, sizes = row["threshold"], (row["n_left"], row["n"] - row["n_left"])
            else:  # no bin's limit tells these rows apart: halve the widest range, as long as rows differ
                row = max(rows, key=lambda r: (r["most"] - r["least"] if r["most"] > r["least"] else 0.0, -r["feature"]))
                if not row["most"] > row["least"] or s.min_samples_leaf > 1:
                    continue
                at, sizes = float(_between(np.array(row["least"]), np.array(row["most"]))), (row["n"], row["n"])
            kids = top.split(node, row["feature"], at)
            fresh += [(t, kid) for kid, size in zip(kids, sizes, strict=True) if size > s.subtree_rows]
        large = fresh
    return tops, importance


def _cuts(packed: DataFrame, s: Settings, width: int, classes: int) -> list[np.ndarray]:
    """Limits of bins at percentiles of each feature (approximate, one pass)."""
    def long(batches):
        for block in _unpacked(batches, width, classes):
            cells = block(0, whole).cells(classes)
            for f in range(width):
                v, at = np.unique(cells.x[:, f], return_inverse=True)
                c = np.bincount(at, cells.n)
                yield pa.RecordBatch.from_pydict({"feature": np.full(len(v), f, np.int32), "v": v, "c": c.astype(np.int64)})

    whole = replace(s, bootstrap=False)
    probs = [k / s.max_bins for k in range(1, s.max_bins)]
    found = packed.mapInArrow(long, "feature int, v double, c long").groupBy("feature").agg(
        F.percentile_approx("v", F.array(*map(F.lit, probs)), F.lit(10_000)).alias("cuts"),
        F.max("v").alias("most")).collect()  # a row a feature
    out = [np.empty(0)] * width
    for row in found:
        c = np.unique(np.array(row["cuts"], float))
        out[row["feature"]] = c[c < row["most"]]
    return out


def _node_sums(packed: DataFrame, s: Settings, tops: list[_Top], nodes: list[tuple[int, int]], cuts: list[np.ndarray], width: int, classes: int,
               collapse: bool) -> list:
    """One row for each node and feature: the feature's best split of the node by bins; ``n`` and ``n_left`` count rows, with ``collapse`` cells."""
    sc = packed.sparkSession.sparkContext
    trees = sorted({t for t, _ in nodes})
    sent = sc.broadcast({t: tops[t].columns() for t in trees})
    of_tree = {t: [node for u, node in nodes if u == t] for t in trees}
    bins, k = s.max_bins + 1, max(classes, 1) + 3
    least = s.min_samples_leaf

    def count(batches):
        sums = {t: np.zeros((len(v), width, k, bins)) for t, v in of_tree.items()}
        ranges = {t: np.tile([np.inf, -np.inf], (len(v), width + 1, 1)) for t, v in of_tree.items()}
        for block in _unpacked(batches, width, classes):
            for t, mine in of_tree.items():
                cells = block(t, s).cells(classes)
                columns = sent.value[t]
                slot = np.full(len(columns[0]), -1)
                slot[mine] = np.arange(len(mine))
                at = slot[ends_at(columns, cells.x)]
                use = np.flatnonzero(at >= 0)
                at, x = at[use], cells.x[use]
                for f in range(width):
                    cell = at * bins + np.searchsorted(cuts[f], x[:, f])
                    for j, v in enumerate([*cells.parts[use].T, cells.w[use], cells.n[use], None]):
                        sums[t][:, f, j] += np.bincount(cell, v, len(mine) * bins).reshape(len(mine), bins)
                for f, (v, w) in enumerate([*zip(x.T, x.T, strict=True), (cells.low[use], cells.high[use])]):
                    np.minimum.at(ranges[t][:, f, 0], at, v)
                    np.maximum.at(ranges[t][:, f, 1], at, w)
        for t, mine in of_tree.items():
            out = [{"tree": t, "node": node, "feature": f, "sums": sums[t][i, f].tobytes(), "least": ranges[t][i, f, 0], "most": ranges[t][i, f, 1],
                    "y0": ranges[t][i, width, 0], "y1": ranges[t][i, width, 1]} for i, node in enumerate(mine) for f in range(width) if sums[t][i, f, -1].any()]
            if out:
                yield pa.RecordBatch.from_pylist(out)

    def split(which, rows):
        x = np.sum([np.frombuffer(b, np.float64).reshape(k, bins) for b in rows["sums"]], axis=0)
        total, left = x.sum(axis=1), np.cumsum(x, axis=1)
        right = total[:, None] - left
        fits = (left[-2] >= max(least, 1)) & (right[-2] >= max(least, 1))
        score = lambda v: (v[:-3] ** 2).sum(axis=0) / np.where(v[-2] > 0, v[-3], 1.0)
        gain = np.where(fits, score(left) + score(right), -np.inf)
        b, size = int(_first_best(gain)), -1 if collapse else -2
        ok = bool(fits.any()) and b < len(cuts[which[2]])
        return pd.DataFrame([{"tree": which[0], "node": which[1], "feature": which[2], "gain": float(gain[b]) if ok else None,
                              "threshold": float(cuts[which[2]][b]) if ok else None, "n_left": int(round(left[size, b])), "n": int(round(total[size])),
                              "before": float((total[:-3] ** 2).sum() / total[-3]), "least": rows["least"].min(), "most": rows["most"].max(),
                              "pure": bool(rows["y0"].min() == rows["y1"].max())}])

    partial = packed.mapInArrow(count, "tree long, node long, feature long, sums binary, least double, most double, y0 double, y1 double")
    return partial.groupBy("tree", "node", "feature").applyInPandas(
        split, "tree long, node long, feature long, gain double, threshold double, n_left long, n long, before double, least double, most double, pure boolean").collect()


def _subtree_of(row, k: int) -> dict[str, np.ndarray]:
    kinds = {"feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32}
    out = {c: np.frombuffer(row[c], t) for c, t in kinds.items()}
    out["value"] = np.frombuffer(row["value"], np.float64).reshape(-1, k)
    return out


def _walk(subtree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return ends_at((subtree["feature"], subtree["threshold"], subtree["left"], subtree["right"]), x)


class _Known:
    """Remembers what rows of the same features were given, up to KNOWN_ROWS of them."""

    def __init__(self, means, width: int, k: int):
        self.means = means
        self.name, self.x, self.value = np.empty(0, np.uint64), np.empty((0, width)), np.empty((0, k))

    def of(self, m: np.ndarray) -> np.ndarray:
        name = np.zeros(len(m), np.uint64)
        for column in (m + 0.0).T:
            name = _mix(name ^ np.ascontiguousarray(column).view(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
        out = np.empty((len(m), self.value.shape[1]))
        new = np.ones(len(m), bool)
        if len(self.name):
            at = np.minimum(np.searchsorted(self.name, name), len(self.name) - 1)
            new = (self.name[at] != name) | (self.x[at] != m).any(axis=1)  # names of different features may be equal
            out[~new] = self.value[at[~new]]
        if new.any():
            rows, first, back = (np.flatnonzero(new), *np.unique(name[new], return_index=True, return_inverse=True)[1:])
            same = (m[rows[first]][back] == m[rows]).all(axis=1)
            value = self.means(m[rows[first]])
            out[rows] = value[back]
            if not same.all():
                out[rows[~same]] = self.means(m[rows[~same]])
            if len(self.name) + len(first) <= KNOWN_ROWS:
                name = np.concatenate([self.name, name[rows[first]]])
                order = np.argsort(name, kind="stable")
                self.name, self.x = name[order], np.concatenate([self.x, m[rows[first]]])[order]
                self.value = np.concatenate([self.value, value])[order]
        return out


class ForestModel(Model, MLWritable, MLReadable):
    """A grown forest: ``subtrees`` has one row for each subtree, ``tops`` the nodes above them."""

    def __init__(self, subtrees: DataFrame | None = None, settings: Settings | None = None, width: int = 0, classes: int = 0, base: float = 0.0,
                 tops: list | None = None, importance: np.ndarray | None = None):
        super().__init__()
        self.subtrees, self.settings, self.width, self.classes, self.base = subtrees, settings or Settings(), width, classes, base
        self.tops = tops or []
        self.top_importance = np.zeros(width) if importance is None else importance
        self.features, self.broadcast_bytes = "features", BROADCAST_BYTES

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (the name that Spark's forests have)
        """The impurity that each feature takes away, as a share of all; averaged over trees after each is brought to one."""
        of = [F.sum(F.col("importance")[f]).alias(f"f{f}") for f in range(self.width)]
        total = np.zeros(self.width)
        if self.width:
            for row in self.subtrees.groupBy("tree").agg(*of).collect():  # a row a tree
                one = np.array([row[f"f{f}"] or 0.0 for f in range(self.width)]) + self.top_importance / len(self.tops)
                total += one / one.sum() if one.sum() > 0 else 0.0
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def nodes(self) -> DataFrame:
        """One row for each node of the subtrees: tree, node (of the top), at (inside), feature (-1: leaf), threshold, left, right, rows, weight, value."""
        k = max(self.classes, 1)

        def unpack(batches):
            for b in batches:
                for row in b.to_pylist():
                    t = _subtree_of(row, k)
                    m = row["nodes"]
                    yield pa.RecordBatch.from_pydict({"tree": np.full(m, row["tree"]), "node": np.full(m, row["node"]),
                                                      "at": np.arange(m, dtype=np.int32), **{c: t[c] for c in ("feature", "threshold", "left", "right")},
                                                      "rows": np.frombuffer(row["rows"], np.float64), "weight": np.frombuffer(row["weight"], np.float64),
                                                      "value": pa.array(list(t["value"]), pa.list_(pa.float64()))})

        return self.subtrees.mapInArrow(unpack, "tree long, node long, at int, feature int, threshold double, left int, right int, rows double, weight double, "
                                                "value array<double>")

    def _transform(self, df: DataFrame) -> DataFrame:
        """Append ``prediction`` and, for classes, ``rawPrediction`` and ``probability``; NULL where there are no features or no trees."""
        k = max(self.classes, 1)
        if not self.tops:
            kinds = {"rawPrediction": "array<double>", "probability": "array<double>"} if self.classes else {}
            return df.withColumns({**{c: array_to_vector(F.lit(None).cast(t)) for c, t in kinds.items()}, "prediction": F.lit(None).cast("double")})
        size = self.subtrees.agg(F.sum(F.col("nodes") * (20 + 8 * k))).first()[0] or 0
        name = _free(df, "_forest")
        mean = self._by_broadcast(df, k, name) if size <= self.broadcast_bytes else self._by_join(df, k, name)
        p = F.col(name)
        if not self.classes:
            return mean.withColumn("prediction", p[0]).drop(name)
        return mean.withColumns({"rawPrediction": array_to_vector(F.transform(p, lambda v: v * len(self.tops))), "probability": array_to_vector(p),
                                 "prediction": (F.array_position(p, F.array_max(p)) - 1).cast("double")}).drop(name)

    def _by_broadcast(self, df: DataFrame, k: int, name: str) -> DataFrame:
        width, tops = self.width, self.tops
        rows = self.subtrees.select("tree", "node", "feature", "threshold", "left", "right", "value").collect()  # its size was checked
        sent = df.sparkSession.sparkContext.broadcast([(r["tree"], r["node"], *(bytes(r[c]) for c in ("feature", "threshold", "left", "right", "value")))
                                                       for r in rows])

        def means(m: np.ndarray) -> np.ndarray:
            total = np.zeros((len(m), k))
            at = [ends_at(t, m) for t in tops]
            for tree, node, *columns in sent.value:
                sub = _subtree_of(dict(zip(("feature", "threshold", "left", "right", "value"), columns, strict=True)), k)
                mine = np.flatnonzero(at[tree] == node)
                total[mine] += sub["value"][_walk(sub, m[mine])]
            return total / len(tops)

        def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = _Known(means, width, k)
            for x in batches:
                there = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
                out = known.of(_matrix(x.take(pa.array(there)) if len(there) < len(x) else x, width))
                size = np.zeros(len(x) + 1, np.int32)
                size[1:][there] = k
                offsets = pa.array(np.cumsum(size, dtype=np.int32), mask=np.append(size[1:] == 0, False))
                yield pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

        apply = arrow_udf(apply, "array<double>")
        return df.withColumn(name, apply(_features(df, self.features)))

    def _by_join(self, df: DataFrame, k: int, name: str) -> DataFrame:
        """Blocks of rows meet the subtrees they end in; only sums come back to the rows."""
        width, tops = self.width, self.tops
        own = _free(df, "_row")
        df = checkpointed(df.withColumn(own, F.monotonically_increasing_id()))  # the numbers must not change

        def deal(batches):
            def out(held):
                ids, m = (np.concatenate(c) for c in zip(*held, strict=True))
                for tree, top in enumerate(tops):
                    at = ends_at(top, m)
                    order = np.argsort(at, kind="stable")
                    ends = np.flatnonzero(np.append(np.diff(at[order]) != 0, True)) + 1
                    for a, b in zip([0, *ends[:-1]], ends, strict=True):
                        yield pa.RecordBatch.from_pylist([{"tree": tree, "node": int(at[order[a]]), "ids": ids[order[a:b]].tobytes(), "x": m[order[a:b]].tobytes()}])

            held, size = [], 0  # each block brings its subtree along once more, so blocks are large
            for b in batches:
                known = np.flatnonzero(~b.column(1).is_null().to_numpy(zero_copy_only=False))
                if not len(known):
                    continue
                held.append((b.column(0).to_numpy()[known], _matrix(b.column(1).take(pa.array(known)), width)))
                size += len(known)
                if size >= BLOCK_ROWS:
                    yield from out(held)
                    held, size = [], 0
            if held:
                yield from out(held)

        def apply(batches):
            for b in batches:
                for row in b.to_pylist():
                    sub, x = _subtree_of(row, k), np.frombuffer(row["x"], np.float64).reshape(-1, width)
                    yield pa.RecordBatch.from_pydict({"_row": np.frombuffer(row["ids"], np.int64),
                                                      **{f"v{j}": v for j, v in enumerate(sub["value"][_walk(sub, x)].T)}})

        blocks = df.select(own, _features(df, self.features).alias("x")).mapInArrow(deal, "tree long, node long, ids binary, x binary")
        met = blocks.join(self.subtrees.select("tree", "node", "feature", "threshold", "left", "right", "value"), ["tree", "node"])
        sums = met.mapInArrow(apply, f"_row long, {', '.join(f'v{j} double' for j in range(k))}").groupBy(F.col("_row").alias(own)).agg(
            F.array(*[F.sum(f"v{j}") / len(tops) for j in range(k)]).alias(name))
        return df.join(sums, own, "left").drop(own)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        m = self.model
        about = {"settings": asdict(m.settings), "width": m.width, "classes": m.classes, "base": m.base, "features": m.features,
                 "importance": [float(v) for v in m.top_importance], "tops": [[c.tolist() for c in t] for t in m.tops]}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"forest": about})
        m.subtrees.write.parquet(f"{path}/subtrees")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> ForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        f = meta["forest"]
        kinds = (np.int32, np.float64, np.int32, np.int32)
        tops = [tuple(np.array(c, t) for c, t in zip(top, kinds, strict=True)) for top in f["tops"]]
        model = self.cls(self.sparkSession.read.parquet(f"{path}/subtrees"), Settings(**f["settings"]), f["width"], f["classes"], f["base"], tops,
                         np.array(f["importance"]))
        model._resetUid(meta["uid"])
        model.features = f["features"]
        return model


class Forest(Estimator):
    """The forest as a Spark ML estimator; see ``fit``."""

    @keyword_only
    def __init__(self, *, settings: Settings, featuresCol: str = "features", labelCol: str = "label", weightCol: str | None = None):  # noqa: N803
        super().__init__()
        self.settings, self.features, self.label, self.weight = settings, featuresCol, labelCol, weightCol

    def _fit(self, dataset: DataFrame) -> ForestModel:
        model = fit(dataset, self.settings, self.features, self.label, self.weight)
        model.features = self.features
        return model
