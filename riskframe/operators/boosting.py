"""Second-order gradient boosting on histograms, level by level or best leaf first.

Rows are binned once and packed into blocks of numpy columns. A pass adds up gradients, hessians and rows by (node, feature, bin) in every
task, over whole blocks; what leaves a task is one array whose size depends on nodes, features and bins, never on rows. Only the
smaller child of a split is counted, its sibling is the parent less that. Splits are chosen on the driver from these sums.

A task finds a row's margin by applying the trees so far. Python workers remember margins between passes, in bounded memory; a lost
executor or a forgotten block costs the work again and changes no result.
"""

from __future__ import annotations

import heapq
import sys
import types
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MISSING = 0  # the bin of missing values
KEPT_BYTES = 256 << 20  # margins that a Python worker remembers
BLOCK_ROWS = 32_768
TASK_ROWS = 4 * BLOCK_ROWS  # a task is not started for fewer
PARTIALS = 32  # arrays that the driver adds up itself


@dataclass(frozen=True)
class Settings:
    """``num_leaves`` grows the best leaf first up to so many leaves; without it, whole levels are grown down to ``max_depth``."""

    objective: str = "logistic"  # or squared
    n_estimators: int = 1000
    learning_rate: float = 0.1
    max_depth: int | None = 6
    num_leaves: int | None = None
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    min_child_samples: int = 1
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    max_bins: int = 255
    patience: int | None = None  # rounds without a better loss on the validation rows
    seed: int = 42

    def __post_init__(self):
        if self.objective not in ("logistic", "squared"):
            raise ValueError(f"unknown objective {self.objective!r}")
        if self.num_leaves is None and self.max_depth is None:
            raise ValueError("growing by levels needs a depth")
        if not 2 <= self.max_bins <= 65_000:
            raise ValueError("max_bins must be 2 to 65,000")


class Tree:
    """A tree as columns, one entry a node: feature (-1: leaf), last bin that goes left, where missing values go, children, sums, value."""

    def __init__(self):
        self.feature, self.bin, self.missing_left, self.left, self.right = [], [], [], [], []
        self.g, self.h, self.n, self.value, self.gain = [], [], [], [], []

    def add(self, g: float, h: float, n: float, value: float) -> int:
        for name, v in (("feature", -1), ("bin", 0), ("missing_left", True), ("left", -1), ("right", -1), ("g", g), ("h", h), ("n", n), ("value", value),
                        ("gain", 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def columns(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(getattr(self, c)) for c in ("feature", "bin", "missing_left", "left", "right", "value"))


def leaf_of(columns: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The node where each row of bins ends."""
    feature, last, missing_left, left, right, _ = columns
    at = np.zeros(len(x), np.int64)
    todo = np.arange(len(x)) if feature[0] >= 0 else np.empty(0, np.int64)
    while len(todo):
        node = at[todo]
        b = x[todo, feature[node]]
        go = np.where(b == MISSING, missing_left[node], b <= last[node])
        at[todo] = np.where(go, left[node], right[node])
        todo = todo[feature[at[todo]] >= 0]
    return at


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def drawn(u: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """Which rows a tree sees: by the row's hash, the tree and the seed."""
    if s.subsample >= 1:
        return np.ones(len(u), bool)
    key = np.uint64((s.seed * 1_000_003 + tree) % 2**64)
    return _mix(u ^ _mix(np.full(1, key))) < np.uint64(int(s.subsample * (2**64 - 1)))


def slopes(margin: np.ndarray, y: np.ndarray, w: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    if objective == "squared":
        return (margin - y) * w, w
    p = 1 / (1 + np.exp(-margin))
    return (p - y) * w, p * (1 - p) * w


def losses(margin: np.ndarray, y: np.ndarray, w: np.ndarray, objective: str) -> float:
    if objective == "squared":
        return float((w * (margin - y) ** 2).sum())
    return float((w * (np.logaddexp(0, margin) - y * margin)).sum())


def _memory() -> dict:
    module = sys.modules.setdefault("_riskframe_margins", types.ModuleType("_riskframe_margins"))
    return module.__dict__.setdefault("items", {})


def _margin(block, x: np.ndarray, base: float, trees: list) -> np.ndarray:
    """A block's margin after the trees; what a worker remembers of it is only a shorter way there."""
    memory = _memory()
    done, margin = memory.pop(block["name"], (0, None))
    if margin is None or done > len(trees):
        done, margin = 0, np.full(len(x), base)
    for columns in trees[done:]:
        margin = margin + columns[5][leaf_of(columns, x)]
    memory[block["name"]] = (len(trees), margin)
    while len(memory) > 1 and sum(m.nbytes for _, m in memory.values()) > KEPT_BYTES:
        del memory[next(iter(memory))]
    return margin


def _arrays(row):
    """A block's row as (row, bins, label, weight, held back, hash)."""
    n = row["rows"]
    kind = np.uint8 if len(row["x"]) == n * row["width"] else np.uint16
    return row, np.frombuffer(row["x"], kind).reshape(n, row["width"]), *(np.frombuffer(row[c], t) for c, t in (
        ("y", np.float64), ("w", np.float64), ("held", bool), ("u", np.uint64)))


@dataclass
class Blocks:
    """The training table, binned; cuts are the upper limits of each feature's bins but the last."""

    table: RDD  # one row a block; thousands of passes over numpy arrays, each a job of its own, are the RDD's work
    cuts: list[np.ndarray]
    bins: int
    base: float

    def total(self, of, size: int) -> np.ndarray:
        """The sum of ``of(row, x, y, w, held, u)``, arrays of ``size`` numbers, over all blocks."""
        def work(rows):
            out = np.zeros(size)
            for row in rows:
                out += of(*_arrays(row))
            yield out

        parts = self.table.mapPartitions(work)
        if self.table.getNumPartitions() > PARTIALS:  # few arrays reach the driver
            return parts.treeReduce(np.add)
        return np.sum(parts.collect() or [np.zeros(size)], axis=0)


def blocks(data: DataFrame, s: Settings, features: str = "features", label: str = "label", weight: str | None = None,
           validation: str | None = None) -> Blocks:
    """Bin a table with a vector (or array) of features. Rows without a label are left out; NaN is missing.

    Features with few values have a bin for each, others are cut at percentiles (approximate, one pass for all features).
    """
    vector = data.schema[features].dataType.typeName() != "array"
    rows = data.where(F.col(label).isNotNull()).select(
        (vector_to_array(features) if vector else F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(validation) if validation else F.lit(False)).alias("held"))
    first = rows.select(F.size("x").alias("n")).first()
    width = first[0] if first else 0
    probs = F.array(*[F.lit(k / s.max_bins) for k in range(1, s.max_bins)])
    value = lambda k: F.when(~F.isnan(F.col("x")[k]), F.col("x")[k])
    of = [F.struct(F.percentile_approx(value(k), probs, 10_000).alias("cuts"), F.max(value(k)).alias("most")).alias(f"f{k}") for k in range(width)]
    own = ~F.col("held")
    found = rows.agg(*of, F.sum(F.when(own, F.col("y") * F.col("w"))).alias("y"), F.sum(F.when(own, F.col("w"))).alias("w"), F.count("*").alias("rows")).first()
    cuts = []
    for k in range(width):
        c = np.unique(np.array([v for v in found[f"f{k}"]["cuts"] or []], float))
        cuts.append(c[c < found[f"f{k}"]["most"]] if len(c) else c)
    mean = (found["y"] or 0.0) / (found["w"] or 1.0)
    if s.objective == "logistic":
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        mean = float(np.log(mean / (1 - mean)))
    kind = np.uint8 if max(map(len, cuts), default=0) + 2 <= 256 else np.uint16
    run = uuid.uuid4().hex

    def pack(batches):
        for number, batch in enumerate(batches):
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(k, BLOCK_ROWS)
                x = np.stack([np.asarray(v, float) for v in part.column(0).to_pylist()]) if part.num_rows else np.zeros((0, width))
                out = np.zeros(x.shape, kind)
                for f in range(width):
                    out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(cuts[f], x[:, f]) + 1)
                y, w = (part.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
                u = np.ascontiguousarray(np.concatenate([x, y[:, None]], axis=1)).view(np.uint64)
                h = np.arange(len(x), dtype=np.uint64) + np.uint64(number << 32)
                for f in range(u.shape[1]):
                    h = _mix(h ^ u[:, f])
                name = f"{run}/{int(h.sum() % 2**63) if len(h) else 0}/{number}/{k}/{len(x)}"
                yield pa.RecordBatch.from_pylist([{"name": name, "rows": len(x), "width": width, "x": out.tobytes(), "y": y.astype(float).tobytes(),
                                                   "w": w.astype(float).tobytes(), "held": part.column(3).to_numpy(zero_copy_only=False).astype(bool).tobytes(),
                                                   "u": h.tobytes()}])

    tasks = max(1, -(-found["rows"] // TASK_ROWS))
    table = rows.coalesce(tasks).mapInArrow(pack, "name string, rows long, width long, x binary, y binary, w binary, held binary, u binary").rdd.persist(StorageLevel.MEMORY_AND_DISK)
    return Blocks(table, cuts, max(map(len, cuts), default=0) + 2, mean)


def _soft(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def best_split(sums: np.ndarray, s: Settings, allowed: np.ndarray):
    """(gain, feature, bin, missing left, left sums) of a node's sums (3, features, bins), or None. Ties: the first feature and bin, missing left."""
    total = sums[:, :1, :].sum(axis=2, keepdims=True)
    missing, up_to = sums[:, :, :1], np.cumsum(sums[:, :, 1:], axis=2)
    score = lambda x: _soft(x[0], s.reg_alpha) ** 2 / (x[1] + s.reg_lambda + 1e-300)
    left = np.stack([up_to + missing, up_to], axis=1)  # (3, missing left or right, features, bins)
    right = total[:, None] - left
    fits = (left[1] >= s.min_child_weight) & (right[1] >= s.min_child_weight) & (left[2] >= s.min_child_samples) & (right[2] >= s.min_child_samples)
    fits &= (left[2] > 0.5) & (right[2] > 0.5) & allowed[None, :, None]
    gain = np.where(fits, 0.5 * (score(left) + score(right) - score(total[:, None])) - s.gamma, -np.inf)
    gain = np.moveaxis(gain, 0, 2)  # features, bins, direction
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[at] > 1e-12:
        return None
    f, b, d = (int(v) for v in at)
    return float(gain[at]), f, b + 1, d == 0, left[:, d, f, b]


@dataclass
class Boosted:
    """Fitted trees: ``trees`` up to the best round, ``history`` of (round, training loss, validation loss)."""

    settings: Settings
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]
    history: list[tuple[int, float, float | None]] = field(default_factory=list)

    def table(self, spark) -> DataFrame:
        """One row a node: tree, node, feature, threshold (values up to it go left), missing_left, left, right, gain, g, h, n, value."""
        rows = []
        for t, tree in enumerate(self.trees):
            for k, f in enumerate(tree.feature):
                at = float(self._threshold(f, tree.bin[k])) if f >= 0 else None
                rows.append((t, k, int(f), at, bool(tree.missing_left[k]), int(tree.left[k]), int(tree.right[k]), float(tree.gain[k]), float(tree.g[k]),
                             float(tree.h[k]), float(tree.n[k]), float(tree.value[k])))
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, missing_left boolean, left int, right int, gain double, "
                                           "g double, h double, n double, value double")

    def _threshold(self, f: int, b: int) -> float:
        return self.cuts[f][b - 1] if b - 1 < len(self.cuts[f]) else np.inf

    def transform(self, df: DataFrame, features: str = "features", leaf: bool = False) -> DataFrame:
        """Append ``prediction`` and, for classes, ``probability`` (a vector); with ``leaf`` the node of the first tree too."""
        cuts, base, logistic = self.cuts, self.base, self.settings.objective == "logistic"
        trees = df.sparkSession.sparkContext.broadcast([t.columns() for t in self.trees])  # bounded by rounds and leaves

        @pandas_udf("struct<margin:double,leaf:int>")
        def apply(x):
            import pandas as pd

            raw = np.stack([np.asarray(v, float) for v in x]) if len(x) else np.zeros((0, len(cuts)))
            binned = np.stack([np.where(np.isnan(raw[:, f]), MISSING, np.searchsorted(cuts[f], raw[:, f]) + 1) for f in range(len(cuts))], axis=1)
            margin, first = np.full(len(raw), base), np.zeros(len(raw), np.int32)
            for k, columns in enumerate(trees.value):
                at = leaf_of(columns, binned)
                margin += columns[5][at]
                if k == 0:
                    first = at.astype(np.int32)
            return pd.DataFrame({"margin": margin, "leaf": first})

        vector = df.schema[features].dataType.typeName() != "array"
        out = df.withColumn("_boosted", apply(vector_to_array(features) if vector else F.col(features).cast("array<double>")))
        p = 1 / (1 + F.exp(-F.col("_boosted.margin")))
        if logistic:
            out = out.withColumns({"probability": array_to_vector(F.array(1 - p, p)), "prediction": (p > 0.5).cast("double")})
        else:
            out = out.withColumn("prediction", F.col("_boosted.margin"))
        return (out.withColumn("leaf", F.col("_boosted.leaf")) if leaf else out).drop("_boosted")


def fit(data: DataFrame, settings: Settings | None = None, features: str = "features", label: str = "label", weight: str | None = None,
        validation: str | None = None) -> Boosted:
    """Grow trees on the rows that are not for validation.

    With ``patience`` and validation rows, growing stops after so many rounds without a lower validation loss, and the trees up to the best
    round stay. An empty table gives no trees.
    """
    s = settings or Settings()
    if s.patience is not None and validation is None:
        raise ValueError("patience needs validation rows")
    b = blocks(data, s, features, label, weight, validation)
    try:
        return _grow(b, s, data.sparkSession.sparkContext)
    finally:
        b.table.unpersist()


def _grow(b: Blocks, s: Settings, sc) -> Boosted:
    width, bins = len(b.cuts), b.bins
    model = Boosted(s, b.cuts, b.base, [])
    rng = np.random.default_rng(s.seed)
    sealed, recent = sc.broadcast([]), []
    best = (np.inf, 0)

    def value(g, h):
        return float(-_soft(g, s.reg_alpha) / (h + s.reg_lambda + 1e-300) * s.learning_rate)

    def sums_of(nodes: list[int], columns, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums (nodes, 3, features, bins) of some nodes of the growing tree, and losses and weights of the trees before it."""
        base, objective, held_trees, mine = b.base, s.objective, sealed, list(recent)
        size = len(nodes) * 3 * width * bins

        def of(block, x, y, w, held, u):
            margin = _margin(block, x, base, [*held_trees.value, *mine])
            out = np.zeros(size + 4)
            if nodes == [0]:
                for k, rows in ((0, ~held), (2, held)):
                    out[size + k:size + k + 2] = losses(margin[rows], y[rows], w[rows], objective), w[rows].sum()
            use = np.flatnonzero(~held & drawn(u, number, s))
            slot = np.full(len(columns[0]), -1)
            slot[nodes] = np.arange(len(nodes))
            at = slot[leaf_of(columns, x[use])]
            use, at = use[at >= 0], at[at >= 0]
            g, h = slopes(margin[use], y[use], w[use], objective)
            sums = out[:size].reshape(len(nodes), 3, width, bins)
            for f in range(width):
                cell = at * bins + x[use, f]
                for c, weight in enumerate((g, h, None)):
                    sums[:, c, f] += np.bincount(cell, weight, len(nodes) * bins).reshape(len(nodes), bins)
            return out

        out = b.total(of, size + 4)
        return out[:size].reshape(len(nodes), 3, width, bins), out[size:]

    for number in range(s.n_estimators + 1):
        tree = Tree()
        tree.add(0.0, 0.0, 0.0, 0.0)
        (root,), loss = sums_of([0], tree.columns(), number)
        if width == 0 or loss[1] == 0:
            break
        held = loss[2] / loss[3] if loss[3] else None
        model.history.append((number, loss[0] / loss[1], held))
        if s.patience is not None and held is not None:
            if held < best[0] - 1e-12:
                best = (held, number)
            elif number - best[1] >= s.patience:
                break
        if number == s.n_estimators:
            break
        allowed = np.zeros(width, bool)
        allowed[rng.permutation(width)[:max(1, int(round(s.colsample_bytree * width)))]] = True
        tree.g[0], tree.h[0], tree.n[0] = (float(v) for v in root[:, 0].sum(axis=1))
        tree.value[0] = value(tree.g[0], tree.h[0])
        _grow_tree(tree, root, allowed, s, value, lambda nodes, t=tree, k=number: sums_of(nodes, t.columns(), k)[0])
        model.trees.append(tree)
        recent.append(tree.columns())
        if len(recent) == 50:  # what tasks need of older trees travels once
            sealed = sc.broadcast([*sealed.value, *recent])
            recent.clear()
        if tree.feature[0] < 0 and s.subsample >= 1 and s.colsample_bytree >= 1:
            break  # no further tree would split
    if s.patience is not None and best[0] < np.inf:
        model.trees = model.trees[:best[1]]
    return model


def _grow_tree(tree: Tree, root: np.ndarray, allowed: np.ndarray, s: Settings, value, sums_of) -> None:
    """Split nodes until the settings end it; ``sums_of(nodes)`` counts leaves of the tree as it stands."""
    depth, sums = {0: 0}, {0: root}
    queue: list[tuple] = []
    leaves = 1

    def consider(node: int) -> None:
        if s.max_depth is None or s.max_depth < 0 or depth[node] < s.max_depth:
            found = best_split(sums[node], s, allowed)
            if found:
                heapq.heappush(queue, (-found[0], node, found))

    consider(0)
    while queue and (s.num_leaves is None or leaves < s.num_leaves):
        # one split at a time by gain, or all of a level together
        now = [heapq.heappop(queue) for _ in range(1 if s.num_leaves else len(queue))]
        fresh = []
        for _, node, (gain, f, last, missing_left, left) in sorted(now, key=lambda x: x[1]):
            total = sums[node][:, 0].sum(axis=1)
            kids = [tree.add(*map(float, x), value(x[0], x[1])) for x in (left, total - left)]
            tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = f, last, missing_left, gain
            tree.left[node], tree.right[node] = kids
            leaves += 1
            for k in kids:
                depth[k] = depth[node] + 1
            if s.max_depth is None or s.max_depth < 0 or depth[kids[0]] < s.max_depth:
                fresh.append((node, *(kids if left[2] * 2 <= total[2] else kids[::-1])))
            else:
                del sums[node]
        if not fresh or (s.num_leaves is not None and leaves >= s.num_leaves):
            continue
        for (node, small, large), x in zip(fresh, sums_of([k for _, k, _ in fresh]), strict=True):
            sums[small], sums[large] = x, sums.pop(node) - x
            consider(small)
            consider(large)
