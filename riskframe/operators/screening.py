"""Feature screening: one aggregation per statistic, over all features at once."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import drop_nan, interval_bin, long_form, ratio
from riskframe.operators.clean import split_by_type
from riskframe.operators.forest import MOST_CLASSES, Cells, Settings, cell_importance, counted_cells
from riskframe.operators.ordering import exact_percentiles

MISSING = "missing"


# ---- bins ----------------------------------------------------------------------------

def quantile_edges(df: DataFrame, cols: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Interior cut points of equal-frequency bins; repeated edges are merged."""
    probs = [i / bins for i in range(bins + 1)]
    edges = {}
    for c, values in exact_percentiles(drop_nan(df, cols), cols, probs).items():
        edges[c] = sorted({v for v in values if v is not None})[1:-1]
    return edges


def count_bins(df: DataFrame, numeric: dict[str, list[float]], text: Sequence[str], ids: dict[str, Column],
               keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """(feature, bin, keys, aggs) over all features; NULL is the bin 'missing'.

    Numeric bins are grouped as small numbers and named afterwards; numeric and text features
    are two branches of one job that read different columns.
    """
    given = [e.alias(n) for n, e in ids.items()]
    parts = []
    if numeric:
        bins = [F.coalesce(interval_bin(F.col(c).cast("double"), e), F.lit(-1)).alias(c) for c, e in numeric.items()]
        counts = (drop_nan(df, list(numeric)).select(*given, *bins).unpivot(list(ids), list(numeric), "feature", "_bin")
                  .groupBy("feature", "_bin", *keys).agg(*aggs))
        name = F.when(F.col("_bin") < 0, MISSING).otherwise(F.col("_bin").cast("string"))
        parts.append(counts.withColumn("bin", name).drop("_bin"))
    if text:
        bins = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in text]
        parts.append(df.select(*given, *bins).unpivot(list(ids), list(text), "feature", "bin")
                     .groupBy("feature", "bin", *keys).agg(*aggs))
    return reduce(lambda a, b: a.unionByName(b), parts)


def bin_counts(df: DataFrame, label: str, numeric: dict[str, list[float]], text: Sequence[str] = (),
               positive=1) -> DataFrame:
    """(feature, bin, good, bad) of all features."""
    bad = F.when(F.col(label) == F.lit(positive), 1).otherwise(0)
    return count_bins(df.where(F.col(label).isNotNull()), numeric, text, {"_bad": bad}, [],
                      [(F.count(F.lit(1)) - F.sum("_bad")).alias("good"), F.sum("_bad").alias("bad")]
                      ).select("feature", "bin", "good", "bad")


def woe_from_counts(counts: DataFrame) -> DataFrame:
    """(feature, bin, good, bad, woe, iv_part, empty_cell); an empty cell gets 0 and is flagged."""
    totals = counts.groupBy("feature").agg(F.sum("good").alias("_g"), F.sum("bad").alias("_b"))
    j = counts.join(F.broadcast(totals), "feature")  # one row per feature
    good, bad = ratio(F.col("good"), F.col("_g")), ratio(F.col("bad"), F.col("_b"))
    both = (F.col("good") > 0) & (F.col("bad") > 0)
    one_class = (F.col("_g") == 0) | (F.col("_b") == 0)
    woe = F.when(both, F.log(bad / good)).otherwise(F.lit(0.0))
    return j.select("feature", "bin", "good", "bad",
                    F.when(~one_class, woe).alias("woe"),
                    F.when(~one_class, F.when(both, (bad - good) * woe).otherwise(F.lit(0.0))).alias("iv_part"),
                    (~both).alias("empty_cell"))


def woe_table(df: DataFrame, label: str, numeric: Sequence[str], text: Sequence[str] = (),
              bins: int = 10) -> DataFrame:
    return woe_from_counts(bin_counts(df, label, quantile_edges(df, numeric, bins), text))


# ---- statistics, one row per feature -------------------------------------------------

def missing_rates(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    clean = drop_nan(df, cols)
    wide = clean.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    return _as_rows(wide, [(c, F.col(f"m{i}")) for i, c in enumerate(cols)], "missing_rate",
                    lambda s: s <= threshold)


def information_values(df: DataFrame, label: str, numeric: Sequence[str], text: Sequence[str] = (),
                       threshold: float = 0.02, bins: int = 10) -> DataFrame:
    """(feature, iv, kept); a label with one class gives NULL and keeps the feature."""
    iv = woe_table(df, label, numeric, text, bins).groupBy("feature").agg(F.abs(F.sum("iv_part")).alias("iv"))
    return iv.withColumn("kept", F.coalesce(F.col("iv") >= threshold, F.lit(True)))


def variances(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> DataFrame:
    wide = drop_nan(df, cols).agg(*[F.var_samp(F.col(f"`{c}`").cast("double")).alias(f"v{i}")
                                    for i, c in enumerate(cols)])
    return _as_rows(wide, [(c, F.col(f"v{i}")) for i, c in enumerate(cols)], "variance",
                    lambda s: F.coalesce(s >= threshold, F.lit(True)))


def _as_rows(wide: DataFrame, named: list[tuple[str, Column]], stat: str, keep) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("feature"), v.cast("double").alias(stat)) for c, v in named]
    return wide.select(F.inline(F.array(*rows))).withColumn("kept", keep(F.col(stat)))


def correlations(df: DataFrame, cols: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of every pair i < j over the rows where both are known.

    All pairs come from one Gram matrix that the executors add up block by block; missing
    values enter as zeros together with 0/1 masks. Only p x p sums reach the driver.
    """
    cols = list(cols)
    num = drop_nan(df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)]),
                   [f"x{i}" for i in range(len(cols))])
    p = len(cols)
    row = num.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"a{i}") for i in range(p)],
                  *[F.count(f"x{i}").alias(f"c{i}") for i in range(p)]).first()
    mean = [row[f"a{i}"] or 0.0 for i in range(p)]
    z = [F.coalesce(F.col(f"x{i}") - F.lit(mean[i]), F.lit(0.0)).alias(f"z{i}") for i in range(p)]
    holes = any(row[f"c{i}"] < row["n"] for i in range(p))
    names = [f"z{i}" for i in range(p)]
    parts = num.select(*z, *[F.col(f"x{i}").isNotNull().cast("double").alias(f"m{i}") for i in range(p)])
    if holes:
        parts = parts.select("*", *[(F.col(f"z{i}") * F.col(f"z{i}")).alias(f"q{i}") for i in range(p)])
        names += [f"m{i}" for i in range(p)] + [f"q{i}" for i in range(p)]
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(parts).select("v")
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    sxy = gram[:p, :p]
    if holes:
        n = gram[p:2 * p, p:2 * p]
        sx = gram[:p, p:2 * p]
        sxx = gram[2 * p:, p:2 * p]
    else:
        n = np.full((p, p), float(row["n"]))
        sx = np.zeros((p, p))
        sxx = np.repeat(np.diag(sxy)[:, None], p, axis=1)
    out: dict[tuple[str, str], float | None] = {}
    for j in range(p):
        for i in range(j):
            k = n[i, j]
            vi, vj = sxx[i, j] - sx[i, j] ** 2 / k if k else 0.0, sxx[j, i] - sx[j, i] ** 2 / k if k else 0.0
            flat_i, flat_j = k * (1e-13 * mean[i]) ** 2, k * (1e-13 * mean[j]) ** 2
            if k < 2 or vi <= flat_i or vj <= flat_j:
                out[cols[i], cols[j]] = None
            else:
                r = (sxy[i, j] - sx[i, j] * sx[j, i] / k) / np.sqrt(vi * vj)
                out[cols[i], cols[j]] = float(min(1.0, max(-1.0, r)))
    return out


def correlation_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = [(a, b, r) for (a, b), r in correlations(df, cols).items()]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def correlation_screen(df: DataFrame, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """(feature, max_abs_r, kept): dropped when any earlier column is correlated above the threshold."""
    r = correlations(df, cols)
    rows = []
    for j, c in enumerate(cols):
        above = [abs(r[b, c]) for b in cols[:j] if r[b, c] is not None]
        top = max(above, default=None)
        rows.append((c, top, top is None or top <= threshold))
    return df.sparkSession.createDataFrame(rows, "feature string, max_abs_r double, kept boolean")


def sweep(m: np.ndarray, k: int, back: bool = False) -> np.ndarray:
    """The sweep of a symmetric matrix on its k-th diagonal element, or what undoes it; p x p steps."""
    out = m - np.outer(m[:, k], m[k]) / m[k, k]
    sign = -1.0 if back else 1.0
    out[k], out[:, k] = sign * m[k] / m[k, k], sign * m[:, k] / m[k, k]
    out[k, k] = -1.0 / m[k, k]
    return out


def recursive_elimination(df: DataFrame, label: str, cols: Sequence[str], keep: int) -> DataFrame:
    """(feature, rank, beta, kept): least squares on standardised features, without the weakest one after each fit, until ``keep`` are left.

    The weakest has the smallest absolute coefficient ``beta`` (ties: the later column); rank is 1 for those kept, then counts back from the one
    removed last. Rows with a missing value are left out. Constant columns and those that earlier ones determine go first, with beta 0.
    The table is read for one matrix of correlations; an elimination then sweeps that matrix and reads nothing.
    """
    cols = list(cols)
    if not 1 <= keep <= len(cols):
        raise ValueError("keep must be 1 to the number of features")
    every = [*cols, label]
    whole = drop_nan(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in every]), every).dropna(subset=[f"`{c}`" for c in every])
    r = correlations(whole, every)
    p = len(cols)
    m = np.eye(p + 1)
    for i, a in enumerate(every):
        for j in range(i + 1, p + 1):
            m[i, j] = m[j, i] = r[a, every[j]] or 0.0
    constant = {i for i in range(p) if p > 1 and all(r[tuple(every[k] for k in sorted((i, j)))] is None for j in range(p) if j != i)}
    inside, removed = [], []  # removed: (column, beta), the first one first
    for k in range(p):
        if k in constant or m[k, k] < 1e-10:
            removed.append((k, 0.0))
        else:
            m = sweep(m, k)
            inside.append(k)
    removed = removed[:p - keep]
    while len(inside) > keep and len(removed) < p - keep:
        k = min(inside, key=lambda j: (round(abs(m[j, p]), 12), -j))
        removed.append((k, float(m[k, p])))
        m = sweep(m, k, back=True)
        inside.remove(k)
    gone = {k: (p - keep + 1 - at, beta) for at, (k, beta) in enumerate(removed)}
    rows = [(c, *gone[k], False) if k in gone else (c, 1, float(m[k, p]) if k in inside else 0.0, True) for k, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, beta double, kept boolean")


def variance_inflation(df: DataFrame, cols: Sequence[str], threshold: float = 10.0) -> DataFrame:
    """(feature, vif, kept): the diagonal of the inverse correlation matrix."""
    r = correlations(df, cols)
    m = np.eye(len(cols))
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            m[i, j] = m[j, i] = r[a, cols[j]] or 0.0
    vif = np.diag(np.linalg.pinv(m))
    rows = [(c, float(v), bool(v <= threshold)) for c, v in zip(cols, vif)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, kept boolean")


def _contingency(df: DataFrame, y: str, numeric: Sequence[str], text: Sequence[str], bins: int,
                 y_bins: int | None) -> DataFrame:
    """(feature, bin, y, n) of every feature against the (binned) target."""
    df = df.where(F.col(y).isNotNull())
    edges = quantile_edges(df, [*numeric, *([y] if y_bins else [])], bins)
    target = interval_bin(F.col(y).cast("double"), edges.pop(y)) if y_bins else F.col(y)
    return count_bins(df, edges, text, {"_y": target}, ["_y"], [F.count(F.lit(1)).alias("n")])


def mutual_information(df: DataFrame, label: str, numeric: Sequence[str], text: Sequence[str] = (),
                       k: int = 20, task: str = "classification", bins: int = 10) -> DataFrame:
    """(feature, mi, kept): plug-in mutual information in nats over equal-frequency bins."""
    cells = _contingency(df, label, numeric, text, bins, bins if task == "regression" else None)
    n_log_n = lambda c: F.sum(F.col(c) * F.log(F.col(c).cast("double")))
    both = cells.groupBy("feature").agg(F.sum("n").alias("n"), n_log_n("n").alias("sxy"))
    bx = cells.groupBy("feature", "bin").agg(F.sum("n").alias("n")).groupBy("feature").agg(n_log_n("n").alias("sx"))
    by = cells.groupBy("feature", "_y").agg(F.sum("n").alias("n")).groupBy("feature").agg(n_log_n("n").alias("sy"))
    mi = (both.join(bx, "feature").join(by, "feature")
          .select("feature", F.greatest(F.lit(0.0), (F.col("sxy") - F.col("sx") - F.col("sy")) / F.col("n")
                                        + F.log(F.col("n").cast("double"))).alias("mi")))
    return top_k(mi, "mi", [*numeric, *text], k)


def chi_square(df: DataFrame, label: str, numeric: Sequence[str], text: Sequence[str] = (), k: int = 20,
               bins: int = 10) -> DataFrame:
    """(feature, chi2, kept): Pearson's statistic of the bin by class table."""
    cells = _contingency(df, label, numeric, text, bins, None)
    bx = cells.groupBy("feature", "bin").agg(F.sum("n").alias("nx"))
    by = cells.groupBy("feature", "_y").agg(F.sum("n").alias("ny"))
    n = cells.groupBy("feature").agg(F.sum("n").alias("all"))
    part = (cells.join(bx, ["feature", "bin"]).join(by, ["feature", "_y"]).groupBy("feature")
            .agg(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("nx").cast("double") * F.col("ny"))).alias("s")))
    stat = part.join(n, "feature").select("feature", (F.col("all") * (F.col("s") - 1)).alias("chi2"))
    return top_k(stat, "chi2", [*numeric, *text], k)


def f_regression(df: DataFrame, target: str, cols: Sequence[str], k: int = 20) -> DataFrame:
    """(feature, f, kept): F of the single-feature regression, from one aggregation."""
    clean = drop_nan(df, [*cols, target])
    aggs = []
    for i, c in enumerate(cols):
        x, y = F.col(f"`{c}`").cast("double"), F.col(target).cast("double")
        pair = x.isNotNull() & y.isNotNull()
        aggs += [F.covar_pop(x, y).alias(f"c{i}"), F.var_pop(F.when(pair, x)).alias(f"x{i}"),
                 F.var_pop(F.when(pair, y)).alias(f"y{i}"), F.count_if(pair).alias(f"n{i}")]
    rows = []
    for i, c in enumerate(cols):
        r2 = F.try_divide(F.col(f"c{i}") * F.col(f"c{i}"), F.col(f"x{i}") * F.col(f"y{i}"))
        f = F.when(r2 >= 1.0, F.lit(float("inf"))).otherwise(F.try_divide(r2 * (F.col(f"n{i}") - 2), 1 - r2))
        rows.append(F.struct(F.lit(c).alias("feature"), f.alias("f")))
    return top_k(clean.agg(*aggs).select(F.inline(F.array(*rows))), "f", cols, k)


def f_classification(df: DataFrame, label: str, cols: Sequence[str], k: int = 20) -> DataFrame:
    """(feature, f, kept): one-way analysis of variance of each feature over the classes."""
    rows = long_form(drop_nan(df, cols).where(F.col(label).isNotNull()), cols, [label]).where(F.col("x").isNotNull())
    per_class = rows.groupBy("feature", label).agg(F.count("x").alias("n"), F.avg("x").alias("m"),
                                                   F.var_pop("x").alias("v"))
    total = per_class.groupBy("feature").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"),
                                             (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    dev = F.col("m") - F.col("grand")
    sums = per_class.join(F.broadcast(total), "feature").groupBy("feature", "all", "k").agg(
        F.sum(F.col("n") * dev * dev).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    f = F.when((F.col("ssw") == 0) & (F.col("ssb") > 0), F.lit(float("inf"))).otherwise(
        F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1),
                     F.try_divide(F.col("ssw"), F.col("all") - F.col("k"))))
    return top_k(sums.select("feature", f.alias("f")), "f", cols, k)


def top_k(stats: DataFrame, stat: str, order: Sequence[str], k: int) -> DataFrame:
    """Mark the k largest; ties keep schema order and NULL ranks last. One row per feature."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("feature"))
    best = stats.orderBy(F.col(stat).desc_nulls_last(), place).limit(k).select("feature", F.lit(True).alias("kept"))
    return stats.join(F.broadcast(best), "feature", "left").select(
        "feature", stat, F.coalesce("kept", F.lit(False)).alias("kept"))


DEPTH, BINS = 10, 32  # of the forests behind importances; the bins are Spark's default
FEW_ROWS = 250_000  # Spark grows forests on tables up to this size row by row
CELL_BYTES = 64 << 20


def _binned_cells(filled: DataFrame, cols: Sequence[str]) -> Cells | None:
    """Rows (``_y``, features) in the bins of a forest, counted by class: trees split by bins, so rows of the same bins are alike to them.

    None if there are too few rows to need it, or if the bins leave most rows apart.
    """
    names = [f"x{i}" for i in range(len(cols))]
    rows = filled.select("_y", *[F.col(f"`{c}`").alias(x) for c, x in zip(cols, names, strict=True)])
    broken = F.max((F.col("_y") != F.floor("_y")).cast("int"))
    about = rows.agg(F.count("*").alias("n"), F.max("_y").alias("most"), F.min("_y").alias("least"), broken.alias("broken"),
                     *[F.approx_count_distinct(x).alias(f"d_{x}") for x in names],
                     *[F.percentile_approx(x, [k / BINS for k in range(1, BINS)], 10_000).alias(f"q_{x}") for x in names]).first()
    if about["n"] <= FEW_ROWS or about["broken"] or about["least"] < 0 or about["most"] >= MOST_CLASSES:
        return None
    few = [x for x in names if about[f"d_{x}"] <= 1.25 * BINS]  # as many values as bins, or about as many
    values = rows.agg(*[F.collect_set(x).alias(x) for x in few]).first() if few else {}
    splits = []
    for x in names:
        own = np.sort(values[x]) if x in few else np.empty(0)
        cuts = (own[1:] + own[:-1]) / 2 if 0 < len(own) <= BINS else np.unique(about[f"q_{x}"])
        splits.append([-math.inf, *(cuts.tolist() or [0.0]), math.inf])
    binned = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"b_{x}" for x in names]).transform(rows)
    binned = binned.select("_y", F.array(*[f"b_{x}" for x in names]).alias("_bins"))
    classes = max(2, int(about["most"]) + 1)
    n = binned.agg(F.approx_count_distinct(F.xxhash64("_bins"))).first()[0]
    if n > about["n"] // 2 or n * (len(cols) + classes) * 8 > CELL_BYTES:
        return None
    return counted_cells(binned, "_bins", "_y", classes)


def model_importance(df: DataFrame, label: str, cols: Sequence[str], threshold: float = 0.01,
                     family: str = "LR", task: str = "classification", trees: int = 100,
                     seed: int = 42) -> DataFrame:
    """(feature, importance, kept) from a forest or from absolute linear coefficients.

    Missing values are filled with the median first (0 if a column has none at all), as in training; only rows without
    a label are left out. A forest of classes over more than FEW_ROWS rows is grown on the counts of their bins, where most rows share
    these; it draws its samples and features from other numbers than Spark's forest does, from the same distributions.
    """
    rows = drop_nan(df.where(F.col(label).isNotNull()), cols)
    middle = exact_percentiles(rows, cols, [0.5])
    filled = rows.select(F.col(label).cast("double").alias("_y"), *[
        F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(middle[c][0] or 0.0))).alias(c) for c in cols])
    data = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(filled).select("_v", "_y")
    forest = family.upper() in ("RF", "XGB", "LGB")
    opts = {"featuresCol": "_v", "labelCol": "_y"}
    if forest and task == "classification" and (cells := _binned_cells(filled, cols)) is not None:
        settings = Settings("classification", trees, max_depth=DEPTH, max_features=math.ceil(math.sqrt(len(cols))), seed=seed)
        scores = cell_importance(df.sparkSession, cells, settings)
    elif forest:
        kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
        scores = kind(numTrees=trees, maxDepth=DEPTH, maxBins=BINS, seed=seed, **opts).fit(data).featureImportances.toArray()
    elif task == "classification":
        n = data.count()
        model = LogisticRegression(regParam=1.0 / n, standardization=False, **opts).fit(data)
        scores = np.abs(model.coefficientMatrix.toArray()).max(axis=0)
    else:
        row = data.agg(F.count("_y").alias("n"), F.stddev_pop("_y").alias("s")).first()
        model = LinearRegression(regParam=(row["s"] or 0.0) / row["n"], standardization=False, solver="normal",
                                 **opts).fit(data)
        scores = np.abs(model.coefficients.toArray())
    rows = [(c, float(s), bool(s >= threshold)) for c, s in zip(cols, scores)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, kept boolean")


# ---- several steps in a row ----------------------------------------------------------

def select_k_best(train: DataFrame, test: DataFrame, label: str, cols: Sequence[str], k: int,
                  score: str = "f_classif") -> tuple[DataFrame, DataFrame, list[str]]:
    """Choose on the training table, select the same columns from both."""
    score_of = {"f_classif": f_classification, "f_regression": f_regression,
                "mutual_info": lambda d, y, c, k: mutual_information(d, y, c, k=k)}[score]
    kept = {r["feature"] for r in score_of(train, label, cols, k=k).where("kept").collect()}
    names = [c for c in cols if c in kept]
    return train.select(*names, label), test.select(*names, label), names


ORDER = ["missing_rate", "iv", "correlation", "variance", "mutual_info", "importance", "f_regression", "f_classif"]


@dataclass
class FeatureSelector:
    """Runs the chosen screens one after the other, each on the survivors of the last.

    Survivors stay in schema order, so the result does not depend on the run. Screens that
    need numbers leave text features alone.
    """

    label: str
    task: str = "classification"
    methods: Sequence[str] = ("missing_rate", "correlation", "variance")
    missing_rate_threshold: float = 0.5
    correlation_threshold: float = 0.9
    variance_threshold: float = 0.01
    iv_threshold: float = 0.02
    mutual_info_k: int | str = "auto"
    importance_threshold: float = 0.01
    f_regression_k: int | str = "auto"
    f_classif_k: int | str = "auto"
    family: str = "LR"
    selected: list[str] | None = None
    removed: dict[str, list[str]] = field(default_factory=dict)

    def _k(self, k) -> int:
        return k if isinstance(k, int) else 20

    def _screen(self, step: str, df: DataFrame, cols: list[str]) -> DataFrame | None:
        num, text = split_by_type(df, cols)
        classes = self.task == "classification"
        if step == "missing_rate":
            return missing_rates(df, cols, self.missing_rate_threshold)
        if step == "iv" and classes:
            return information_values(df, self.label, num, text, self.iv_threshold)
        if step == "correlation" and len(num) > 1:
            return correlation_screen(df, num, self.correlation_threshold)
        if step == "variance" and num:
            return variances(df, num, self.variance_threshold)
        if step == "mutual_info":
            return mutual_information(df, self.label, num, text, self._k(self.mutual_info_k), self.task)
        if step == "importance" and num:
            return model_importance(df, self.label, num, self.importance_threshold, self.family, self.task)
        if step == "f_regression" and not classes and num:
            return f_regression(df, self.label, num, self._k(self.f_regression_k))
        if step == "f_classif" and classes and num:
            return f_classification(df, self.label, num, self._k(self.f_classif_k))
        return None

    def fit(self, df: DataFrame, cols: Sequence[str]) -> "FeatureSelector":
        left = list(cols)
        self.removed = {}
        for step in ORDER:
            if step not in self.methods or not left:
                continue
            table = self._screen(step, df, left)
            if table is None:
                continue
            gone = {r["feature"] for r in table.where(~F.col("kept")).collect()}  # one row per feature
            self.removed[step] = [c for c in left if c in gone]
            left = [c for c in left if c not in gone]
        self.selected = left
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        names = self.get_selected_features()
        return df.select(*names, *([self.label] if self.label in df.columns else []))

    def get_selected_features(self) -> list[str]:
        if self.selected is None:
            raise ValueError("fit the selector first")
        return list(self.selected)

    def get_removed_features(self) -> dict[str, list[str]]:
        return dict(self.removed)

    def summary(self, df: DataFrame) -> DataFrame:
        """(feature, status, step) for every feature that was looked at."""
        rows = [(f, "selected", "") for f in self.get_selected_features()]
        rows += [(f, "removed", step) for step, names in self.removed.items() for f in names]
        return df.sparkSession.createDataFrame(rows, "feature string, status string, step string")
