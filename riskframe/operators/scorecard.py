"""Scorecards: evidence weights, points, leaf scores, weighted bins and the linear card."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import interval_bin
from riskframe.operators.screening import MISSING, bin_counts, quantile_edges, woe_from_counts
from riskframe.sources.lineage import checkpointed

# Fixed values of the points scale.
BASE, PDO, ODDS = 600.0, 20.0, 50.0
P_LOW, P_HIGH = 0.001, 0.999
UNKNOWN_LEAF = 300
INLINE_BINS = 64


# ---- evidence weights ----------------------------------------------------------------

@dataclass
class WoeModel:
    """Edges per numeric feature and the table of bins; features of any cardinality are allowed."""

    edges: dict[str, list[float]]
    text: list[str]
    table: DataFrame  # feature, bin, good, bad, woe, iv_part, empty_cell

    def bins(self) -> DataFrame:
        """The table with the limits (low, high] of each numeric bin; NULL means unbounded."""
        spark = self.table.sparkSession
        rows = []
        for f, e in self.edges.items():
            cuts = [None, *e, None]
            rows += [(f, str(i), cuts[i], cuts[i + 1]) for i in range(len(cuts) - 1)]
        limits = spark.createDataFrame(rows, "feature string, bin string, low double, high double")
        return self.table.join(F.broadcast(limits), ["feature", "bin"], "left")

    def transform(self, df: DataFrame, suffix: str = "_woe", keep: bool = True) -> DataFrame:
        """Append ``<feature>_woe``; a value without a bin in the training data gets 0."""
        return _append_lookup(df, self, self.table.select("feature", "bin", F.col("woe").alias("v")), suffix, keep)


def fit_woe(df: DataFrame, label: str, numeric: Sequence[str], text: Sequence[str] = (),
            bins: int = 10) -> WoeModel:
    edges = quantile_edges(df, numeric, bins)
    table = checkpointed(woe_from_counts(bin_counts(df, label, edges, text)))  # fitted once, used many times
    return WoeModel(edges, list(text), table)


def _append_lookup(df: DataFrame, model: WoeModel, values: DataFrame, suffix: str, keep: bool) -> DataFrame:
    """Append one looked-up number per feature: CASE for short bin lists, a join for long ones."""
    sizes = {r["feature"]: r["count"] for r in values.groupBy("feature").count().collect()}
    features = [*model.edges, *model.text]
    short = [f for f in features if sizes.get(f, 0) <= INLINE_BINS]
    at: dict[str, dict[str, float]] = {f: {} for f in short}
    for r in values.where(F.col("feature").isin(short)).collect():  # at most INLINE_BINS rows per feature
        at[r["feature"]][r["bin"]] = r["v"]
    out = df
    new: dict[str, Column] = {}
    for f in features:
        x = F.col(f)
        if f in model.edges:
            x = F.when(~F.isnan(x.cast("double")), x.cast("double"))
        if f in at:
            new[f"{f}{suffix}"] = _inline_lookup(x, at[f], model.edges.get(f))
        else:
            b = interval_bin(x, model.edges[f]) if f in model.edges else x
            table = values.where(F.col("feature") == f).select(F.col("bin").alias("_b"), F.col("v").alias("_v"))
            out = out.withColumn("_b", F.coalesce(b.cast("string"), F.lit(MISSING))).join(table, "_b", "left")
            out = out.withColumn(f"{f}{suffix}", F.coalesce("_v", F.lit(0.0))).drop("_b", "_v")
    out = out.withColumns(new)
    return out if keep else out.drop(*features)


def _inline_lookup(x: Column, at: dict[str, float], edges: list[float] | None) -> Column:
    """The bin's number straight from the value: one comparison per bin."""
    def number(name: str) -> Column:
        return F.lit(at.get(name) or 0.0)

    if edges is None:
        e = F.lit(0.0)
        for name, v in at.items():
            e = F.when(x.cast("string") == F.lit(name), F.lit(v or 0.0)).otherwise(e)
    else:
        e = number(str(len(edges)))
        for i in reversed(range(len(edges))):
            e = F.when(x <= F.lit(float(edges[i])), number(str(i))).otherwise(e)
    return F.when(x.isNull(), number(MISSING)).otherwise(e)


# ---- points from a logistic model ----------------------------------------------------

def points_scale(points0: float = BASE, odds0: float = ODDS, pdo: float = PDO) -> tuple[float, float]:
    """(a, b) of score = a - b * log-odds."""
    b = pdo / math.log(2)
    return points0 + b * math.log(odds0), b


def scorecard_points(table: DataFrame, coefficients: Mapping[str, float], intercept: float,
                     points0: float = BASE, odds0: float = ODDS, pdo: float = PDO,
                     digits: int | None = 0) -> DataFrame:
    """(feature, bin, woe, points) plus the row 'basepoints', from a bin table and logistic weights."""
    a, b = points_scale(points0, odds0, pdo)
    spark = table.sparkSession
    weights = spark.createDataFrame([(f, float(w)) for f, w in coefficients.items()], "feature string, _w double")
    points = F.lit(-b) * F.col("_w") * F.col("woe")
    base = a - b * intercept
    if digits is not None:
        points = F.round(points, digits)
        base = math.floor(base * 10 ** digits + 0.5) / 10 ** digits
    rows = table.join(F.broadcast(weights), "feature").select("feature", "bin", "woe", points.alias("points"))
    top = spark.createDataFrame([("basepoints", None, None, float(base))],
                                "feature string, bin string, woe double, points double")
    return top.unionByName(rows)


def apply_points(df: DataFrame, model: WoeModel, card: DataFrame, out: str = "score") -> DataFrame:
    """Sum of the base points and of each feature's bin points."""
    base = card.where(F.col("feature") == "basepoints").first()["points"]
    values = card.where(F.col("feature") != "basepoints").select("feature", "bin", F.col("points").alias("v"))
    scored = _append_lookup(df, model, values, "_points", True)
    names = [f"{f}_points" for f in [*model.edges, *model.text]]
    total = F.lit(float(base))
    for n in names:
        total = total + F.col(n)
    return scored.withColumn(out, total).drop(*names)


def fit_logistic_scorecard(df: DataFrame, label: str, numeric: Sequence[str], text: Sequence[str] = (),
                           bins: int = 10, c: float = 1.0) -> tuple[WoeModel, DataFrame]:
    """Bins, a logistic model on the evidence columns, and the points card."""
    model = fit_woe(df.where(F.col(label).isNotNull()), label, numeric, text, bins)
    features = [*numeric, *text]
    woe = model.transform(df.where(F.col(label).isNotNull()))
    data = VectorAssembler(inputCols=[f"{f}_woe" for f in features], outputCol="_v").transform(woe).select(
        "_v", F.col(label).cast("double").alias("_y"))
    n = data.count()
    fit = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=1.0 / (c * n),
                             standardization=False).fit(data)
    weights = dict(zip(features, [float(x) for x in fit.coefficients]))
    return model, scorecard_points(model.table, weights, float(fit.intercept))


# ---- probabilities and scores --------------------------------------------------------

def clip(x: Column, low: float, high: float) -> Column:
    """x limited to [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def prob_to_score(p: Column, base: float = BASE, pdo: float = PDO) -> Column:
    """round(base - pdo / ln 2 * log-odds), with p kept within [0.001, 0.999]."""
    q = clip(p, P_LOW, P_HIGH)
    return F.round(F.lit(base) - F.lit(pdo / math.log(2)) * F.log(q / (1 - q))).cast("int")


def score_to_prob(score: Column, base: float = 300.0, pdo: float = PDO) -> Column:
    odds = F.exp((score - F.lit(base)) / F.lit(pdo) * F.lit(math.log(2)))
    return odds / (odds + 1)


def band(score: Column, bands: Sequence[tuple[float, str]], rest: str) -> Column:
    """Name of the first band whose lower limit the score reaches."""
    e = F.lit(rest)
    for low, name in sorted(bands):
        e = F.when(score >= F.lit(low), F.lit(name)).otherwise(e)
    return F.when(score.isNotNull(), e)


# Names and lower limits of the risk bands.
BANDS_5 = [(800, "优秀"), (700, "良好"), (600, "一般"), (500, "风险")]
REST_5 = "高风险"
BANDS_6 = [(750, "极低风险"), (700, "低风险"), (650, "中等风险"), (600, "中高风险"), (550, "高风险")]
REST_6 = "极高风险"


def risk_band_5(score: Column) -> Column:
    return band(score, BANDS_5, REST_5)


def risk_band_6(score: Column) -> Column:
    return band(score, BANDS_6, REST_6)


# ---- tree leaves ---------------------------------------------------------------------

def leaf_scores(df: DataFrame, leaf: str, probability: str, base: float = BASE, pdo: float = PDO) -> DataFrame:
    """(leaf, probability, n, odds, score): mean probability and score of each leaf."""
    g = df.groupBy(F.col(leaf).alias("leaf")).agg(F.avg(probability).alias("_p"), F.count(F.lit(1)).alias("n"))
    p = clip(F.col("_p"), P_LOW, P_HIGH)
    return g.select("leaf", p.alias("probability"), "n", (p / (1 - p)).alias("odds"),
                    prob_to_score(F.col("_p"), base, pdo).alias("score"))


def apply_leaf(df: DataFrame, leaf: str, scores: DataFrame, out: str = "score") -> DataFrame:
    """Look up the leaf's score; an unknown leaf gets 300. Spark picks the join by the table's size."""
    table = scores.select(F.col("leaf").alias(leaf), F.col("score").alias("_s"))
    return df.join(table, leaf, "left").withColumn(
        out, F.coalesce("_s", F.lit(UNKNOWN_LEAF)).cast("int")).drop("_s")


def fit_leaf_logistic(trees, df: DataFrame, features: str, label: str, c: float = 0.1) -> PipelineModel:
    """Leaf numbers of a fitted tree ensemble, one-hot, into a logistic model (any ensemble works)."""
    n_trees = len(trees.trees)
    clean = trees.copy()
    clean.setLeafCol("_leaves")
    for name in ("predictionCol", "probabilityCol", "rawPredictionCol"):
        if clean.hasParam(name):
            clean.set(clean.getParam(name), f"_tree_{name}")
    n = df.count()
    names = [f"_leaf{i}" for i in range(n_trees)]
    hot = OneHotEncoder(inputCols=names, outputCols=[f"{x}_hot" for x in names], handleInvalid="keep", dropLast=False)
    vec = VectorAssembler(inputCols=[f"{x}_hot" for x in names], outputCol="_leaf_vector")
    lr = LogisticRegression(featuresCol="_leaf_vector", labelCol=label, regParam=1.0 / (c * n),
                            standardization=False, maxIter=200)
    leaves = PipelineModel([clean, LeafColumns(trees=n_trees)])
    fitted = Pipeline(stages=[hot, vec, lr]).fit(leaves.transform(df))
    return PipelineModel([*leaves.stages, *fitted.stages])


class LeafColumns(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """One column per tree from the vector of leaf numbers."""

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, trees=1):
        super().__init__()
        self._setDefault(trees=1)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        leaves = vector_to_array("_leaves")
        return df.withColumns({f"_leaf{i}": leaves[i] for i in range(self.getOrDefault(self.trees))})


def apply_leaf_logistic(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Append probability and score."""
    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(df.select("*", F.struct("*").alias("_row"))).withColumn("_p", p)
    return scored.select("_row.*", F.col("_p").alias("probability"), prob_to_score(F.col("_p")).alias("score"))


# ---- the weighted-bin card -----------------------------------------------------------

# Lower limits of the six bins and the share of the weight each is worth.
BIN_LOWS = [-math.inf, -1.0, -0.5, 0.0, 0.5, 1.0]
BIN_SHARES = [-0.5, -0.3, 0.0, 0.3, 0.5, 0.7]
CARD_BASE, CARD_LOW, CARD_HIGH, CARD_WEIGHT = 300.0, 0, 1000, 700.0


def importance_weights(importances: Mapping[str, float], total: float = CARD_WEIGHT) -> dict[str, float]:
    whole = sum(importances.values())
    return {f: v / whole * total for f, v in importances.items()}


def weighted_bins(spark, weights: Mapping[str, float]) -> DataFrame:
    """(feature, weight, low, high, score): six bins per feature."""
    highs = [*BIN_LOWS[1:], math.inf]
    rows = [(f, float(w), lo, hi, w * s) for f, w in weights.items()
            for lo, hi, s in zip(BIN_LOWS, highs, BIN_SHARES)]
    return spark.createDataFrame(rows, "feature string, weight double, low double, high double, score double")


def bin_score(x: Column, weight: float) -> Column:
    """Score of a value: bins are closed on the left; a missing value counts as 0."""
    v = F.coalesce(x.cast("double"), F.lit(0.0))
    e = F.lit(weight * BIN_SHARES[0])
    for low, share in zip(BIN_LOWS[1:], BIN_SHARES[1:]):
        e = F.when(v >= F.lit(low), F.lit(weight * share)).otherwise(e)
    return e


def _total(parts: list[Column], base: float) -> Column:
    total = F.lit(base)
    for p in parts:
        total = total + p
    return total


def apply_weighted_bins(df: DataFrame, weights: Mapping[str, float], out: str = "score") -> DataFrame:
    """300 plus the bin scores, cut to a whole number and kept within 0..1000."""
    total = _total([bin_score(F.col(f), w) for f, w in weights.items()], CARD_BASE)
    return df.withColumn(out, F.greatest(F.lit(CARD_LOW), F.least(F.lit(CARD_HIGH), total.cast("int"))))


def bin_contributions(df: DataFrame, keys: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """(keys, feature, value, score, total): one row per feature; total is neither cut nor limited."""
    total = _total([bin_score(F.col(f), w) for f, w in weights.items()], CARD_BASE)
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("value"),
                               bin_score(F.col(f), w).alias("score")) for f, w in weights.items()])
    return df.select(*keys, total.alias("total"), F.inline(parts))


# ---- the linear card -----------------------------------------------------------------

LINEAR_WEIGHT, LINEAR_LOW, LINEAR_HIGH = 100.0, 300, 850


def normalised(x: Column, reach: float = 3.0) -> Column:
    """x kept within [-reach, reach] and mapped to 0..100."""
    return (clip(x.cast("double"), -reach, reach) + F.lit(reach)) * F.lit(100.0) / F.lit(2 * reach)


def linear_score(df: DataFrame, weights: Mapping[str, float], out: str = "score", reach: float = 3.0,
                 scale: float = 1.0) -> DataFrame:
    """600 plus the weighted normalised values, cut to a whole number and kept within 300..850."""
    total = _total([normalised(F.col(f), reach) * F.lit(w * scale) for f, w in weights.items()], BASE)
    whole = total.cast("int")
    return df.withColumn(out, F.when(whole.isNotNull(), F.greatest(F.lit(LINEAR_LOW),
                                                                   F.least(F.lit(LINEAR_HIGH), whole))))


def linear_probability(score: Column, base: float = BASE, pdo: float = PDO) -> dict[str, Column]:
    """log_odds, probability and class of a linear score."""
    log_odds = (score - F.lit(base)) / F.lit(pdo) * F.lit(math.log(2))
    odds = F.exp(log_odds)
    p = clip(odds / (odds + 1), P_LOW, P_HIGH)
    return {"log_odds": log_odds, "probability": p, "predicted": F.when(p > 0.5, 1).otherwise(0)}


def linear_contributions(df: DataFrame, keys: Sequence[str], weights: Mapping[str, float],
                         reach: float = 3.0) -> DataFrame:
    """(keys, feature, value, normalised, weight, contribution, total)."""
    total = _total([normalised(F.col(f), reach) * F.lit(w) for f, w in weights.items()], BASE)
    parts = F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), normalised(F.col(f), reach).alias("normalised"),
        F.lit(float(w)).alias("weight"), (normalised(F.col(f), reach) * F.lit(w)).alias("contribution"))
        for f, w in weights.items()])
    return df.select(*keys, total.alias("total"), F.inline(parts))


def score_statistics(df: DataFrame, score: str) -> DataFrame:
    """One row: min, max, mean and population deviation of a score."""
    return df.agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"),
                  F.avg(score).alias("avg_score"), F.stddev_pop(score).alias("std_score"))
