"""Model families as Spark ML estimators, training pipelines and class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import forest, sampling
from riskframe.operators.neighbours import smote
from riskframe.operators.preprocess import TabularPreprocessor, TabularPreprocessorModel
from riskframe.sources.lineage import checkpointed

CLASSIFIERS = ["LR", "XGB", "RF", "LGB", "DT"]
BOOSTERS = ["XGB", "LGB", "XGB_REG", "LGB_REG"]
REGRESSORS = ["RIDGE", "XGB_REG", "RF_REG", "LGB_REG"]
FEW_ROWS = 250_000  # boosters fit tables up to this size row by row
DEEPEST = 30  # Spark's limit for trees; forests without a depth are grown by operators/forest

# Settings of each family besides those with a default. What the estimators have no counterpart for (the boosters' L1 and L2
# penalties and bagging frequency, a least size for splits of trees with a depth, a choice of ridge solver) is refused, not ignored.
MORE_SETTINGS: dict[str, list[str]] = {
    "XGB": ["min_child_weight", "colsample_bytree", "gamma"],
    "XGB_REG": ["min_child_weight", "colsample_bytree", "gamma"],
    "RF": ["max_features", "bootstrap", "min_samples_split"], "RF_REG": ["max_features", "bootstrap", "min_samples_split"],
    "LGB": ["feature_fraction", "min_split_gain"], "LGB_REG": ["feature_fraction", "min_split_gain"],
}

# Default settings per family.
DEFAULTS: dict[str, dict] = {
    "LR": {"C": 1.0, "penalty": "l2", "max_iter": 5000, "tol": 1e-4, "class_weight": "balanced"},
    "XGB": {"n_estimators": 1000, "learning_rate": 0.1, "max_depth": 6, "subsample": 1.0},
    "RF": {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1, "class_weight": "balanced"},
    "LGB": {"n_estimators": 1000, "learning_rate": 0.1, "num_leaves": 31, "bagging_fraction": 1.0,
            "min_child_samples": 20, "class_weight": "balanced"},
    "DT": {"max_depth": 3, "min_samples_leaf": 1},
    "RIDGE": {"alpha": 1.0},
    "XGB_REG": {"n_estimators": 1000, "learning_rate": 0.1, "max_depth": 6, "subsample": 1.0},
    "RF_REG": {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1},
    "LGB_REG": {"n_estimators": 1000, "learning_rate": 0.1, "num_leaves": 31, "bagging_fraction": 1.0,
                "min_child_samples": 20},
}


def task_of(code: str) -> str:
    if code in CLASSIFIERS:
        return "classification"
    if code in REGRESSORS:
        return "regression"
    raise ValueError(f"unknown model family {code!r}")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Append the balanced weight n / (classes * n_class); the counts are inlined as constants."""
    counts = sampling.class_counts(df, label)  # rows without a label get no weight
    n, k = sum(counts.values()), len(counts)
    w = F.lit(None).cast("double")
    for c, m in counts.items():
        w = F.when(F.col(label) == F.lit(c), F.lit(n / (k * m))).otherwise(w)
    return df.withColumn(out, w)


def make_estimator(code: str, n_rows: int, label_std: float = 1.0, features: str = "features",
                   label: str = "label", weight: str | None = None, validation: str | None = None,
                   seed: int = 42, max_bins: int = 64, **params) -> Estimator:
    """The Spark ML counterpart of a family with its settings.

    Penalties are rescaled because Spark divides the loss by the number of rows, and for
    linear regression also scales the label.
    """
    unknown = set(params) - set(DEFAULTS[code]) - set(MORE_SETTINGS.get(code, ()))
    if unknown:
        raise ValueError(f"{code} has no settings {sorted(unknown)}")
    p = {**DEFAULTS[code], **{k: v for k, v in params.items() if v is not None}}
    if (p.get("max_depth") or 0) > DEEPEST:
        raise ValueError(f"trees can be {DEEPEST} deep at most, not {p['max_depth']}")
    common = {"featuresCol": features, "labelCol": label}
    if weight:
        common["weightCol"] = weight
    if code == "LR":
        return LogisticRegression(regParam=1.0 / (p["C"] * n_rows), elasticNetParam=1.0 if p["penalty"] == "l1" else 0.0,
                                  standardization=False, maxIter=p["max_iter"], tol=p["tol"], **common)
    if code == "RIDGE":
        return LinearRegression(regParam=p["alpha"] * label_std / n_rows, elasticNetParam=0.0, standardization=False,
                                solver="normal", **common)
    trees = {"seed": seed, "maxBins": max_bins, "cacheNodeIds": False, **common}
    if code == "DT":
        return DecisionTreeClassifier(maxDepth=p["max_depth"],
                                      minInstancesPerNode=p["min_samples_leaf"], **trees)
    if code in ("RF", "RF_REG") and p["max_depth"] is None:
        more = {k: p[k] for k in ("max_features", "bootstrap") if k in p}
        settings = forest.Settings("classification" if code == "RF" else "regression", p["n_estimators"], min_samples_leaf=p["min_samples_leaf"],
                                   min_samples_split=p.get("min_samples_split", 2), seed=seed, **more)
        return forest.Forest(settings=settings, weightCol=weight, featuresCol=features, labelCol=label)
    if "min_samples_split" in p:
        raise ValueError("a least size for splits needs trees without a depth")
    if code in ("RF", "RF_REG"):
        kind = RandomForestClassifier if code == "RF" else RandomForestRegressor
        extra = {k: v for k, v in (("featureSubsetStrategy", p.get("max_features")), ("bootstrap", p.get("bootstrap")))
                 if v is not None}
        return kind(numTrees=p["n_estimators"], maxDepth=p["max_depth"],
                    minInstancesPerNode=p["min_samples_leaf"], **extra, **trees)
    kind = GBTRegressor if code.endswith("_REG") else GBTClassifier
    if code.startswith("LGB"):
        depth = max(1, min(DEEPEST, (p["num_leaves"] - 1).bit_length()))  # about as many leaves
        share, least = p["bagging_fraction"], p["min_child_samples"]
        columns, gain = p.get("feature_fraction", 1.0), p.get("min_split_gain", 0.0)
    else:
        depth, share, least = p["max_depth"], p["subsample"], max(1, int(p.get("min_child_weight", 1)))
        columns, gain = p.get("colsample_bytree", 1.0), p.get("gamma", 0.0)
    booster = kind(maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=depth, subsamplingRate=share,
                   minInstancesPerNode=least, featureSubsetStrategy="all" if columns >= 1 else str(float(columns)),
                   minInfoGain=float(gain), **trees)
    if validation:
        booster = booster.setValidationIndicatorCol(validation)
    return booster


SAMPLERS = ["none", "random_over", "random_under", "smote"]


def resample(df: DataFrame, method: str | None, key: str, label: str, features: Sequence[str],
             seed: int = 42) -> DataFrame:
    """Balance the classes of a preprocessed training table."""
    if method in (None, "none"):
        return df
    if method == "random_over":
        return sampling.over_sample(df, [key], label, seed).drop("copy")
    if method == "random_under":
        return sampling.under_sample(df, [key], label, seed)
    if method == "smote":  # the neighbour search must not run again for every use of the table
        return checkpointed(smote(df, key, label, features, seed=seed).drop("copy"))
    raise ValueError(f"unknown sampler {method!r}; choose one of {SAMPLERS}")


@dataclass
class Prepared:
    """A training table after preprocessing, balancing and weighting, ready for any estimator."""

    prep: TabularPreprocessorModel
    assembler: VectorAssembler
    data: DataFrame  # features, label and, if used, _weight and is_validation
    n_rows: int
    label_std: float
    max_bins: int
    weight: str | None
    validation: str | None

    def collapsed(self, code: str, **params) -> Prepared:
        """With one weighted row for each different feature vector, if a boosted regression of least squares cannot tell the difference.

        Sums of squares around means fall by the same amount with every split, whether or not rows of equal features, which no split parts, are
        replaced by their mean label; so do residuals, which are linear in it. It takes that all rows and features are used and that a leaf may hold
        a single row; and it is done for large tables only, where at least half the rows repeat their features.
        """
        p = {**DEFAULTS[code], **{k: v for k, v in params.items() if v is not None}}
        shares = [p.get(c, 1.0) for c in ("subsample", "bagging_fraction", "colsample_bytree", "feature_fraction")]
        least = p.get("min_child_samples", p.get("min_child_weight", 1))
        if code not in BOOSTERS or task_of(code) != "regression" or self.validation or self.weight or min(shares) < 1 or least >= 2:
            return self
        x = vector_to_array("features")
        about = self.data.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(x)).alias("distinct")).first()
        if about["n"] <= FEW_ROWS or about["distinct"] > about["n"] // 2:
            return self
        cells = self.data.groupBy(x.alias("x")).agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("_weight"))
        return replace(self, data=cells.select(array_to_vector("x").alias("features"), "label", "_weight"), weight="_weight")

    def fit(self, code: str, seed: int = 42, **params) -> PipelineModel:
        """One model that scores raw tables; balancing is not part of it."""
        settings = {k: v for k, v in params.items() if k != "class_weight"}
        estimator = make_estimator(code, self.n_rows, self.label_std, weight=self.weight, validation=self.validation,
                                   seed=seed, max_bins=self.max_bins, **settings)
        return PipelineModel([self.prep, self.assembler, estimator.fit(self.data)])


def prepare(df: DataFrame, label: str, code: str, numeric: Sequence[str], text: Sequence[str] = (),
            key: str | None = None, sampler: str | None = None, early_stopping: bool = False, seed: int = 42,
            preprocess: Mapping | None = None, class_weight: str | None = "default") -> Prepared:
    """Fit the preprocessing, then balance the training rows only, then weight the classes."""
    task = task_of(code)
    balance = sampler not in (None, "none")
    if balance and task == "regression":
        raise ValueError("samplers need a classification target")
    if (balance or early_stopping) and key is None:
        raise ValueError("samplers and early stopping need the row key")
    df = df.where(F.col(label).isNotNull())
    prep = TabularPreprocessor(numericCols=list(numeric), categoricalCols=list(text), family=code,
                               **(preprocess or {})).fit(df)
    features = list(prep.outputs())
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    ready = prep.transform(df)
    validation = None
    if early_stopping and code in BOOSTERS:
        validation = "is_validation"
        ready = sampling.with_validation(ready, [key], label if task == "classification" else None, seed=seed)
    if validation and balance:
        held = ready.where(validation).select(*features, label).withColumn(validation, F.lit(True))
        fit_rows = resample(ready.where(~F.col(validation)), sampler, key, label, features, seed)
        ready = fit_rows.select(*features, label).withColumn(validation, F.lit(False)).unionByName(held)
    else:
        ready = resample(ready, sampler, key, label, features, seed)
    weight = None
    if (DEFAULTS[code].get("class_weight") if class_weight == "default" else class_weight) == "balanced":
        weight = "_weight"
        ready = class_weights(ready, label, weight)
    n_rows, label_std = 1, 1.0
    if code in ("LR", "RIDGE"):  # only these rescale their penalty
        row = ready.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col(label).cast("double")).alias("s")).first()
        n_rows, label_std = row["n"], row["s"] or 1.0
    data = assembler.transform(ready).select(
        "features", F.col(label).cast("double").alias("label"), *([weight] if weight else []),
        *([validation] if validation else []))
    widest = max((len(s["cats"]) + 2 for s in prep.parameters["categorical"]), default=0)
    return Prepared(prep, assembler, data, n_rows, label_std, max(64, widest), weight, validation)


def train(df: DataFrame, label: str, code: str, numeric: Sequence[str], text: Sequence[str] = (),
          key: str | None = None, sampler: str | None = None, early_stopping: bool = False, seed: int = 42,
          preprocess: Mapping | None = None, **params) -> PipelineModel:
    """Preprocess, balance and fit one model.

    The needed columns are cached (on disk, if memory is short) while parameters are learnt,
    and the prepared table while the model is fitted.
    """
    keyed = key and (early_stopping or sampler not in (None, "none"))  # nothing else looks at the key
    table = df.select(*dict.fromkeys([label, *numeric, *text, *([key] if keyed else [])])).persist()
    try:
        ready = prepare(table, label, code, numeric, text, key, sampler, early_stopping, seed, preprocess,
                        params.get("class_weight", "default"))
        ready = ready.collapsed(code, **params)
        ready.data.persist()
        try:
            return ready.fit(code, seed, **params)
        finally:
            ready.data.unpersist()
    finally:
        table.unpersist()


def importances(model: PipelineModel) -> dict[str, float]:
    """Feature -> importance of a trained pipeline: split gains or absolute coefficients."""
    prep, last = model.stages[0], model.stages[-1]
    names = list(prep.outputs())
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = abs(last.coefficients.toArray())
    return {n: float(v) for n, v in zip(names, values)}

