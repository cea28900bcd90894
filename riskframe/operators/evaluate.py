"""Model evaluation as exact distributed aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.expr import drop_nan, null_safe, ratio
from riskframe.operators.ordering import running_totals


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


# ---- class predictions ---------------------------------------------------------------

def confusion_matrix(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """(label, prediction, n), rows are the truth. Numeric classes are whole numbers, all others stay text."""
    numbers = all(isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)) for c in (label, prediction))
    kind = "int" if numbers else "string"
    return df.groupBy(*by, F.col(label).cast(kind).alias("label"),
                      F.col(prediction).cast(kind).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def _per_class(cm: DataFrame, by: Sequence[str]) -> DataFrame:
    """precision, recall, f1 and support per class, from a confusion matrix."""
    by = list(by)
    # every cell counts once for its true class and once for its predicted class
    sides = cm.select(*by, F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))))
    t = sides.groupBy(*by, "class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                                        F.sum("tp").alias("tp"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    t = t.withColumns({"precision": _or_zero(p), "recall": _or_zero(r)})
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return t.withColumn("f1", _or_zero(f1))


def _averages(per: DataFrame, by: Sequence[str]) -> DataFrame:
    w = lambda m: ratio(F.sum(F.col(m) * F.col("support")), F.sum("support"))
    grouped = per.groupBy(*by) if by else per.groupBy()
    return grouped.agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[w(m).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"))


def weighted_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """accuracy and support-weighted precision, recall, F1."""
    avg = _averages(_per_class(confusion_matrix(df, label, prediction, by), by), by)
    return avg.select(*by, "accuracy", F.col("weighted_precision").alias("precision"),
                      F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1"))


def report_from_matrix(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(class, precision, recall, f1, support): one row per class, accuracy, macro and weighted rows."""
    by = list(by)
    per = _per_class(cm, by)
    avg = _averages(per, by)
    total = F.col("support")
    lines = avg.select(*by, F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.col("accuracy").alias("precision"),
                 F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"), total.alias("support")),
        *[F.struct(F.lit(f"{kind} avg").alias("class"), F.col(f"{kind}_precision").alias("precision"),
                   F.col(f"{kind}_recall").alias("recall"), F.col(f"{kind}_f1").alias("f1"), total.alias("support"))
          for kind in ("macro", "weighted")])))
    return per.select(*by, F.col("class").cast("string").alias("class"), "precision", "recall", "f1",
                      "support").unionByName(lines)


def classification_report(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    return report_from_matrix(confusion_matrix(df, label, prediction, by), by)


def binary_counts(label: str, prediction: str) -> list[Column]:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return [F.count(F.lit(1)).alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
            F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]


def binary_rates() -> dict[str, Column]:
    """Metrics as expressions over n, tp, fp, fn, tn; a zero division gives 0."""
    c = F.col
    return {
        "positive_rate": ratio(c("tp") + c("fn"), c("n")),
        "predicted_positive_rate": ratio(c("tp") + c("fp"), c("n")),
        "accuracy": ratio(c("tp") + c("tn"), c("n")),
        "precision": _or_zero(ratio(c("tp"), c("tp") + c("fp"))),
        "recall": _or_zero(ratio(c("tp"), c("tp") + c("fn"))),
    }


def binary_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    grouped = df.groupBy(*by).agg(*binary_counts(label, prediction))
    return grouped.select(*by, "n", *[e.alias(n) for n, e in binary_rates().items()])


# ---- scores --------------------------------------------------------------------------

def score_steps(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives and negatives at, up to and in all of the group; a NaN score is missing."""
    rows = drop_nan(df, [score]).where(F.col(label).isNotNull() & F.col(score).isNotNull())
    y = (F.col(label) == 1).cast("long")
    return running_totals(rows, by, score, {"pos": y, "neg": 1 - y})


def _above(name: str, inclusive: bool) -> Column:
    up_to = F.col(f"{name}_cum") - (F.col(name) if inclusive else F.lit(0))
    return F.col(f"{name}_all") - up_to


def auc_ks(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact AUC (ties count half) and KS in one pass over the distinct scores; NULL for a single class."""
    s = score_steps(df, label, score, by)
    tpr, fpr = ratio(_above("pos", True), F.col("pos_all")), ratio(_above("neg", True), F.col("neg_all"))
    pairs = F.col("neg").cast("double") * (_above("pos", False) + F.col("pos") / 2)
    grouped = s.groupBy(*by) if by else s.groupBy()
    out = grouped.agg(F.sum(pairs).alias("_pairs"), F.max("pos_all").alias("_p"), F.max("neg_all").alias("_n"),
                      F.max(tpr - fpr).alias("_ks"))
    auc = F.try_divide(F.col("_pairs"), F.col("_p").cast("double") * F.col("_n"))
    ks = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.greatest(F.lit(0.0), F.col("_ks")))
    return out.select(*by, auc.alias("auc"), ks.alias("ks"))


def roc_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, tpr, fpr): one point per distinct score and the starting point (0, 0)."""
    s = score_steps(df, label, score, by)
    points = s.select(*by, F.col(score).cast("double").alias("threshold"),
                      ratio(_above("pos", True), F.col("pos_all")).alias("tpr"),
                      ratio(_above("neg", True), F.col("neg_all")).alias("fpr"))
    start = (df.select(*by).distinct() if by else df.limit(1).select()).select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return points.unionByName(start)


def ks_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """The ROC points with their distance."""
    return roc_curve(df, label, score, by).withColumn("distance", F.col("tpr") - F.col("fpr"))


def ks_threshold(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(ks, threshold): the largest distance and the highest score that reaches it."""
    c = ks_curve(df, label, score, by)
    grouped = c.groupBy(*by) if by else c.groupBy()
    best = grouped.agg(F.max(F.struct(F.round("distance", 12).alias("d"), F.col("threshold"))).alias("_b"))
    return best.select(*by, F.col("_b.d").alias("ks"), F.col("_b.threshold").alias("threshold"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall steps: the sum of precision times the gain in recall."""
    s = score_steps(df, label, score, by)
    precision = ratio(_above("pos", True), _above("pos", True) + _above("neg", True))
    grouped = s.groupBy(*by) if by else s.groupBy()
    return grouped.agg(F.sum(precision * ratio(F.col("pos"), F.col("pos_all"))).alias("auc_pr"))


def score_histogram(df: DataFrame, score: str, bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """(bin, low, high, n) over [0, 1]; empty bins are present, the last bin is closed."""
    inside = drop_nan(df, [score]).where((F.col(score) >= 0) & (F.col(score) <= 1))
    number = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*by, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = frame.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return null_safe(every, counts, [*by, "bin"], "left").select(
        *by, "bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---- regression ----------------------------------------------------------------------

# Fixed value: the smallest double step above 1, the floor of the MAPE denominator.
EPSILON = 2.220446049250313e-16


def regression_metrics(df: DataFrame, target: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae, r2 and mape (as a fraction); r2 is NULL for a constant target."""
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    err = y - p
    grouped = df.groupBy(*by) if by else df.groupBy()
    g = grouped.agg(F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop(y).alias("_v"),
                    F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"))
    return g.select(*by, "mse", F.sqrt("mse").alias("rmse"), "mae",
                    (1 - F.try_divide(F.col("mse"), F.col("_v"))).alias("r2"), "mape")


def error_histogram(df: DataFrame, target: str, prediction: str, bins: int = 19) -> DataFrame:
    """(bin, low, high, n, percent) of the absolute error on [0, max]."""
    err = F.abs(F.col(target).cast("double") - F.col(prediction).cast("double"))
    row = df.agg(F.max(err).alias("m"), F.count(err).alias("n")).first()
    top, total = row["m"], row["n"]
    spark = df.sparkSession
    if not top:
        return spark.createDataFrame([(0, 0.0, 0.0, total, 100.0)] if total else [],
                                     "bin int, low double, high double, n long, percent double")
    number = F.least(F.floor(err * bins / F.lit(top)), F.lit(bins - 1)).cast("int")
    counts = df.where(err.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return every.join(counts, "bin", "left").select(
        "bin", (F.col("bin") * F.lit(top) / bins).alias("low"), ((F.col("bin") + 1) * F.lit(top) / bins).alias("high"),
        n.alias("n"), (n * 100.0 / F.lit(total)).alias("percent"))


# ---- bundles and comparisons ---------------------------------------------------------

def evaluate_bundle(df: DataFrame, task: str, label: str, prediction: str, probability: str | None = None,
                    split: str = "split") -> DataFrame:
    """All metrics of the task per split (train and test rows in one table), in long form."""
    if task == "regression":
        wide = regression_metrics(df, label, prediction, [split])
        names = ["mse", "rmse", "mae", "r2", "mape"]
    else:
        wide = weighted_metrics(df, label, prediction, [split])
        names = ["accuracy", "precision", "recall", "f1"]
        if probability:
            wide = null_safe(wide, auc_ks(df, label, probability, [split]), [split], "left")
            names += ["auc", "ks"]
    return wide.select(split, F.lit(task).alias("task_type"),
                       *names).unpivot([split, "task_type"], names, "metric", "value")


def compare_models(results: DataFrame, metric: str = "auc", ties: Sequence[str] = ("model_name",)) -> DataFrame:
    """Results sorted by the metric, largest first; ties go by name. One row per model."""
    return results.orderBy(F.col(metric).desc_nulls_last(), *ties)


def compare_runs(runs: DataFrame, task: str = "classification") -> DataFrame:
    """(data_name, imbalance_method, model_name, task_type, metrics...) of stored result documents.

    A missing metric counts as 0; rows are ordered by the main metric, then by the names.
    """
    names = ["accuracy", "precision", "recall", "f1", "auc", "ks"] if task == "classification" else [
        "mse", "rmse", "mae", "r2"]
    test = "evaluation_results.metrics.test_metrics"
    fields = runs.select(f"{test}.*").columns
    ev = "evaluation_results"
    rows = runs.select(
        F.col(f"{ev}.data_name").alias("data_name"), F.col(f"{ev}.imbalance_method").alias("imbalance_method"),
        F.col(f"{ev}.model_name").alias("model_name"), F.lit(task).alias("task_type"),
        *[(F.coalesce(F.col(f"{test}.{m}"), F.lit(0.0)) if m in fields else F.lit(0.0)).cast("double").alias(m)
          for m in names])
    return rows.orderBy(F.col("auc" if task == "classification" else "r2").desc(), "data_name", "imbalance_method",
                        "model_name")


def runs_summary(rows: DataFrame, metric: str = "auc") -> DataFrame:
    """One row: how many runs, which is best, and how many data sets, samplers and models."""
    # smallest struct = largest metric, then first by name
    best = F.min(F.struct((-F.col(metric)).alias("m"), "data_name", "imbalance_method", "model_name"))
    return rows.agg(F.count(F.lit(1)).alias("n_runs"), best.alias("_b"), F.count_distinct("data_name").alias("n_data"),
                    F.count_distinct("imbalance_method").alias("n_samplers"),
                    F.count_distinct("model_name").alias("n_models")).select(
        "n_runs", "n_data", "n_samplers", "n_models", F.col("_b.data_name").alias("best_data"),
        F.col("_b.imbalance_method").alias("best_sampler"), F.col("_b.model_name").alias("best_model"),
        (-F.col("_b.m")).alias(f"best_{metric}"))


def batch_summary(jobs: DataFrame, status: str = "status") -> DataFrame:
    """One row: jobs in all, succeeded, failed, and the share that succeeded."""
    ok = F.count_if(F.col(status) == "success")
    n = F.count(F.lit(1))
    return jobs.agg(n.alias("total"), ok.alias("succeeded"), (n - ok).alias("failed"),
                    ratio(ok, n).alias("success_rate"))


def best_model(results: DataFrame, metric: str, name: str = "model_name") -> DataFrame:
    """One row: the name with the largest metric, the first one on a tie."""
    b = results.agg(F.min(F.struct((-F.col(metric)).alias("m"), F.col(name).alias("n"))).alias("_b"))
    return b.select(F.col("_b.n").alias(name), (-F.col("_b.m")).alias(metric))


def importance_table(importances: DataFrame, total_weight: float = 700.0) -> DataFrame:
    """(feature, importance, ratio, weight) from (feature, importance); one row per feature."""
    total = importances.agg(F.sum("importance").alias("_t"), F.lit(1).alias("_k"))
    j = importances.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")
    share = ratio(F.col("importance"), F.col("_t"))
    return j.select("feature", "importance", share.alias("ratio"), (share * total_weight).alias("weight")).orderBy(
        F.col("importance").desc(), "feature")
