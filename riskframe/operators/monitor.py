"""Drift and performance monitoring of scored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.expr import drop_nan, long_form, null_safe
from riskframe.operators.clean import split_by_type
from riskframe.operators.evaluate import auc_ks, binary_metrics
from riskframe.operators.ordering import running_totals

# Metrics that are better when smaller.
LOWER_IS_BETTER = ["mse", "rmse", "mae", "mape"]
KS_EXACT = 10_000


# ---- performance ---------------------------------------------------------------------

def performance(df: DataFrame, label: str, prediction: str, probability: str,
                by: Sequence[str] = ("model_name",)) -> DataFrame:
    """(by, n, positive_rate, predicted_positive_rate, accuracy, precision, recall, auc); AUC is NULL without scores."""
    by = list(by)
    return null_safe(binary_metrics(df, label, prediction, by), auc_ks(df, label, probability, by).select(*by, "auc"), by, "left")


def alerts(metrics: DataFrame, thresholds: Mapping[str, float], by: Sequence[str] = ("model_name",),
           severity: str = "warning") -> DataFrame:
    """(by, metric, value, threshold, severity) of each metric on the wrong side of its limit."""
    parts = []
    for name, limit in thresholds.items():
        if name in metrics.columns:
            value = F.col(name).cast("double")
            bad = value > limit if name in LOWER_IS_BETTER else value < limit
            parts.append(F.when(bad, F.struct(F.lit(name).alias("metric"), value.alias("value"),
                                              F.lit(float(limit)).alias("threshold"),
                                              F.lit(severity).alias("severity"))))
    if not parts:
        raise ValueError("none of the limited metrics is in the table")
    return metrics.select(*by, F.inline(F.array_compact(F.array(*parts))))


# ---- drift ---------------------------------------------------------------------------

def drift_ks(current: DataFrame, reference: DataFrame, cols: Sequence[str] | None = None,
             threshold: float = 0.05, method: str = "asymptotic") -> DataFrame:
    """(feature, n_current, n_reference, ks_statistic, p_value, drift) for numeric columns of both tables.

    ``method``: "asymptotic", or "auto", the exact p-value of a continuous distribution where neither side has more than KS_EXACT values.
    """
    if method not in ("asymptotic", "auto"):
        raise ValueError(f"unknown method {method!r}")
    if cols is None:
        cols = [c for c in split_by_type(current, current.columns)[0] if c in reference.columns]
    sides = [long_form(drop_nan(t, cols), cols).withColumn("_side", F.lit(i))
             for i, t in enumerate((current, reference))]
    rows = sides[0].unionByName(sides[1])
    totals = running_totals(rows, ["feature"], "x", {"cur": (F.col("_side") == 0).cast("long"),
                                                     "ref": (F.col("_side") == 1).cast("long")})
    gap = F.abs(F.try_divide(F.col("cur_cum"), F.col("cur_all")) - F.try_divide(F.col("ref_cum"), F.col("ref_all")))
    d = totals.groupBy("feature").agg(F.max("cur_all").alias("n_current"), F.max("ref_all").alias("n_reference"),
                                      F.max(gap).alias("ks_statistic"))
    n, m = F.col("n_current").cast("double"), F.col("n_reference").cast("double")
    p = kolmogorov_p(F.col("ks_statistic") * F.sqrt(F.try_divide(n * m, n + m)))
    if method == "auto":
        small = (F.greatest("n_current", "n_reference") <= KS_EXACT) & (F.least("n_current", "n_reference") > 0)
        fits = [F.when(small, F.col(c)) for c in ("ks_statistic", "n_current", "n_reference")]
        p = F.when(small, exact_ks_p(*fits)).otherwise(p)  # a row a feature: two long arrays in a task's Python, whatever the rows
    return d.withColumn("p_value", p).withColumn("drift", F.coalesce(F.col("p_value") < threshold, F.lit(False)))


def ks_tail(d: float, n: int, m: int) -> float:
    """The share of orders of n and m values in which the distribution functions come as far apart as ``d``.

    An order is a path on a lattice; the share of paths to a point that stayed inside the band follows from the two points before it. Points of
    one diagonal are taken together.
    """
    far, i = round(d * n * m), np.arange(n + 1)
    inside = (i == 0).astype(float)
    if far <= 0:
        return 1.0
    for s in range(1, n + m + 1):
        j = s - i
        step = inside * j / s
        step[1:] += inside[:-1] * i[1:] / s
        inside = np.where((j >= 0) & (j <= m) & (np.abs(i * m - j * n) < far), step, 0.0)
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


@F.pandas_udf(T.DoubleType())
def exact_ks_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """``ks_tail`` of rows without NULL; called once a feature, not once a row."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) or pd.isna(c) else ks_tail(a, int(min(b, c)), int(max(b, c))) for a, b, c in zip(d, n, m, strict=True)],
                     dtype="float64")


def kolmogorov_p(x: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value; the series needs no more than 100 terms above 0.2, where it is 1."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, F.lit(1.0)).when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution; called once per feature, not per row."""
    from math import exp, lgamma, log

    def tail(x: float, k: float) -> float:
        if not np.isfinite(x) or not np.isfinite(k) or k < 1:
            return np.nan
        if x <= 0:
            return 1.0
        a, x = k / 2.0, x / 2.0
        front = exp(a * log(x) - x - lgamma(a))
        if x < a + 1:  # series of the lower tail
            term = total = 1.0 / a
            n = a
            while term > total * 1e-16:
                n += 1
                term *= x / n
                total += term
            return max(0.0, 1.0 - total * front)
        b = x + 1 - a  # continued fraction of the upper tail
        c, d = 1e300, 1.0 / b
        h = d
        for i in range(1, 10_000):
            an = -i * (i - a)
            b += 2
            d = 1.0 / (an * d + b)
            c = b + an / c
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * h

    return pd.Series([tail(float(s), float(k)) if s is not None and k is not None else np.nan
                      for s, k in zip(stat, dof)])


def drift_chi2(current: DataFrame, reference: DataFrame, cols: Sequence[str] | None = None,
               threshold: float = 0.05) -> DataFrame:
    """(feature, chi2_statistic, dof, unseen, p_value, drift) for text columns of both tables.

    Reference counts are scaled to the current total. A category the reference does not
    have cannot enter the statistic; it is counted in ``unseen`` and is drift by itself.
    """
    if cols is None:
        cols = [f.name for f in current.schema if isinstance(f.dataType, T.StringType)
                and f.name in reference.columns]
    sides = [long_form(t, cols, as_type="string").withColumn("_side", F.lit(i))
             for i, t in enumerate((current, reference))]
    cells = (sides[0].unionByName(sides[1]).where(F.col("x").isNotNull()).groupBy("feature", "x")
             .agg(F.count_if(F.col("_side") == 0).alias("o"), F.count_if(F.col("_side") == 1).alias("r")))
    totals = cells.groupBy("feature").agg(F.sum("o").alias("_o"), F.sum("r").alias("_r"))
    e = F.try_divide(F.col("r").cast("double") * F.col("_o"), F.col("_r").cast("double"))
    part = F.when(F.col("r") > 0, F.try_divide((F.col("o") - e) * (F.col("o") - e), e))
    stat = cells.join(F.broadcast(totals), "feature").groupBy("feature").agg(
        F.sum(part).alias("chi2_statistic"), (F.count_if(F.col("r") > 0) - 1).alias("dof"),
        F.count_if((F.col("r") == 0) & (F.col("o") > 0)).alias("unseen"))
    p = F.when(F.col("dof") > 0, chi_square_tail(F.coalesce("chi2_statistic", F.lit(0.0)), F.col("dof").cast("double")))
    return stat.withColumn("p_value", p).withColumn(
        "drift", F.coalesce(F.col("p_value") < threshold, F.lit(False)) | (F.col("unseen") > 0))


def drift_summary(*tables: DataFrame) -> DataFrame:
    """One row: is there drift, in how many and in which features (sorted, comma separated)."""
    rows = None
    for t in tables:
        part = t.select("feature", "drift")
        rows = part if rows is None else rows.unionByName(part)
    names = F.sort_array(F.collect_list(F.when(F.col("drift"), F.col("feature"))))  # bounded by the schema
    return rows.agg(F.coalesce(F.bool_or("drift"), F.lit(False)).alias("drift_detected"),
                    F.count_if("drift").alias("n_drifted"), F.array_join(names, ",").alias("drifted_features"))


# ---- reports over the logs -----------------------------------------------------------

def since(df: DataFrame, ts: str, now: datetime, days: int) -> DataFrame:
    """Records newer than ``days`` days before ``now`` (strictly)."""
    return df.where(F.col(ts) > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def monitoring_report(predictions: DataFrame, drifts: DataFrame, now: datetime, days: int = 7,
                      ts: str = "timestamp", probabilities: str = "probabilities") -> DataFrame:
    """One row: predictions, their mean first probability (0 where empty), drift records and detections."""
    first = F.coalesce(F.try_element_at(F.col(probabilities), F.lit(1)), F.lit(0.0))
    p = since(predictions, ts, now, days).agg(F.count(F.lit(1)).alias("total_predictions"),
                                              F.avg(first).alias("avg_probability"), F.lit(1).alias("_k"))
    d = since(drifts, ts, now, days).agg(F.count(F.lit(1)).alias("drift_records"),
                                         F.count_if("drift_detected").alias("drift_events_count"), F.lit(1).alias("_k"))
    return p.join(d, "_k").drop("_k").withColumn("report_period_days", F.lit(days))


def performance_trend(log: DataFrame, now: datetime, days: int = 7, ts: str = "timestamp") -> DataFrame:
    return since(log, ts, now, days)


def latest_alerts(performance_log: DataFrame, drift_log: DataFrame, ts: str = "timestamp") -> DataFrame:
    """(type, metric, value, threshold, severity, drifted_features): alerts of the newest records."""
    newest = performance_log.agg(F.max_by("alerts", ts).alias("a"))
    perf = newest.select(F.inline("a")).select(
        F.lit("performance").alias("type"), "metric", "value", "threshold", "severity",
        F.lit(None).cast("string").alias("drifted_features"))
    last = drift_log.agg(F.max_by(F.struct("drift_detected", "drifted_features"), ts).alias("d")).select("d.*")
    drift = last.where("drift_detected").select(
        F.lit("data_drift").alias("type"), F.lit(None).cast("string").alias("metric"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"),
        F.lit("warning").alias("severity"), F.array_join("drifted_features", ",").alias("drifted_features"))
    return perf.unionByName(drift)
