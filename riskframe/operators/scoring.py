"""Batch scoring of a table with a fitted model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.profile import check_input, check_schema


def predict(model, df: DataFrame, features: Sequence[str] | None = None, task: str = "classification") -> DataFrame:
    """Append ``prediction`` and, for classifiers, ``probability`` of class 1.

    A missing feature fails here, before any job starts, and so does a batch table without rows.
    """
    if features is not None:
        (check_schema if df.isStreaming else check_input)(df, features)
    # the model replaces columns by their encoded form; the table's own columns travel beside them
    scored = model.transform(df.select("*", F.struct("*").alias("_row")))
    if task == "regression":
        return scored.select("_row.*", "prediction")
    return scored.select("_row.*", F.col("prediction").cast("int").alias("prediction"),
                         vector_to_array("probability")[1].alias("probability"))


def logistic(weights: Mapping[str, float], intercept: float) -> Column:
    """Probability of a linear model with given coefficients."""
    z = F.lit(float(intercept))
    for f, w in weights.items():
        z = z + F.col(f) * F.lit(float(w))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def with_provenance(df: DataFrame, model_name: str, version: str, scored_at: datetime) -> DataFrame:
    return df.withColumns({"model_name": F.lit(model_name), "model_version": F.lit(version),
                           "scored_at": F.lit(scored_at).cast("timestamp")})


def score_summary(df: DataFrame, prediction: str = "prediction", probability: str | None = "probability",
                  task: str = "classification") -> DataFrame:
    """One row about a scored table; positives and mean probability for classifiers only."""
    x = F.col(prediction).cast("double")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.stddev_pop(x).alias("std")]
    if task == "classification":
        aggs += [F.count_if(x > 0.5).alias("positives"), F.count_if(x <= 0.5).alias("negatives")]
        if probability:
            aggs.append(F.avg(probability).alias("mean_probability"))
    return df.agg(*aggs)
