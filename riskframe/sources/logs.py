"""Append-only prediction, performance and drift logs (newline-delimited JSON)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTIONS = "model_name string, model_version string, prediction int, probabilities array<double>, timestamp timestamp"
PERFORMANCE = ("model_name string, timestamp timestamp, sample_count long, positive_rate double, "
               "predicted_positive_rate double, accuracy double, precision double, recall double, auc double, "
               "alerts array<struct<metric: string, value: double, threshold: double, severity: string>>")
DRIFT = "drift_detected boolean, drifted_features array<string>, timestamp timestamp"


def append_log(df: DataFrame, path: str, now: datetime) -> None:
    """Add rows to a log, stamped with the given time unless they carry one."""
    stamped = df if "timestamp" in df.columns else df.withColumn("timestamp", F.lit(now).cast("timestamp"))
    stamped.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def performance_records(metrics: DataFrame, alerts: DataFrame, now: datetime) -> DataFrame:
    """Metrics with their alerts nested, in the shape of the performance log; a few rows per run."""
    nested = alerts.groupBy("model_name").agg(
        F.sort_array(F.collect_list(F.struct("metric", "value", "threshold", "severity"))).alias("alerts"))
    return (metrics.join(nested, "model_name", "left").withColumnRenamed("n", "sample_count")
            .withColumn("timestamp", F.lit(now).cast("timestamp")))
