"""Dataset checks and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import drop_nan
from riskframe.operators.ordering import exact_percentiles


def check_schema(df: DataFrame, required: Sequence[str], target: str | None = None) -> None:
    """Fail before any job starts when a needed column is absent."""
    have = set(df.columns)
    missing = [c for c in required if c not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if target is not None and target not in have:
        raise ValueError(f"target column {target!r} is missing")


def check_input(df: DataFrame, features: Sequence[str]) -> None:
    """What a table must have before it is scored: the model's features and at least one row."""
    check_schema(df, features)
    if df.isEmpty():
        raise ValueError("the table to score is empty")


def validate_dataset(df: DataFrame, required: Sequence[str], target: str,
                     task: str = "classification") -> DataFrame:
    """Check a training table; returns (check, passed, detail) rows or raises on a failed check."""
    check_schema(df, required, target)
    if df.isEmpty():
        raise ValueError("the dataset is empty")
    # three distinct values settle both questions, whatever the size of the table
    distinct = df.select(target).where(F.col(target).isNotNull()).distinct().limit(3).count()
    if task == "classification" and distinct < 2:
        raise ValueError("classification needs at least two classes")
    rows = [("not_empty", True, ""), ("columns_present", True, ",".join(required)),
            ("target_present", True, target),
            ("target_varies" if task == "classification" else "target_continuous", distinct > 1 if
             task == "classification" else distinct > 2, task)]
    return df.sparkSession.createDataFrame(rows, "check string, passed boolean, detail string")


def profile_label(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return (counts.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
            .select(label, "n", (F.col("n") / F.col("_all")).alias("share")))


def profile_target(df: DataFrame, target: str) -> DataFrame:
    """One row: distinct count and the usual description of a regression target."""
    df = drop_nan(df.select(target), [target])
    q25, q50, q75 = exact_percentiles(df, [target], [0.25, 0.5, 0.75])[target]
    x = F.col(target).cast("double")
    return df.agg(
        F.count_distinct(target).alias("n_distinct"), F.count(target).alias("n"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.lit(q25).cast("double").alias("q25"), F.lit(q50).cast("double").alias("q50"),
        F.lit(q75).cast("double").alias("q75"), F.max(x).alias("max"))


def profile_missing(df: DataFrame) -> DataFrame:
    """(feature, n_missing) of the columns that have missing values, in one pass."""
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("n_missing"))
            for i, c in enumerate(df.columns)]
    return wide.select(F.inline(F.array(*rows))).where(F.col("n_missing") > 0)
