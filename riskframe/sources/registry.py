"""Versioned fitted models: a folder per version and one table that lists them."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "name string, version string, path string, created_at timestamp"


def save_model(model: PipelineModel, root: str, name: str, version: str, now: datetime) -> str:
    """Save one version and record it; the newest record of a name is its latest version. A version is saved once."""
    root = root.rstrip("/")
    path = f"{root}/models/{name}/{version}"
    spark = SparkSession.getActiveSession()
    model.write().save(path)  # refuses a version that is there
    spark.createDataFrame([(name, version, path, now)], SCHEMA).write.mode("append").parquet(f"{root}/registry")
    return path


def records(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{root.rstrip('/')}/registry")


def list_models(registry: DataFrame) -> DataFrame:
    """All versions, newest first."""
    return registry.orderBy(F.col("created_at").desc(), "name", "version")


def latest_models(registry: DataFrame) -> DataFrame:
    """The newest version of each name."""
    newest = F.max_by(F.struct("version", "path", "created_at"), F.struct("created_at", "version")).alias("r")
    return registry.groupBy("name").agg(newest).select("name", "r.version", "r.path", "r.created_at")


def load_model(spark: SparkSession, root: str, name: str, version: str = "latest") -> PipelineModel:
    rows = records(spark, root).where(F.col("name") == name)
    rows = latest_models(rows) if version == "latest" else rows.where(F.col("version") == version)
    found = rows.select("path").limit(1).collect()
    if not found:
        raise ValueError(f"no model {name!r} with version {version!r}")
    return PipelineModel.load(found[0]["path"])


def with_version_rank(registry: DataFrame) -> DataFrame:
    """Number the versions of each name, 1 for the newest."""
    w = Window.partitionBy("name").orderBy(F.col("created_at").desc(), F.col("version").desc())
    return registry.withColumn("age_rank", F.row_number().over(w))
