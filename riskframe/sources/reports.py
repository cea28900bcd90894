"""Result documents: one JSON record per run, read back across runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = T.StructType([T.StructField(m, T.DoubleType()) for m in
                        ("accuracy", "precision", "recall", "f1", "auc", "ks", "mse", "rmse", "mae", "r2", "mape")])
REPORT_LINE = T.StructType([T.StructField(m, T.DoubleType()) for m in ("precision", "recall", "f1", "support")])
RESULT_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("evaluation_results", T.StructType([
        T.StructField("model_name", T.StringType()),
        T.StructField("data_name", T.StringType()),
        T.StructField("imbalance_method", T.StringType()),
        T.StructField("metrics", T.StructType([
            T.StructField("train_metrics", METRICS),
            T.StructField("test_metrics", METRICS),
            T.StructField("detailed_report", T.StructType([
                T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
                T.StructField("classification_report", T.MapType(T.StringType(), REPORT_LINE))]))])),
        T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("training_time", T.DoubleType()),
        T.StructField("feature_count", T.IntegerType()),
        T.StructField("status", T.StringType())])),
    T.StructField("timestamp", T.StringType())])


def result_rows(spark: SparkSession, results: Sequence[Mapping]) -> DataFrame:
    """Result documents as rows; keys a document lacks become NULL."""
    return spark.createDataFrame([_as_row(r, RESULT_SCHEMA) for r in results], RESULT_SCHEMA)


def _as_row(value, dtype):
    if value is None:
        return None
    if isinstance(dtype, T.StructType):
        return Row(*[_as_row(value.get(f.name), f.dataType) for f in dtype.fields])
    if isinstance(dtype, T.MapType):
        if isinstance(dtype.valueType, T.StructType):
            return {k: _as_row(v, dtype.valueType) for k, v in value.items()}
        return {k: None if v is None else str(v) for k, v in value.items()}
    if isinstance(dtype, T.DoubleType):
        return float(value)
    return value


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def result_name(data: str, sampler: str, model: str) -> str:
    return f"pipeline_{data}_{sampler}_{model}_results.json"


def write_result(spark: SparkSession, folder: str, document: Mapping) -> str:
    """Store one result document under the name that ``names_from_file`` reads; a later run replaces it."""
    r = document["evaluation_results"]
    path = f"{folder.rstrip('/')}/{result_name(r['data_name'], r['imbalance_method'], r['model_name'])}"
    write_json(result_rows(spark, [document]).coalesce(1), path)
    return path


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All stored result documents below a path, one or many a file, with the name of the file each came from."""
    return (spark.read.schema(RESULT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
            .withColumn("file_path", F.col("_metadata.file_path")))


def names_from_file(path_col: str = "file_path") -> dict[str, F.Column]:
    """data, sampler and model from a file named ``pipeline_<data>_<sampler>_<model>_results.json``.

    A data name has two words; the sampler is what lies between it and the model.
    """
    stem = F.regexp_extract(F.col(path_col), r"([^/\\]+)_results\.json(?:$|/)", 1)
    words = F.split(stem, "_")
    n = F.size(words)
    return {"data_name": F.array_join(F.slice(words, 2, 2), "_"),
            "imbalance_method": F.array_join(F.slice(words, F.lit(4), n - 4), "_"),
            "model_name": F.element_at(words, -1)}


def feature_list(spark: SparkSession, name: str, features: Sequence[str], created: datetime) -> DataFrame:
    """One row: the final feature list of a run."""
    return spark.createDataFrame([(name, list(features), len(features), created)],
                                 "name string, features array<string>, feature_count int, created_at timestamp")
