"""Reading and writing plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

READERS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def read_table(spark: SparkSession, source: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file or folder by its extension, or a catalog table by its name ``db.table``."""
    kind = next((k for ext, k in READERS.items() if source.rstrip("/").lower().endswith(ext)), None)
    if kind is None:
        if "/" in source:
            raise ValueError(f"unknown file type: {source}")
        return spark.table(source)
    if kind == "csv":
        return read_csv(spark, source, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(kind).load(source)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give the schema where possible: inferring it reads the data twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_samples(samples: Mapping[str, DataFrame], folder: str, cols: Sequence[str] | None = None) -> None:
    """One CSV folder per named sample."""
    for name, df in samples.items():
        write_csv(df.select(*cols) if cols else df, f"{folder.rstrip('/')}/{name}")
