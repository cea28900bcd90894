"""Registration of queries and the tables and helpers they share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.sources.lineage import ensure_checkpoint_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for written results in the folder that all executors share (see ``lineage``)."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/riskframe-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double, and turn -0.0 into 0.0, so that summation order does not show."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def r(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


# ---- lineitem as a modelling table: four numeric features, two text features, a label --------

LI = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS qty, l_extendedprice AS price,
  l_discount AS disc, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS tax,
  l_returnflag AS flag, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_linestatus END AS status,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"""
LI_NUM = ["qty", "price", "disc", "tax"]


def line_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")).alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_linestatus")).alias("status"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))


def long_sql(cols, source: str = "li", ids: str = "label") -> str:
    """SQL for one row per (row, feature)."""
    return " UNION ALL ".join(f"SELECT {ids}, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM {source}" for c in cols)


EDGES = """edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(x,
  [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM long GROUP BY feature)"""
BIN = """CASE WHEN x IS NULL THEN 'missing'
  ELSE CAST(len(list_filter(e[2:len(e) - 1], lambda v: v < x)) AS VARCHAR) END"""


# ---- orders with a row key, an unbalanced label and a customer segment -----------------------

OR = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
  CASE WHEN o_custkey % 6 = 0 THEN 1 ELSE 0 END AS label FROM orders)"""


def labelled_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        F.when(F.col("o_custkey") % 6 == 0, 1).otherwise(0).alias("label"))


# ---- a scored table: score in [0, 1), prediction, label, split and model name ----------------

SC = """sc AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS prediction FROM (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    CAST((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31 + l_linenumber * 17) % 10000
      + CASE WHEN l_returnflag = 'R' THEN 3000 ELSE 0 END AS DOUBLE) / CAST(13000 AS DOUBLE) AS score,
    CASE WHEN l_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS split,
    CASE l_partkey % 3 WHEN 0 THEN 'RF' WHEN 1 THEN 'LR' ELSE 'XGB' END AS model_name FROM lineitem))"""


def scored_items(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    noise = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 31
             + F.col("l_linenumber") * 17) % 10000
    model = F.col("l_partkey") % 3
    return table(spark, sf, "lineitem").select(
        label.alias("label"),
        ((noise + F.when(F.col("l_returnflag") == "R", 3000).otherwise(0)).cast("double")
         / F.lit(13000.0)).alias("score"),
        F.when(F.col("l_orderkey") % 10 < 7, "train").otherwise("test").alias("split"),
        F.when(model == 0, "RF").when(model == 1, "LR").otherwise("XGB").alias("model_name"),
    ).withColumn("prediction", F.when(F.col("score") > 0.5, 1).otherwise(0))
