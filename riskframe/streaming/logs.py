"""The prediction and performance logs as streams.

Every function is a plain DataFrame plan, so it gives the same rows on a batch table. In append
mode a window is emitted once the watermark has passed its end; ``run_updates`` also writes
windows that are still open, and ``latest`` reads the newest state of each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.evaluate import binary_counts, binary_rates
from riskframe.operators.monitor import alerts
from riskframe.operators.scoring import predict


def windowed_volume(log: DataFrame, ts: str, key: str, score: str, width: str = "1 day",
                    late: str = "1 hour") -> DataFrame:
    """(window_start, window_end, key, n, mean_score) per window and model."""
    g = log.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "mean_score")


def windowed_performance(log: DataFrame, ts: str, key: str, label: str, prediction: str, width: str = "1 day",
                         late: str = "1 hour") -> DataFrame:
    """Windowed counts of hits and misses and the rates made from them."""
    g = log.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(*binary_counts(label, prediction))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n",
                    *[e.alias(name) for name, e in binary_rates().items()])


def windowed_alerts(log: DataFrame, ts: str, key: str, label: str, prediction: str, thresholds: Mapping[str, float],
                    width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, key, metric, value, threshold, severity) for every broken limit."""
    perf = windowed_performance(log, ts, key, label, prediction, width, late)
    return alerts(perf, thresholds, ["window_start", key])


def score_stream(log: DataFrame, model, features: Sequence[str], task: str = "classification") -> DataFrame:
    return predict(model, log, features, task)


def read_stream(spark: SparkSession, folder: str, schema, fmt: str = "json", pattern: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """A folder that grows by new files, as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def run_to_files(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process what is there, append the finished rows to files, and stop. Restartable."""
    query = (stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def run_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there, write every window that changed, open ones included, and stop. Restartable.

    Each batch writes a folder of its own and replaces it when it is repeated.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = (stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
             .outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()


def latest(spark: SparkSession, out: str, schema, keys: Sequence[str]) -> DataFrame:
    """The newest row of each window and key that ``run_updates`` wrote."""
    values = [f.name for f in schema if f.name not in keys]
    rows = spark.read.option("basePath", out).schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(out)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])
