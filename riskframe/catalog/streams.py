from pyspark.sql import functions as F

from riskframe.catalog.registry import query, r, rounded, scratch, table
from riskframe.operators.models import train
from riskframe.operators.monitor import alerts
from riskframe.streaming import logs

_DAY = "CAST(date_trunc('day', ts) AS TIMESTAMP)"


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = logs.read_stream(spark, sf, schema, "parquet", "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs an instant


def _finish(spark, stream):
    """Run the stream to its end into files and read them back."""
    base = scratch(spark)
    logs.run_to_files(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _windows(spark, stream):
    """As _finish, with the windows that are still open: what the same plan gives on the whole table."""
    base = scratch(spark)
    logs.run_updates(stream, f"{base}/out", f"{base}/state")
    return logs.latest(spark, f"{base}/out", stream.schema, ["window_start", "window_end", "event_type"])


@query("stream_volume", f"""WITH g AS (SELECT {_DAY} AS d, event_type, count(*) AS n, avg(value / 487.3) AS m FROM events GROUP BY ALL)
  SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n, {r('m')} AS mean_score FROM g""")
def stream_volume(spark, sf):
    s = event_stream(spark, sf).withColumn("score", F.col("value") / 487.3)
    out = _windows(spark, logs.windowed_volume(s, "ts", "event_type", "score"))
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean_score"))


_PR = f"""p AS (SELECT {_DAY} AS d, event_type, CAST(event_id % 3 = 0 AS INTEGER) AS label,
    CAST(value > 100 AS INTEGER) AS prediction FROM events),
  g AS (SELECT d, event_type, count(*) AS n, count(*) FILTER (label = prediction) AS hit, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
    sum(prediction) AS pp, sum(label) AS pos FROM p GROUP BY ALL),
  m AS (SELECT d, event_type, n, hit / n AS accuracy, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision,
    CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS recall FROM g)"""


def _judged(spark, sf):
    return (event_stream(spark, sf).withColumn("label", (F.col("event_id") % 3 == 0).cast("int"))
            .withColumn("prediction", (F.col("value") > 100).cast("int")))


@query("stream_performance", f"""WITH {_PR} SELECT strftime(d, '%Y-%m-%d') AS day, event_type, n, {r('accuracy')} AS accuracy,
  {r('precision')} AS precision, {r('recall')} AS recall FROM m""")
def stream_performance(spark, sf):
    out = _windows(spark, logs.windowed_performance(_judged(spark, sf), "ts", "event_type", "label", "prediction"))
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "accuracy",
                              "precision", "recall"))


@query("stream_alerts", f"""WITH {_PR}, u AS (SELECT d, event_type, unnest(['accuracy', 'precision', 'recall']) AS metric,
    unnest([accuracy, precision, recall]) AS value, unnest([0.6, 0.3, 0.2]) AS threshold FROM m)
  SELECT strftime(d, '%Y-%m-%d') AS day, event_type, metric, {r('value')} AS value, CAST(threshold AS DOUBLE) AS threshold, 'warning' AS severity
  FROM u WHERE value < threshold""")
def stream_alerts(spark, sf):
    perf = _windows(spark, logs.windowed_performance(_judged(spark, sf), "ts", "event_type", "label", "prediction"))
    out = alerts(perf, {"accuracy": 0.6, "precision": 0.3, "recall": 0.2}, ["window_start", "event_type"])
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "metric", "value",
                              "threshold", "severity"))


@query("stream_scoring", "SELECT event_id, true AS is_share, true AS cut_at_half FROM events")
def stream_scoring(spark, sf):
    events = table(spark, sf, "events").withColumn("label", (F.col("value") > 60).cast("int"))
    model = train(events.withColumn("hour", F.hour("ts").cast("double")), "label", "LR", ["hour", "user_id"],
                  ["event_type"])
    s = event_stream(spark, sf).withColumn("hour", F.hour("ts").cast("double")).select(
        "event_id", "hour", "user_id", "event_type")
    out = _finish(spark, logs.score_stream(s, model, ["hour", "user_id", "event_type"]).select("event_id", "prediction", "probability"))
    p = F.col("probability")
    return out.select("event_id", p.between(0, 1).alias("is_share"), ((p > 0.5) == (F.col("prediction") == 1)).alias("cut_at_half"))
