import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskframe.operators import monitor
from riskframe.sources import logs
from riskframe.streaming import logs as stream
from tests.conftest import rows

NOW = datetime(2024, 3, 10)


@pytest.mark.parametrize("per_range", [None, 10])
def test_ks_statistic(spark, monkeypatch, per_range):
    if per_range:
        monkeypatch.setattr("riskframe.operators.ordering.ROWS_PER_RANGE", per_range)
    rng = random.Random(4)
    cur = [round(rng.gauss(0.3, 1), 2) for _ in range(300)]
    ref = [round(rng.gauss(0, 1), 2) for _ in range(500)]
    a = spark.createDataFrame([(x, float("nan")) for x in cur] + [(None, 1.0)], "x double, y double")
    b = spark.createDataFrame([(x,) for x in ref], "x double")
    got = monitor.drift_ks(a, b).collect()
    assert [r["feature"] for r in got] == ["x"]
    d = max(abs(sum(c <= v for c in cur) / 300 - sum(r <= v for r in ref) / 500) for v in cur + ref)
    lam = d * math.sqrt(300 * 500 / 800)
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    assert got[0]["ks_statistic"] == pytest.approx(d) and got[0]["p_value"] == pytest.approx(p) and got[0]["drift"] == (p < 0.05)


def test_ks_with_one_side_empty_is_no_drift(spark):
    a = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    r = monitor.drift_ks(a, a.where("false")).first()
    assert r["ks_statistic"] is None and r["p_value"] is None and not r["drift"]
    same = monitor.drift_ks(a, a).first()
    assert (same["ks_statistic"], same["p_value"]) == (0.0, 1.0)


def test_chi_square(spark):
    cur = spark.createDataFrame([("a",)] * 30 + [("b",)] * 50 + [("c",)] * 20 + [(None,)] * 9, "t string")
    ref = spark.createDataFrame([("a",)] * 80 + [("b",)] * 80 + [("c",)] * 40, "t string")
    r = monitor.drift_chi2(cur, ref).first()
    stat = (30 - 40) ** 2 / 40 + (50 - 40) ** 2 / 40
    assert (r["chi2_statistic"], r["dof"], r["unseen"]) == (pytest.approx(stat), 2, 0)
    assert r["p_value"] == pytest.approx(math.exp(-stat / 2)) and not r["drift"]
    new = monitor.drift_chi2(cur.union(spark.createDataFrame([("z",)], "t string")), ref).first()
    assert new["unseen"] == 1 and new["drift"]
    assert tuple(monitor.drift_summary(monitor.drift_chi2(cur, ref)).first()) == (False, 0, "")


def test_chi_square_tail(spark):
    df = spark.createDataFrame([(3.841458820694124, 1.0), (18.307038053275146, 10.0), (0.0, 3.0), (200.0, 4.0)], "x double, k double")
    p = [r[0] for r in df.select(monitor.chi_square_tail("x", "k")).collect()]
    assert p[:3] == [pytest.approx(0.05), pytest.approx(0.05), 1.0] and p[3] == pytest.approx(math.exp(-100) * 101, rel=1e-6)


def test_alerts_know_the_direction(spark):
    m = spark.createDataFrame([("a", 0.6, 5.0), ("b", 0.9, 1.0)], "model_name string, auc double, rmse double")
    got = monitor.alerts(m, {"auc": 0.7, "rmse": 2.0, "absent": 1.0})
    assert rows(got, "model_name", "metric", "value", "threshold") == [("a", "auc", 0.6, 0.7), ("a", "rmse", 5.0, 2.0)]


def test_report_and_latest_alerts(spark, tmp_path):
    day = timedelta(days=1)
    pred = spark.createDataFrame([(NOW - 7 * day, [0.9]), (NOW - 6 * day, [0.4]), (NOW - day, [])], "timestamp timestamp, probabilities array<double>")
    drift = spark.createDataFrame([(NOW - 2 * day, False, ["x"]), (NOW - day, True, ["x", "y"])],
                                  "timestamp timestamp, drift_detected boolean, drifted_features array<string>")
    r = monitor.monitoring_report(pred, drift, NOW, 7).first()
    assert (r["total_predictions"], r["avg_probability"], r["drift_records"], r["drift_events_count"]) == (2, 0.2, 2, 1)
    empty = monitor.monitoring_report(pred.where("false"), drift.where("false"), NOW, 7).first()
    assert (empty["total_predictions"], empty["avg_probability"], empty["drift_events_count"]) == (0, None, 0)
    perf = spark.createDataFrame([(NOW - day, "m", 0.5), (NOW, "m", 0.6)], "timestamp timestamp, model_name string, auc double")
    nested = perf.withColumn("alerts", F.array(F.struct(F.lit("auc").alias("metric"), F.col("auc").alias("value"),
                                                        F.lit(0.7).alias("threshold"), F.lit("warning").alias("severity"))))
    logs.append_log(nested, str(tmp_path / "p"), NOW)
    logs.append_log(drift, str(tmp_path / "d"), NOW)
    got = monitor.latest_alerts(logs.read_log(spark, str(tmp_path / "p"), logs.PERFORMANCE),
                                logs.read_log(spark, str(tmp_path / "d"), logs.DRIFT))
    assert rows(got, "type", "value", "drifted_features") == [("data_drift", None, "x,y"), ("performance", 0.6, None)]
    assert monitor.performance_trend(perf, NOW, 1).count() == 1


def test_log_stamps_rows_without_a_time(spark, tmp_path):
    df = spark.createDataFrame([("m", "v", 1, [0.5])], "model_name string, model_version string, prediction int, probabilities array<double>")
    logs.append_log(df, str(tmp_path / "l"), NOW)
    logs.append_log(df, str(tmp_path / "l"), NOW + timedelta(days=1))
    got = logs.read_log(spark, str(tmp_path / "l"), logs.PREDICTIONS)
    assert sorted(r["timestamp"] for r in got.collect()) == [NOW, NOW + timedelta(days=1)]


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "ts timestamp, model string, y int, p int, score double"

    def rows_for(day):
        return spark.createDataFrame([(datetime(2024, 1, day, h), "ab"[h % 2], h % 3 == 0 and 1 or 0, h % 2, h / 24) for h in range(24)], schema)

    def step():
        s = stream.read_stream(spark, src, schema, "parquet", max_files=1)
        stream.run_to_files(stream.windowed_volume(s, "ts", "model", "score"), out, state)

    for day in (1, 2):
        rows_for(day).coalesce(1).write.mode("append").parquet(src)
    step()
    for day in (3, 4):
        rows_for(day).coalesce(1).write.mode("append").parquet(src)
    step()
    got = spark.read.parquet(out)
    batch = stream.windowed_volume(spark.read.schema(schema).parquet(src), "ts", "model", "score").where(
        F.col("window_end") <= F.lit(datetime(2024, 1, 4, 22)))
    assert rows(got) == rows(batch) and got.count() == 6
    perf = stream.windowed_alerts(spark.read.schema(schema).parquet(src), "ts", "model", "y", "p", {"accuracy": 0.99})
    assert perf.count() == 8


def test_exact_ks_p_against_all_orders():
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 5)):
        gaps = []
        for first in itertools.combinations(range(n + m), n):
            a, far = 0, 0
            for k in range(n + m):
                a += k in first
                far = max(far, abs(a * m - (k + 1 - a) * n))
            gaps.append(far)
        for far in set(gaps):
            assert monitor.ks_tail(far / n / m, n, m) == pytest.approx(sum(g >= far for g in gaps) / len(gaps), abs=1e-12)
    assert monitor.ks_tail(0.0, 3, 4) == 1.0


def test_exact_ks_p_nears_the_asymptotic(spark):
    a = spark.range(2000).select((F.col("id") / 2000).alias("x"))
    b = spark.range(1500).select((F.col("id") / 1500 * 0.96).alias("x"))
    exact, limit = (monitor.drift_ks(a, b, method=m).first() for m in ("auto", "asymptotic"))
    assert exact.ks_statistic == limit.ks_statistic and exact.p_value == pytest.approx(limit.p_value, abs=0.02)
    none = monitor.drift_ks(a, b.withColumn("x", F.lit(None).cast("double")), method="auto").first()
    assert none.p_value is None and not none.drift
    with pytest.raises(ValueError):
        monitor.drift_ks(a, b, method="exact")
