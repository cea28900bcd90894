from datetime import datetime

from pyspark.sql import functions as F

from riskframe.catalog.evaluation import BINARY, RATES, STEPS
from riskframe.catalog.registry import SC, query, r, rounded, scored_items, scratch, table
from riskframe.operators import monitor
from riskframe.sources import logs

LIMITS = {"accuracy": 0.7, "precision": 0.9, "recall": 0.3, "auc": 0.99}
PERF = f"""{SC}, {BINARY}, {STEPS}, pm AS (SELECT bm.*, auc FROM bm JOIN au USING (model_name))"""


@query("mon_performance", f"WITH {PERF} SELECT model_name, n, {RATES}, {r('auc')} AS auc FROM pm")
def mon_performance(spark, sf):
    return rounded(monitor.performance(scored_items(spark, sf), "label", "prediction", "score"))


@query("performance_no_scores", f"""WITH {PERF} SELECT CASE WHEN model_name <> 'RF' THEN model_name END AS model_name, n, {RATES},
  CASE WHEN model_name <> 'LR' THEN {r('auc')} END AS auc FROM pm""")
def performance_no_scores(spark, sf):
    sc = scored_items(spark, sf).withColumn("score", F.when(F.col("model_name") != "LR", F.col("score")))
    sc = sc.withColumn("model_name", F.when(F.col("model_name") != "RF", F.col("model_name")))
    return rounded(monitor.performance(sc, "label", "prediction", "score"))


ALERTS = """al AS (SELECT model_name, metric, value, threshold FROM (SELECT model_name,
  unnest(['accuracy', 'precision', 'recall', 'auc']) AS metric, unnest([accuracy, precision, recall, auc]) AS value,
  unnest([0.7, 0.9, 0.3, 0.99]) AS threshold FROM pm) WHERE value < threshold)"""


@query("mon_alerts", f"""WITH {PERF}, {ALERTS} SELECT model_name, metric, {r('value')} AS value, CAST(threshold AS DOUBLE) AS threshold,
  'warning' AS severity FROM al""")
def mon_alerts(spark, sf):
    perf = monitor.performance(scored_items(spark, sf), "label", "prediction", "score")
    return rounded(monitor.alerts(perf, LIMITS))


# orders before and after a day: a shifted price column, an unchanged one, the status and the priority
OLD = "o_orderdate < TIMESTAMP '1998-07-01'"
WINDOWS = f"""ref AS (SELECT o_totalprice AS total, CAST(o_custkey AS DOUBLE) AS customer, o_orderstatus AS status,
    o_orderpriority AS priority FROM orders WHERE {OLD}),
  cur AS (SELECT o_totalprice * 1.02 AS total, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS customer,
    CASE WHEN o_orderkey % 10 = 0 THEN 'F' ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 500 = 0 THEN '6-NEW' ELSE o_orderpriority END AS priority FROM orders WHERE NOT {OLD})"""


def windows(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    old = F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz")
    customer = F.col("o_custkey").cast("double")
    ref = o.where(old).select(F.col("o_totalprice").alias("total"), customer.alias("customer"),
                              F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    cur = o.where(~old).select((F.col("o_totalprice") * 1.02).alias("total"),
                               F.when(k % 9 != 0, customer).alias("customer"),
                               F.when(k % 10 == 0, "F").otherwise(F.col("o_orderstatus")).alias("status"),
                               F.when(k % 500 == 0, "6-NEW").otherwise(F.col("o_orderpriority")).alias("priority"))
    return cur, ref


_TERMS = "list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * k * k * lam * lam)))"
KS = f"""{WINDOWS}, lg AS (SELECT 'total' AS feature, total AS x, 1 AS c, 0 AS f FROM cur UNION ALL SELECT 'customer', customer, 1, 0 FROM cur
    UNION ALL SELECT 'total', total, 0, 1 FROM ref UNION ALL SELECT 'customer', customer, 0, 1 FROM ref),
  g AS (SELECT feature, x, sum(c) AS c, sum(f) AS f FROM lg WHERE x IS NOT NULL GROUP BY ALL),
  cu AS (SELECT feature, sum(c) OVER w / sum(c) OVER a AS fc, sum(f) OVER w / sum(f) OVER a AS fr, sum(c) OVER a AS nc, sum(f) OVER a AS nr
    FROM g WINDOW w AS (PARTITION BY feature ORDER BY x), a AS (PARTITION BY feature)),
  d AS (SELECT feature, CAST(max(nc) AS BIGINT) AS nc, CAST(max(nr) AS BIGINT) AS nr, max(abs(fc - fr)) AS d FROM cu GROUP BY 1),
  la AS (SELECT *, d * sqrt(CAST(nc AS DOUBLE) * nr / (nc + nr)) AS lam FROM d),
  ks AS (SELECT feature, nc, nr, d, CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1, {_TERMS})) END AS p FROM la)"""


@query("drift_ks", f"""WITH {KS} SELECT feature, nc AS n_current, nr AS n_reference, {r('d')} AS ks_statistic, {r('p')} AS p_value,
  p < 0.05 AS drift FROM ks""")
def drift_ks(spark, sf):
    return rounded(monitor.drift_ks(*windows(spark, sf)))


# the exact p-value: the probability that a random order stays closer together, diagonal by diagonal; it leaves out the place where it does not
@query("drift_ks_exact", f"""WITH RECURSIVE lg AS (SELECT s_acctbal AS x, 1 AS c, 0 AS f FROM supplier UNION ALL
    SELECT c_acctbal, 0, 1 FROM customer WHERE c_custkey % 50 = 0),
  g AS (SELECT x, sum(c) AS c, sum(f) AS f FROM lg WHERE x IS NOT NULL GROUP BY x),
  cu AS (SELECT sum(c) OVER w AS cc, sum(f) OVER w AS cf, sum(c) OVER () AS nc, sum(f) OVER () AS nf FROM g WINDOW w AS (ORDER BY x)),
  d AS (SELECT CAST(max(nc) AS BIGINT) AS n, CAST(max(nf) AS BIGINT) AS m, CAST(max(abs(cc * nf - cf * nc)) AS BIGINT) AS far FROM cu),
  p(s, i, v) AS (SELECT 0::BIGINT, 0::BIGINT, 1.0::DOUBLE UNION ALL
    SELECT s + 1, i + up, sum(CASE WHEN up = 1 THEN v * (i + 1) / (s + 1) ELSE v * (s - i + 1) / (s + 1) END)
    FROM p, d, (VALUES (0), (1)) AS moves(up)
    WHERE s < n + m AND i + up <= n AND s + 1 - i - up <= m AND abs((i + up) * m - (s + 1 - i - up) * n) < far GROUP BY s, i + up),
  e AS (SELECT n, m, CAST(far AS DOUBLE) / n / m AS ks, CASE WHEN far = 0 THEN 1.0 ELSE 1 - coalesce((SELECT max(v) FROM p WHERE s = n + m), 0) END AS pv FROM d)
  SELECT 'balance' AS feature, n AS n_current, m AS n_reference, {r('ks')} AS ks_statistic, {r('pv')} AS p_value, pv < 0.05 AS drift FROM e""")
def drift_ks_exact(spark, sf):
    cur = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"))
    ref = table(spark, sf, "customer").where(F.col("c_custkey") % 50 == 0).select(F.col("c_acctbal").alias("balance"))
    return rounded(monitor.drift_ks(cur, ref, method="auto"))


CHI = f"""{WINDOWS}, lc AS (SELECT 'status' AS feature, status AS x, 1 AS c, 0 AS f FROM cur UNION ALL SELECT 'priority', priority, 1, 0 FROM cur
    UNION ALL SELECT 'status', status, 0, 1 FROM ref UNION ALL SELECT 'priority', priority, 0, 1 FROM ref),
  cg AS (SELECT feature, x, sum(c) AS o, sum(f) AS rr FROM lc GROUP BY ALL),
  ct AS (SELECT *, sum(o) OVER (PARTITION BY feature) AS no, sum(rr) OVER (PARTITION BY feature) AS nr FROM cg),
  ch AS (SELECT feature, sum(CASE WHEN rr > 0 THEN pow(o - CAST(rr AS DOUBLE) * no / nr, 2) / (CAST(rr AS DOUBLE) * no / nr) END) AS stat,
    count(*) FILTER (rr > 0) - 1 AS dof, count(*) FILTER (rr = 0 AND o > 0) AS unseen FROM ct GROUP BY feature)"""
# the upper tail has a closed form for 2 and 4 degrees of freedom
_TAIL = "CASE dof WHEN 2 THEN exp(-stat / 2) WHEN 4 THEN exp(-stat / 2) * (1 + stat / 2) END"


@query("drift_chi2", f"""WITH {CHI} SELECT feature, {r('stat', 5)} AS chi2_statistic, dof, unseen, {r(_TAIL)} AS p_value,
  {_TAIL} < 0.05 OR unseen > 0 AS drift FROM ch""")
def drift_chi2(spark, sf):
    return rounded(monitor.drift_chi2(*windows(spark, sf)), chi2_statistic=5)


@query("drift_summary", f"""WITH {KS}, {CHI[CHI.index('lc AS'):]}, a AS (SELECT feature, p < 0.05 AS drift FROM ks
    UNION ALL SELECT feature, {_TAIL} < 0.05 OR unseen > 0 FROM ch)
  SELECT bool_or(drift) AS drift_detected, count(*) FILTER (drift) AS n_drifted,
    coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (drift), '') AS drifted_features FROM a""")
def drift_summary(spark, sf):
    cur, ref = windows(spark, sf)
    return monitor.drift_summary(monitor.drift_ks(cur, ref), monitor.drift_chi2(cur, ref))


# ---- logs: events are prediction records, their daily totals drift records -----------

NOW = datetime(2024, 1, 31)
LOGS = """pl AS (SELECT ts AS timestamp, event_type AS model_name, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value / 500.0 END AS p FROM events),
  dl AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS timestamp, count(*) FILTER (event_type = 'error') > 0.2 * count(*) AS drift_detected
    FROM events GROUP BY 1)"""


def prediction_log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("model_name"),
                    F.when(F.col("event_id") % 4 == 0, F.array().cast("array<double>"))
                    .otherwise(F.array(F.col("value") / 500.0, 1 - F.col("value") / 500.0)).alias("probabilities"))


def drift_log(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("timestamp")).agg(
        (F.count_if(F.col("event_type") == "error") > 0.2 * F.count(F.lit(1))).alias("drift_detected"),
        F.sort_array(F.collect_set("event_type")).alias("drifted_features"))


def _stored_logs(spark, sf):
    """The prediction and the drift log, written and read back."""
    base = scratch(spark)
    out = []
    for name, log, schema in (("predictions", prediction_log(spark, sf), logs.PREDICTIONS), ("drift", drift_log(spark, sf), logs.DRIFT)):
        logs.append_log(log.withColumn("timestamp", F.col("timestamp").cast("timestamp")), f"{base}/{name}", NOW)
        out.append(logs.read_log(spark, f"{base}/{name}", schema))
    return out


@query("mon_report", f"""WITH {LOGS}, a AS (SELECT count(*) AS n, avg(coalesce(p, 0)) AS m FROM pl WHERE timestamp > TIMESTAMP '2024-01-24'),
  b AS (SELECT count(*) AS n, count(*) FILTER (drift_detected) AS k FROM dl WHERE timestamp > TIMESTAMP '2024-01-24')
  SELECT a.n AS total_predictions, {r('a.m')} AS avg_probability, b.n AS drift_records, b.k AS drift_events_count, 7 AS report_period_days FROM a, b""")
def mon_report(spark, sf):
    predictions, drifts = _stored_logs(spark, sf)
    return rounded(monitor.monitoring_report(predictions, drifts, NOW, 7))


# the trend: one performance record a day, of the last days
@query("mon_trend", f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS model_name, count(*) AS sample_count,
  {r("avg(value / 500.0)")} AS accuracy FROM events WHERE CAST(date_trunc('day', ts) AS TIMESTAMP) > TIMESTAMP '2024-01-24' GROUP BY ALL""")
def mon_trend(spark, sf):
    e = table(spark, sf, "events")
    daily = e.groupBy(F.date_trunc("day", "ts").alias("timestamp"), F.col("event_type").alias("model_name")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg(F.col("value") / 500.0).alias("accuracy"))
    path = scratch(spark) + "/performance_log"
    logs.append_log(daily, path, NOW)
    trend = monitor.performance_trend(logs.read_log(spark, path, logs.PERFORMANCE), NOW, 7)
    return rounded(trend.select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "model_name", "sample_count", "accuracy"))


# one performance record per day: an alert for each event type that is rarer than 18 percent
@query("mon_latest_alerts", """WITH d AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS d, event_type, count(*) AS n FROM events GROUP BY ALL),
  s AS (SELECT d, event_type, n / sum(n) OVER (PARTITION BY d) AS share FROM d), l AS (SELECT max(d) AS d FROM d),
  dr AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS d, count(*) FILTER (event_type = 'error') > 0.2 * count(*) AS y,
     list_sort(list(DISTINCT event_type)) AS f FROM events GROUP BY 1)
  SELECT 'performance' AS type, event_type AS metric, """ + r("share") + """ AS value, CAST(0.2 AS DOUBLE) AS threshold, 'warning' AS severity,
    CAST(NULL AS VARCHAR) AS drifted_features FROM s JOIN l USING (d) WHERE share < 0.2
  UNION ALL SELECT 'data_drift', NULL, NULL, NULL, 'warning', array_to_string(f, ',') FROM dr JOIN l USING (d) WHERE y""")
def mon_latest_alerts(spark, sf):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("timestamp")
    e = table(spark, sf, "events")
    counts = e.groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("timestamp").agg(F.sum("n").alias("all"))
    shares = counts.join(totals, "timestamp").withColumn("value", F.col("n") / F.col("all"))
    alert = F.when(F.col("value") < 0.2, F.struct(F.col("event_type").alias("metric"), "value", F.lit(0.2).alias("threshold"),
                                                  F.lit("warning").alias("severity")))
    perf = shares.groupBy("timestamp").agg(F.collect_list(alert).alias("alerts"))
    return rounded(monitor.latest_alerts(perf, drift_log(spark, sf)))


@query("mon_log_append", f"""WITH {PERF}, {ALERTS}, c AS (SELECT model_name, count(*) AS k FROM al GROUP BY 1)
  SELECT model_name, n AS sample_count, {r('accuracy')} AS accuracy, {r('auc')} AS auc, CAST(coalesce(k, 0) AS INTEGER) AS n_alerts,
    CAST(t AS BIGINT) AS records FROM pm LEFT JOIN c USING (model_name), (SELECT 2 AS t)""")
def mon_log_append(spark, sf):
    perf = monitor.performance(scored_items(spark, sf), "label", "prediction", "score")
    records = logs.performance_records(perf, monitor.alerts(perf, LIMITS), NOW)
    path = scratch(spark) + "/performance_log"
    logs.append_log(records, path, NOW)
    logs.append_log(records, path, NOW)
    back = logs.read_log(spark, path, logs.PERFORMANCE)
    grouped = back.groupBy("model_name").agg(
        F.max("sample_count").alias("sample_count"), F.max("accuracy").alias("accuracy"), F.max("auc").alias("auc"),
        F.max(F.coalesce(F.size("alerts"), F.lit(0))).alias("n_alerts"), F.count(F.lit(1)).alias("records"))
    return rounded(grouped)


# the newest 2000 records by hash, within the retention period
@query("drift_sample", """SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY md5('42|' || CAST(event_id AS VARCHAR))) AS rn
  FROM events WHERE ts > TIMESTAMP '2024-01-16') WHERE rn <= 2000""")
def drift_sample(spark, sf):
    from riskframe.operators.sampling import hash_sample

    recent = monitor.since(table(spark, sf, "events"), "ts", NOW, 15)
    return hash_sample(recent, ["event_id"], 2000).select("event_id", "event_type")
