from pyspark.sql import functions as F

from riskframe.catalog.registry import SC, query, r, rounded, scored_items, table
from riskframe.operators import evaluate, permutation

CM = f"""{SC}, cm AS (SELECT model_name, label, prediction, count(*) AS n FROM sc GROUP BY ALL),
  k AS (SELECT DISTINCT model_name, label AS c FROM cm UNION SELECT DISTINCT model_name, prediction FROM cm),
  pc AS (SELECT k.model_name, k.c, coalesce(sum(n) FILTER (label = c), 0) AS support,
    coalesce(sum(n) FILTER (prediction = c), 0) AS predicted, coalesce(sum(n) FILTER (label = c AND prediction = c), 0) AS tp
    FROM k JOIN cm USING (model_name) GROUP BY ALL),
  pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM pc),
  pf AS (SELECT *, CASE WHEN p + re > 0 THEN 2 * p * re / (p + re) ELSE 0 END AS f FROM pr),
  av AS (SELECT model_name, sum(tp) / sum(support) AS acc, sum(p * support) / sum(support) AS wp, sum(re * support) / sum(support) AS wr,
    sum(f * support) / sum(support) AS wf, avg(p) AS mp, avg(re) AS mr, avg(f) AS mf, sum(support) AS n FROM pf GROUP BY 1)"""
BY = ["model_name"]


@query("confusion_matrix", f"WITH {SC} SELECT model_name, label, prediction, count(*) AS n FROM sc GROUP BY ALL")
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(scored_items(spark, sf), "label", "prediction", BY)


@query("metrics_weighted", f"""WITH {CM} SELECT model_name, {r('acc')} AS accuracy, {r('wp')} AS precision, {r('wr')} AS recall,
  {r('wf')} AS f1 FROM av""")
def metrics_weighted(spark, sf):
    return rounded(evaluate.weighted_metrics(scored_items(spark, sf), "label", "prediction", BY))


@query("classification_report", f"""WITH {CM}, al AS (
  SELECT model_name, CAST(c AS VARCHAR) AS class, p, re, f, support FROM pf UNION ALL
  SELECT model_name, 'accuracy', acc, acc, acc, n FROM av UNION ALL SELECT model_name, 'macro avg', mp, mr, mf, n FROM av
  UNION ALL SELECT model_name, 'weighted avg', wp, wr, wf, n FROM av)
  SELECT model_name, class, {r('p')} AS precision, {r('re')} AS recall, {r('f')} AS f1, CAST(support AS BIGINT) AS support FROM al""")
def classification_report(spark, sf):
    return rounded(evaluate.classification_report(scored_items(spark, sf), "label", "prediction", BY))


_BIN = """count(*) AS n, sum(label) AS pos, sum(prediction) AS pp, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (label = prediction) AS hit"""
BINARY = f"""b AS (SELECT model_name, {_BIN} FROM sc GROUP BY 1),
  bm AS (SELECT model_name, n, pos / n AS positive_rate, pp / n AS predicted_positive_rate, hit / n AS accuracy,
    CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS recall FROM b)"""
RATES = ", ".join(f"{r(c)} AS {c}" for c in ("positive_rate", "predicted_positive_rate", "accuracy", "precision", "recall"))


@query("metrics_binary", f"WITH {SC}, {BINARY} SELECT model_name, n, {RATES} FROM bm")
def metrics_binary(spark, sf):
    return rounded(evaluate.binary_metrics(scored_items(spark, sf), "label", "prediction", BY))


STEPS = """st AS (SELECT model_name, score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY ALL),
  cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER a AS p, sum(neg) OVER a AS n FROM st
    WINDOW w AS (PARTITION BY model_name ORDER BY score DESC), a AS (PARTITION BY model_name)),
  au AS (SELECT model_name, sum(CAST(neg AS DOUBLE) * (tp - pos + pos / 2.0)) / (max(p) * max(n)) AS auc,
    greatest(0, max(tp / p - fp / n)) AS ks, sum(tp / (tp + fp) * (pos / p)) AS pr FROM cu GROUP BY 1)"""


@query("auc_exact", f"WITH {SC}, {STEPS} SELECT model_name, {r('auc')} AS auc FROM au")
def auc_exact(spark, sf):
    return rounded(evaluate.auc_ks(scored_items(spark, sf), "label", "score", BY).select("model_name", "auc"))


@query("ks_stat", f"WITH {SC}, {STEPS} SELECT model_name, {r('ks')} AS ks FROM au")
def ks_stat(spark, sf):
    return rounded(evaluate.auc_ks(scored_items(spark, sf), "label", "score", BY).select("model_name", "ks"))


@query("auc_pr", f"WITH {SC}, {STEPS} SELECT model_name, {r('pr')} AS auc_pr FROM au")
def auc_pr(spark, sf):
    return rounded(evaluate.average_precision(scored_items(spark, sf), "label", "score", BY))


# over the whole table at once, without groups
@query("auc_overall", f"""WITH {SC}, {STEPS.replace('SELECT model_name, score', "SELECT 1 AS model_name, score")}
  SELECT {r('auc')} AS auc, {r('ks')} AS ks FROM au""")
def auc_overall(spark, sf):
    return rounded(evaluate.auc_ks(scored_items(spark, sf), "label", "score"))


ROC = STEPS.replace("model_name", "split")


@query("roc_curve", f"""WITH {SC}, {ROC} SELECT split, {r('score', 9)} AS threshold, {r('tp / p', 9)} AS tpr, {r('fp / n', 9)} AS fpr FROM cu
  UNION ALL SELECT DISTINCT split, NULL, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM sc""")
def roc_curve(spark, sf):
    return rounded(evaluate.roc_curve(scored_items(spark, sf), "label", "score", ["split"]), 9)


@query("ks_curve", f"""WITH {SC}, {ROC} SELECT split, {r('score', 9)} AS threshold, {r('tp / p', 9)} AS tpr, {r('fp / n', 9)} AS fpr,
  {r('tp / p - fp / n', 9)} AS distance FROM cu
  UNION ALL SELECT DISTINCT split, NULL, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM sc""")
def ks_curve(spark, sf):
    return rounded(evaluate.ks_curve(scored_items(spark, sf), "label", "score", ["split"]), 9)


@query("ks_threshold", f"""WITH {SC}, {ROC}, d AS (SELECT split, round(tp / p - fp / n, 12) AS d, score FROM cu)
  SELECT split, {r('max(d)')} AS ks, {r('max(score) FILTER (d = m)')} AS threshold
  FROM d JOIN (SELECT split, max(d) AS m FROM d GROUP BY 1) USING (split) GROUP BY split""")
def ks_threshold(spark, sf):
    return rounded(evaluate.ks_threshold(scored_items(spark, sf), "label", "score", ["split"]))


@query("score_histogram", f"""WITH {SC}, c AS (SELECT split, CAST(least(floor(score * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM sc
    WHERE score BETWEEN 0 AND 1 GROUP BY ALL),
  f AS (SELECT split, CAST(b AS INTEGER) AS bin FROM (SELECT DISTINCT split FROM sc), unnest(range(50)) AS t(b))
  SELECT split, bin, {r('bin / 50.0')} AS low, {r('(bin + 1) / 50.0')} AS high, coalesce(n, 0) AS n FROM f LEFT JOIN c USING (split, bin)""")
def score_histogram(spark, sf):
    return rounded(evaluate.score_histogram(scored_items(spark, sf), "score", 50, ["split"]))


def _guesses(spark, sf):
    """A rough guess of the price from the quantity."""
    return table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * 2000).alias("guess"),
        F.when(F.col("l_orderkey") % 10 < 7, "train").otherwise("test").alias("split"))


GU = """gu AS (SELECT l_extendedprice AS price, l_quantity * 2000 AS guess,
  CASE WHEN l_orderkey % 10 < 7 THEN 'train' ELSE 'test' END AS split FROM lineitem)"""


@query("metrics_regression", f"""WITH {GU} SELECT split, {r('avg(pow(price - guess, 2))', 1)} AS mse, {r('sqrt(avg(pow(price - guess, 2)))', 4)} AS rmse,
  {r('avg(abs(price - guess))', 4)} AS mae, {r('1 - avg(pow(price - guess, 2)) / var_pop(price)')} AS r2,
  {r('avg(abs(price - guess) / greatest(abs(price), 2.220446049250313e-16))')} AS mape FROM gu GROUP BY split""")
def metrics_regression(spark, sf):
    return rounded(evaluate.regression_metrics(_guesses(spark, sf), "price", "guess", ["split"]), mse=1, rmse=4, mae=4)


@query("error_histogram", f"""WITH {GU}, m AS (SELECT max(abs(price - guess)) AS m, count(*) AS t FROM gu),
  c AS (SELECT CAST(least(floor(abs(price - guess) * 19 / m), 18) AS INTEGER) AS bin, count(*) AS n FROM gu, m GROUP BY 1),
  f AS (SELECT CAST(b AS INTEGER) AS bin FROM unnest(range(19)) AS t(b))
  SELECT bin, {r('bin * m / 19', 4)} AS low, {r('(bin + 1) * m / 19', 4)} AS high, coalesce(n, 0) AS n,
    {r('coalesce(n, 0) * 100.0 / t')} AS percent FROM f LEFT JOIN c USING (bin), m""")
def error_histogram(spark, sf):
    return rounded(evaluate.error_histogram(_guesses(spark, sf), "price", "guess"), low=4, high=4)



@query("evaluate_bundle", f"""WITH {SC}, {CM[CM.index('cm AS'):].replace('model_name', 'split')}, {ROC},
  w AS (SELECT av.*, auc, ks FROM av JOIN au USING (split))
  SELECT split, 'classification' AS task_type, m AS metric, {r('v')} AS value FROM (
    SELECT split, unnest(['accuracy', 'precision', 'recall', 'f1', 'auc', 'ks']) AS m,
      unnest([acc, wp, wr, wf, auc, ks]) AS v FROM w)""")
def evaluate_bundle(spark, sf):
    return rounded(evaluate.evaluate_bundle(scored_items(spark, sf), "classification", "label", "prediction", "score"))


def _results(spark, sf):
    s = scored_items(spark, sf)
    return evaluate.weighted_metrics(s, "label", "prediction", BY).join(evaluate.auc_ks(s, "label", "score", BY), BY)


RESULTS = f"{CM}, {STEPS}, res AS (SELECT av.model_name, acc, wp, wr, wf, auc, ks FROM av JOIN au USING (model_name))"


@query("model_comparison", f"""WITH {RESULTS} SELECT model_name, {r('acc')} AS accuracy, {r('wp')} AS precision, {r('wr')} AS recall,
  {r('wf')} AS f1, {r('auc')} AS auc, {r('ks')} AS ks FROM res ORDER BY auc DESC, model_name""")
def model_comparison(spark, sf):
    return rounded(evaluate.compare_models(_results(spark, sf), "auc"))


@query("best_model", f"""WITH {RESULTS} SELECT model_name, {r('auc')} AS auc FROM res ORDER BY round(auc, 9) DESC, model_name LIMIT 1""")
def best_model(spark, sf):
    return rounded(evaluate.best_model(rounded(_results(spark, sf), 9), "auc"))


# one job per customer segment and nation; a job failed when its balance is negative
JOBS = """jobs AS (SELECT c_mktsegment AS seg, c_nationkey AS nat,
  CASE WHEN sum(c_acctbal) < 20000 THEN 'failed' ELSE 'success' END AS status FROM customer GROUP BY ALL)"""


@query("batch_summary", f"""WITH {JOBS} SELECT count(*) AS total, count(*) FILTER (status = 'success') AS succeeded,
  count(*) FILTER (status <> 'success') AS failed, {r("count(*) FILTER (status = 'success') / count(*)")} AS success_rate FROM jobs""")
def batch_summary(spark, sf):
    jobs = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.when(F.sum("c_acctbal") < 20000, "failed").otherwise("success").alias("status"))
    return rounded(evaluate.batch_summary(jobs))


@query("importance_from_statistics", f"""SELECT p_brand AS feature, {r('sum(p_retailprice)', 3)} AS importance,
  {r('sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part)')} AS ratio,
  {r('sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part) * 700')} AS weight FROM part GROUP BY p_brand""")
def importance_from_statistics(spark, sf):
    imp = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return rounded(evaluate.importance_table(imp), importance=3)




# groups, labels and scores with gaps: a group of NULLs, and scores that are NULL or not a number
GAPS = """gp AS (SELECT CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type END AS grp, CAST(event_id % 3 = 0 AS INTEGER) AS label,
    value AS score, event_id FROM events WHERE event_id % 7 > 1),
  rn AS (SELECT grp, label, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS place FROM gp)"""


@query("auc_by_group_nulls", f"""WITH {GAPS}, s AS (SELECT grp, sum(place) FILTER (label = 1) AS above, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS p,
    CAST(count(*) FILTER (label = 0) AS DOUBLE) AS n FROM rn GROUP BY grp)
  SELECT grp, {r('(above - p * (p + 1) / 2) / (p * n)')} AS auc FROM s""")
def auc_by_group_nulls(spark, sf):
    gap = F.col("event_id") % 7
    e = table(spark, sf, "events").select(
        F.when(F.col("user_id") % 4 != 0, F.col("event_type")).alias("grp"), (F.col("event_id") % 3 == 0).cast("int").alias("label"),
        F.when(gap == 1, F.lit(float("nan"))).when(gap > 1, F.col("value")).alias("score"))
    return rounded(evaluate.auc_ks(e, "label", "score", ["grp"]).select("grp", "auc"))


# ---- permutation importance of a fixed linear model ----------------------------------

_PLACED = """placed AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice AS y, count(*) OVER () AS n,
    row_number() OVER (ORDER BY md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber))) - 1 AS p FROM lineitem)"""
_PREDICTED = "20000 + 1000.0 * {} + 50000.0 * {} - 10000.0 * {}"


def _fallen(k: int, repeat: int) -> str:
    names = ["x.a", "x.b", "x.c"]
    names[k] = names[k].replace("x.", "d.")
    shift = 1 + k * 3 + repeat
    return (f"SELECT '{('l_quantity', 'l_discount', 'l_tax')[k]}' AS feature, avg(pow({_PREDICTED.format(*names)} - x.y, 2)"
            f" - pow({_PREDICTED.format('x.a', 'x.b', 'x.c')} - x.y, 2)) / var_pop(x.y) AS fall"
            f" FROM placed x JOIN placed d ON d.p = (x.p + {shift}) % x.n")


@query("permutation_importance", f"""WITH {_PLACED}, falls AS ({' UNION ALL '.join(_fallen(k, i) for k in range(3) for i in range(3))})
  SELECT feature, {r('avg(fall)')} AS importance_mean, {r('stddev_pop(fall)')} AS importance_std, 3 AS repeats FROM falls GROUP BY feature""")
def permutation_importance(spark, sf):
    df = table(spark, sf, "lineitem")
    names = ["l_quantity", "l_discount", "l_tax"]
    y = F.lit(20000.0) + 1000.0 * F.col(names[0]) + 50000.0 * F.col(names[1]) - 10000.0 * F.col(names[2])
    found = permutation.permutation_importance(df, lambda rows: rows.withColumn("prediction", y), "l_extendedprice", names,
                                               ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "r2", 3)
    return rounded(found)
