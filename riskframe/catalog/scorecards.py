from datetime import datetime

from pyspark.sql import functions as F

from riskframe.catalog.registry import LI_NUM, SC, long_sql, query, r, rounded, scored_items, table
from riskframe.catalog.selection import COUNTS, LI2, TEXT, items
from riskframe.operators import binning, scorecard, scoring

WOE_BINS = f"""{COUNTS}, lim AS (SELECT feature, e[2:len(e) - 1] AS c FROM edges),
  wb AS (SELECT w.feature, w.bin, w.good, w.bad, w.woe,
    CASE WHEN w.bin <> 'missing' AND TRY_CAST(w.bin AS INTEGER) > 0 THEN c[TRY_CAST(w.bin AS INTEGER)] END AS low,
    CASE WHEN w.bin <> 'missing' AND TRY_CAST(w.bin AS INTEGER) < len(c) THEN c[TRY_CAST(w.bin AS INTEGER) + 1] END AS high
    FROM woe w LEFT JOIN lim USING (feature))"""


@query("woe_bins", f"""WITH {WOE_BINS} SELECT feature, bin, {r('low')} AS low, {r('high')} AS high, CAST(good AS BIGINT) AS good,
  CAST(bad AS BIGINT) AS bad, {r('woe')} AS woe FROM wb""")
def woe_bins(spark, sf):
    model = scorecard.fit_woe(items(spark, sf), "label", LI_NUM, TEXT)
    return rounded(model.bins().select("feature", "bin", "low", "high", "good", "bad", "woe"))


# every set of cuts of twelve fine bins, the valid one with the greatest information value
_SUPERVISED = f"""WITH {LI2}, long AS ({long_sql(LI_NUM, 'l2')}),
  lim AS (SELECT feature, e[2:len(e) - 1] AS c FROM (SELECT feature, list_sort(list_distinct(quantile_cont(x, {[k / 12 for k in range(13)]}))) AS e
    FROM long GROUP BY feature)),
  fine AS (SELECT feature, len(list_filter(c, lambda v: v < x)) AS b, count(*) - sum(label) AS good, sum(label) AS bad FROM long JOIN lim USING (feature)
    WHERE x IS NOT NULL GROUP BY ALL),
  known AS (SELECT feature, sum(good) AS tg, sum(bad) AS tb FROM fine GROUP BY feature),
  masks AS (SELECT feature, unnest(range(0, 1 << len(c))) AS m FROM lim),
  parts AS (SELECT feature, m, bit_count(m & ((1 << b) - 1)) AS s, sum(good) AS good, sum(bad) AS bad FROM masks JOIN fine USING (feature) GROUP BY ALL),
  rated AS (SELECT *, bad / (good + bad) AS rate, good > 0 AND bad > 0 AND good + bad >= 0.05 * (tg + tb) AS fits,
    CASE WHEN good > 0 AND bad > 0 THEN (bad / tb - good / tg) * ln((bad / tb) / (good / tg)) END AS iv FROM parts JOIN known USING (feature)),
  steps AS (SELECT *, rate - lag(rate) OVER (PARTITION BY feature, m ORDER BY s) AS step FROM rated),
  best AS (SELECT feature, arg_max(m, iv) AS m FROM (SELECT feature, m, sum(iv) AS iv FROM steps GROUP BY feature, m
    HAVING bool_and(fits) AND count(*) <= 5 AND (count(*) = 1 OR bool_and(step > 0) OR bool_and(step < 0))) GROUP BY feature),
  kept AS (SELECT feature, list_filter(c, lambda v, i: (m >> (i - 1)) & 1 = 1) AS c FROM lim JOIN best USING (feature)),
  whole AS (SELECT feature, count(*) - sum(label) AS ag, sum(label) AS ab FROM long GROUP BY feature)"""


@query("woe_bins_supervised", f"""{_SUPERVISED} SELECT feature, CAST(s AS VARCHAR) AS bin, {r('c[s]')} AS low, {r('c[s + 1]')} AS high,
    CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad, {r('ln((bad / ab) / (good / ag))')} AS woe
  FROM parts JOIN best USING (feature, m) JOIN kept USING (feature) JOIN whole USING (feature)""")
def woe_bins_supervised(spark, sf):
    model = binning.fit_woe_supervised(items(spark, sf), "label", LI_NUM, fine=12, bins=5)
    found = model.bins().where(F.col("bin") != "missing").select("feature", "bin", "low", "high", "good", "bad", "woe")
    return rounded(found)


def _bin_of(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN 'missing' ELSE CAST(len(list_filter((SELECT c FROM lim WHERE feature = '{c}'), "
            f"lambda v: v < {c})) AS VARCHAR) END")


def _woe_of(c: str, b: str, column: str = "woe", source: str = "woe") -> str:
    return f"LEFT JOIN (SELECT bin AS b_{c}, {column} AS w_{c} FROM {source} WHERE feature = '{c}') ON b_{c} = {b}"


_SCORED_BINS = f"""{WOE_BINS}, b AS (SELECT *, {_bin_of('qty')} AS bq, {_bin_of('tax')} AS bt, coalesce(flag, 'missing') AS bf FROM l2)"""


@query("woe_transform", f"""WITH {_SCORED_BINS} SELECT l_orderkey, l_partkey, {r('coalesce(w_qty, 0)')} AS qty_woe, {r('coalesce(w_tax, 0)')} AS tax_woe,
  {r('coalesce(w_flag, 0)')} AS flag_woe FROM b {_woe_of('qty', 'bq')} {_woe_of('tax', 'bt')} {_woe_of('flag', 'bf')}""")
def woe_transform(spark, sf):
    df = items(spark, sf)
    model = scorecard.fit_woe(df, "label", ["qty", "tax"], ["flag"])
    return rounded(model.transform(df).select("l_orderkey", "l_partkey", "qty_woe", "tax_woe", "flag_woe"))


# Given coefficients of a logistic model on the evidence columns.
COEF = {"qty": 0.8, "tax": 1.1, "flag": 0.5}
INTERCEPT = -1.2
_CARD = f"""{_SCORED_BINS}, cf AS (SELECT unnest(['qty', 'tax', 'flag']) AS feature, unnest([0.8, 1.1, 0.5]) AS coef),
  card AS (SELECT feature, bin, woe, -(20 / ln(2)) * coef * woe AS points FROM woe JOIN cf USING (feature))"""
_BASE = "600 + (20 / ln(2)) * ln(50) - (20 / ln(2)) * (-1.2)"


@query("scorecard_points", f"""WITH {_CARD} SELECT feature, bin, {r('woe')} AS woe, {r('points')} AS points FROM card
  UNION ALL SELECT 'basepoints', NULL, NULL, {r(_BASE)}""")
def scorecard_points(spark, sf):
    model = scorecard.fit_woe(items(spark, sf), "label", ["qty", "tax"], ["flag"])
    return rounded(scorecard.scorecard_points(model.table, COEF, INTERCEPT, digits=None))


@query("apply_points", f"""WITH {_CARD} SELECT l_orderkey, l_partkey,
  {r(f'{_BASE} + coalesce(w_qty, 0) + coalesce(w_tax, 0) + coalesce(w_flag, 0)', 5)} AS score
  FROM b {_woe_of('qty', 'bq', 'points', 'card')} {_woe_of('tax', 'bt', 'points', 'card')} {_woe_of('flag', 'bf', 'points', 'card')}""")
def apply_points(spark, sf):
    df = items(spark, sf)
    model = scorecard.fit_woe(df, "label", ["qty", "tax"], ["flag"])
    card = scorecard.scorecard_points(model.table, COEF, INTERCEPT, digits=None)
    return rounded(scorecard.apply_points(df, model, card).select("l_orderkey", "l_partkey", "score"), 5)


# a leaf is a coarse cell of the score, some leaves unknown to the card
LEAF = f"""{SC}, lf AS (SELECT *, CAST(floor(score * 12) AS INTEGER) AS leaf FROM sc),
  ls AS (SELECT leaf, avg(score) AS p0, count(*) AS n FROM lf WHERE split = 'train' AND leaf <> 5 GROUP BY 1),
  lc AS (SELECT leaf, least(greatest(p0, 0.001), 0.999) AS p, n FROM ls),
  ld AS (SELECT leaf, p, n, p / (1 - p) AS odds, CAST(round(600 - (20 / ln(2)) * ln(p / (1 - p))) AS INTEGER) AS score FROM lc)"""


def _leaves(spark, sf, unknown=-1):
    df = scored_items(spark, sf).withColumn("leaf", F.floor(F.col("score") * 12).cast("int"))
    return df, scorecard.leaf_scores(df.where((F.col("split") == "train") & (F.col("leaf") != unknown)), "leaf", "score")


@query("leaf_scores", f"WITH {LEAF.replace('AND leaf <> 5', '')} SELECT leaf, {r('p')} AS probability, n, {r('odds')} AS odds, score FROM ld")
def leaf_scores(spark, sf):
    return rounded(_leaves(spark, sf)[1])


@query("apply_leaf", f"""WITH {LEAF} SELECT lf.leaf, coalesce(ld.score, 300) AS score, count(*) AS n FROM lf LEFT JOIN ld ON lf.leaf = ld.leaf
  GROUP BY ALL""")
def apply_leaf(spark, sf):
    df, scores = _leaves(spark, sf, unknown=5)
    return scorecard.apply_leaf(df.drop("score"), "leaf", scores).groupBy("leaf", "score").agg(F.count(F.lit(1)).alias("n"))


@query("prob_to_score", f"""WITH {SC}, p AS (SELECT *, least(greatest(score, 0.001), 0.999) AS q FROM sc)
  SELECT label, split, {r('score')} AS probability, CAST(round(600 - (20 / ln(2)) * ln(q / (1 - q))) AS INTEGER) AS points FROM p""")
def prob_to_score(spark, sf):
    return rounded(scored_items(spark, sf).select("label", "split", F.col("score").alias("probability"),
                                                  scorecard.prob_to_score(F.col("score")).alias("points")))


# Centred values of three columns, so that all bins of the card are used.
ZX = """zx AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE (l_quantity - 25) / 16.0 END AS q,
  (l_discount - 0.05) * 32 AS d, (l_tax - 0.04) * 64 AS t FROM lineitem)"""
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
SHARES = {"q": 5.0, "d": 3.0, "t": 2.0}


def centred(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        *KEYS, F.when(c("l_orderkey") % 7 != 0, (c("l_quantity") - 25) / 16.0).alias("q"),
        ((c("l_discount") - 0.05) * 32).alias("d"), ((c("l_tax") - 0.04) * 64).alias("t"))


def _edge(c: str, w: float) -> str:
    v = f"round(coalesce({c}, 0), 9)"
    return (f"CASE WHEN {v} < -1 THEN {-0.5 * w} WHEN {v} < -0.5 THEN {-0.3 * w} WHEN {v} < 0 THEN 0 WHEN {v} < 0.5 THEN {0.3 * w} "
            f"WHEN {v} < 1 THEN {0.5 * w} ELSE {0.7 * w} END")


def _smooth(df):
    """Rounded inputs: a value on a bin limit must not depend on the last digit."""
    return df.select(*KEYS, *[F.round(c, 9).alias(c) for c in SHARES])


WEIGHTS = scorecard.importance_weights(SHARES)
_W = {"q": 350.0, "d": 210.0, "t": 140.0}
_TOTAL = "300 + " + " + ".join(f"CAST({_edge(c, w)} AS DOUBLE)" for c, w in _W.items())
_CARD_SCORE = f"CAST(greatest(0, least(1000, trunc({_TOTAL}))) AS INTEGER)"


@query("weighted_bins", f"""SELECT feature, {r('weight')} AS weight, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, {r('weight * s')} AS score FROM
  (SELECT p_type AS feature, sum(p_size) / (SELECT sum(p_size) FROM part) * 700 AS weight FROM part GROUP BY 1),
  (SELECT unnest(['-inf', '-1', '-0.5', '0', '0.5', '1']) AS low, unnest(['-1', '-0.5', '0', '0.5', '1', 'inf']) AS high,
     unnest([-0.5, -0.3, 0, 0.3, 0.5, 0.7]) AS s)""")
def weighted_bins(spark, sf):
    sizes = table(spark, sf, "part").groupBy("p_type").agg(F.sum("p_size").alias("s")).collect()  # a few types
    weights = scorecard.importance_weights({x["p_type"]: x["s"] for x in sizes})
    return rounded(scorecard.weighted_bins(spark, weights))


@query("apply_weighted_bins", f"WITH {ZX} SELECT {', '.join(KEYS)}, {_CARD_SCORE} AS score FROM zx")
def apply_weighted_bins(spark, sf):
    return scorecard.apply_weighted_bins(_smooth(centred(spark, sf)), WEIGHTS).select(*KEYS, "score")


@query("score_to_prob", f"""WITH {ZX}, s AS (SELECT {', '.join(KEYS)}, {_CARD_SCORE} AS score FROM zx)
  SELECT {', '.join(KEYS)}, score, {r('pow(2, (score - 300) / 20.0) / (1 + pow(2, (score - 300) / 20.0))')} AS probability FROM s""")
def score_to_prob(spark, sf):
    df = scorecard.apply_weighted_bins(_smooth(centred(spark, sf)), WEIGHTS)
    return rounded(df.select(*KEYS, "score", scorecard.score_to_prob(F.col("score")).alias("probability")))


@query("risk_band_5", f"""WITH {ZX}, s AS (SELECT {_CARD_SCORE} AS score FROM zx) SELECT CASE WHEN score >= 800 THEN '优秀'
  WHEN score >= 700 THEN '良好' WHEN score >= 600 THEN '一般' WHEN score >= 500 THEN '风险' ELSE '高风险' END AS band, count(*) AS n
  FROM s GROUP BY 1""")
def risk_band_5(spark, sf):
    df = scorecard.apply_weighted_bins(_smooth(centred(spark, sf)), WEIGHTS)
    return df.groupBy(scorecard.risk_band_5(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("score_contrib", f"WITH {ZX} " + " UNION ALL ".join(
    f"SELECT {', '.join(KEYS)}, {r(_TOTAL)} AS total, '{c}' AS feature, {r(f'coalesce({c}, 0)')} AS value, {r(_edge(c, w))} AS score FROM zx"
    for c, w in _W.items()))
def score_contrib(spark, sf):
    return rounded(scorecard.bin_contributions(_smooth(centred(spark, sf)), KEYS, WEIGHTS))


LIN = {"d": 12.0, "t": 8.0}
LIN_WEIGHTS = scorecard.importance_weights(LIN, scorecard.LINEAR_WEIGHT)


def _norm(c: str) -> str:
    return f"((greatest(-3, least(3, round({c}, 9))) + 3) * 100 / 6)"


LIN_SCORE = f"CAST(greatest(300, least(850, trunc(round(600 + {_norm('d')} * 60 * 0.02 + {_norm('t')} * 40 * 0.02, 6)))) AS INTEGER)"


def _linear(spark, sf):
    # the score is cut to a whole number, so its inputs are rounded to keep both engines on one side
    df = _smooth(centred(spark, sf))
    return scorecard.linear_score(df, LIN_WEIGHTS, scale=0.02)


@query("linear_score", f"WITH {ZX} SELECT {', '.join(KEYS)}, {LIN_SCORE} AS score FROM zx")
def linear_score(spark, sf):
    return _linear(spark, sf).select(*KEYS, "score")


@query("linear_prob", f"""WITH {ZX}, s AS (SELECT {LIN_SCORE} AS score FROM zx), g AS (SELECT score, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT score, n, (score - 600) / 20.0 * ln(2) AS lo FROM g),
  q AS (SELECT *, greatest(0.001, least(0.999, exp(lo) / (1 + exp(lo)))) AS pr FROM p)
  SELECT score, n, {r('lo')} AS log_odds, {r('pr')} AS probability, CAST(pr > 0.5 AS INTEGER) AS predicted FROM q""")
def linear_prob(spark, sf):
    scores = _linear(spark, sf).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    cols = scorecard.linear_probability(F.col("score"))
    return rounded(scores.select("score", "n", *[e.alias(c) for c, e in cols.items()]))


@query("risk_band_6", f"""WITH {ZX}, s AS (SELECT {LIN_SCORE} AS score FROM zx) SELECT CASE WHEN score >= 750 THEN '极低风险'
  WHEN score >= 700 THEN '低风险' WHEN score >= 650 THEN '中等风险' WHEN score >= 600 THEN '中高风险' WHEN score >= 550 THEN '高风险'
  ELSE '极高风险' END AS band, count(*) AS n FROM s GROUP BY 1""")
def risk_band_6(spark, sf):
    return _linear(spark, sf).groupBy(scorecard.risk_band_6(F.col("score")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("linear_contrib", f"WITH {ZX} " + " UNION ALL ".join(
    f"SELECT {', '.join(KEYS)}, {r(f'600 + {_norm(chr(100))} * 60 + {_norm(chr(116))} * 40')} AS total, '{c}' AS feature, "
    f"{r(f'round({c}, 9)')} AS value, {r(_norm(c))} AS normalised, CAST({w} AS DOUBLE) AS weight, {r(f'{_norm(c)} * {w}')} AS contribution FROM zx"
    for c, w in (("d", 60), ("t", 40))))
def linear_contrib(spark, sf):
    return rounded(scorecard.linear_contributions(_smooth(centred(spark, sf)), KEYS, LIN_WEIGHTS))


@query("score_stats", f"""WITH {ZX}, s AS (SELECT {LIN_SCORE} AS score FROM zx) SELECT min(score) AS min_score, max(score) AS max_score,
  {r('avg(score)')} AS avg_score, {r('stddev_pop(score)')} AS std_score FROM s""")
def score_stats(spark, sf):
    return rounded(scorecard.score_statistics(_linear(spark, sf), "score"))


# ---- batch scoring with a fixed linear model -----------------------------------------

_Z = "1 / (1 + exp(-(-0.5 + 0.04 * (l_quantity - 25) - 6 * l_discount + 9 * l_tax)))"
AT = datetime(2024, 2, 1, 12, 0, 0)


def fixed_model(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("q25", F.col("l_quantity") - 25)
    p = scoring.logistic({"q25": 0.04, "l_discount": -6.0, "l_tax": 9.0}, -0.5)
    return df.withColumn("probability", F.round(p, 9)).withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


@query("score_with_provenance", f"""SELECT l_orderkey, l_partkey, l_suppkey, {r(_Z)} AS probability,
  CAST(round({_Z}, 9) > 0.5 AS INTEGER) AS prediction, 'LR' AS model_name, 'v1' AS model_version, '2024-02-01 12:00:00' AS scored_at FROM lineitem""")
def score_with_provenance(spark, sf):
    out = scoring.with_provenance(fixed_model(spark, sf), "LR", "v1", AT)
    return rounded(out.select("l_orderkey", "l_partkey", "l_suppkey", "probability", "prediction", "model_name", "model_version",
                              F.lit(AT.strftime("%Y-%m-%d %H:%M:%S")).alias("scored_at")))


@query("score_summary", f"""WITH s AS (SELECT round({_Z}, 9) AS p FROM lineitem), t AS (SELECT p, CAST(p > 0.5 AS INTEGER) AS y FROM s)
  SELECT count(*) AS n, {r('avg(y)')} AS mean, {r('min(y)')} AS min, {r('max(y)')} AS max, {r('stddev_pop(y)')} AS std,
  count(*) FILTER (y > 0.5) AS positives, count(*) FILTER (y <= 0.5) AS negatives, {r('avg(p)')} AS mean_probability FROM t""")
def score_summary(spark, sf):
    return rounded(scoring.score_summary(fixed_model(spark, sf)))
