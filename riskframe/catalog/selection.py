from pyspark.sql import functions as F

from riskframe.catalog.registry import BIN, EDGES, LI, LI_NUM, line_items, long_sql, query, r, rounded
from riskframe.operators import screening
from riskframe.plans import explore

TEXT = ["flag", "status"]
_LABEL2 = "CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END"
LI2 = LI + f", l2 AS (SELECT l_orderkey, l_partkey, qty, price, disc, tax, flag, status, {_LABEL2} AS label FROM li)"


def items(spark, sf):
    """lineitem with a label that is no function of the flag."""
    return line_items(spark, sf).withColumn("label", F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0)).drop(
        "l_suppkey", "l_linenumber")


COUNTS = f"""{LI2}, long AS ({long_sql(LI_NUM, 'l2')}), {EDGES},
  bins AS (SELECT feature, {BIN} AS bin, label FROM long JOIN edges USING (feature)
    UNION ALL SELECT 'flag', coalesce(flag, 'missing'), label FROM l2
    UNION ALL SELECT 'status', coalesce(status, 'missing'), label FROM l2),
  counts AS (SELECT feature, bin, count(*) FILTER (label = 0) AS good, count(*) FILTER (label = 1) AS bad FROM bins GROUP BY ALL),
  tot AS (SELECT feature, sum(good) AS g, sum(bad) AS b FROM counts GROUP BY 1),
  woe AS (SELECT feature, bin, good, bad, good > 0 AND bad > 0 AS filled,
    CASE WHEN good > 0 AND bad > 0 THEN ln((bad / b) / (good / g)) ELSE 0 END AS woe,
    CASE WHEN good > 0 AND bad > 0 THEN (bad / b - good / g) * ln((bad / b) / (good / g)) ELSE 0 END AS iv_part
    FROM counts JOIN tot USING (feature))"""


@query("woe_table", f"""WITH {COUNTS} SELECT feature, bin, CAST(good AS BIGINT) AS good, CAST(bad AS BIGINT) AS bad,
  {r('woe')} AS woe, {r('iv_part', 9)} AS iv_part, NOT filled AS empty_cell FROM woe""")
def woe_table(spark, sf):
    return rounded(screening.woe_table(items(spark, sf), "label", LI_NUM, TEXT), iv_part=9)


@query("sel_iv", f"""WITH {COUNTS}, iv AS (SELECT feature, round(abs(sum(iv_part)), 9) AS iv FROM woe GROUP BY feature)
  SELECT feature, {r('iv', 9)} AS iv, iv >= 0.0002 AS kept FROM iv""")
def sel_iv(spark, sf):
    iv = screening.information_values(items(spark, sf), "label", LI_NUM, TEXT, 0.0002)
    return rounded(iv, 9)


@query("sel_missing_rate", f"""WITH {LI} SELECT feature, {r('rate')} AS missing_rate, rate <= 0.12 AS kept FROM (
  SELECT 'tax' AS feature, avg(CASE WHEN tax IS NULL THEN 1.0 ELSE 0.0 END) AS rate FROM li UNION ALL
  SELECT 'status', avg(CASE WHEN status IS NULL THEN 1.0 ELSE 0.0 END) FROM li UNION ALL
  SELECT 'qty', avg(CASE WHEN qty IS NULL THEN 1.0 ELSE 0.0 END) FROM li)""")
def sel_missing_rate(spark, sf):
    return rounded(screening.missing_rates(line_items(spark, sf), ["tax", "status", "qty"], 0.12))


_CORR = ["qty", "price", "disc", "tax", "net", "flat"]
LC = LI + """, lc AS (SELECT qty, price, disc, tax, price * (1 - disc) + 20 * qty AS net, CAST(5.1 AS DOUBLE) AS flat FROM li)"""


def correlated(spark, sf):
    return line_items(spark, sf).select("qty", "price", "disc", "tax",
                                        (F.col("price") * (1 - F.col("disc")) + 20 * F.col("qty")).alias("net"),
                                        F.lit(5.1).alias("flat"))


def _pair(a: str, b: str) -> str:
    value = "max(CAST(NULL AS DOUBLE))" if "flat" in (a, b) else f"corr({a}, {b})"
    return f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(value)} AS r FROM lc"


PAIRS = " UNION ALL ".join(_pair(a, b) for j, b in enumerate(_CORR) for a in _CORR[:j])


@query("corr_matrix", f"WITH {LC} {PAIRS}")
def corr_matrix(spark, sf):
    return rounded(screening.correlation_table(correlated(spark, sf), _CORR))


@query("sel_correlation", f"""WITH {LC}, p AS ({PAIRS}), f AS (SELECT unnest({_CORR!r}) AS feature)
  SELECT feature, {r('max(abs(p.r))')} AS max_abs_r, coalesce(max(abs(p.r)), 0) <= 0.8 AS kept
  FROM f LEFT JOIN p ON p.feature_b = feature GROUP BY feature""")
def sel_correlation(spark, sf):
    return rounded(screening.correlation_screen(correlated(spark, sf), _CORR, 0.8))


@query("sel_variance", f"""WITH {LC} SELECT feature, {r('v', 4)} AS variance, v >= 0.01 AS kept FROM (
  SELECT 'qty' AS feature, var_samp(qty) AS v FROM lc UNION ALL SELECT 'disc', var_samp(disc) FROM lc
  UNION ALL SELECT 'tax', var_samp(tax) FROM lc UNION ALL SELECT 'flat', var_samp(flat) FROM lc)""")
def sel_variance(spark, sf):
    return rounded(screening.variances(correlated(spark, sf), ["qty", "disc", "tax", "flat"]), 4)


_CELLS = f"""{LI2}, long AS ({long_sql(LI_NUM, 'l2')}), {EDGES},
  bins AS (SELECT feature, {BIN} AS bin, label FROM long JOIN edges USING (feature)
    UNION ALL SELECT 'flag', coalesce(flag, 'missing'), label FROM l2
    UNION ALL SELECT 'status', coalesce(status, 'missing'), label FROM l2),
  xy AS (SELECT feature, bin, label, count(*) AS n FROM bins GROUP BY ALL),
  px AS (SELECT feature, bin, sum(n) AS nx FROM xy GROUP BY ALL),
  py AS (SELECT feature, label, sum(n) AS ny FROM xy GROUP BY ALL), pn AS (SELECT feature, sum(n) AS t FROM xy GROUP BY ALL)"""


@query("sel_mutual_info", f"""WITH {_CELLS}, s AS (SELECT feature, sum(n / t * ln((n * t) / (nx * ny))) AS mi
    FROM xy JOIN px USING (feature, bin) JOIN py USING (feature, label) JOIN pn USING (feature) GROUP BY feature)
  SELECT feature, {r('mi', 9)} AS mi, row_number() OVER (ORDER BY mi DESC) <= 3 AS kept FROM s""")
def sel_mutual_info(spark, sf):
    return rounded(screening.mutual_information(items(spark, sf), "label", LI_NUM, TEXT, 3), 9)


@query("sel_chi_square", f"""WITH {_CELLS}, s AS (SELECT feature, sum(pow(n - nx * ny / t, 2) / (nx * ny / t)) AS chi2
    FROM xy JOIN px USING (feature, bin) JOIN py USING (feature, label) JOIN pn USING (feature) GROUP BY feature)
  SELECT feature, {r('chi2', 5)} AS chi2, row_number() OVER (ORDER BY chi2 DESC) <= 3 AS kept FROM s""")
def sel_chi_square(spark, sf):
    return rounded(screening.chi_square(items(spark, sf), "label", LI_NUM, TEXT, 3), 5)


def _f_reg(c: str) -> str:
    return (f"SELECT '{c}' AS feature, pow(corr({c}, net), 2) * (count(*) FILTER ({c} IS NOT NULL) - 2)"
            f" / (1 - pow(corr({c}, net), 2)) AS f FROM lc")


@query("sel_f_regression", f"""WITH {LC}, s AS ({' UNION ALL '.join(_f_reg(c) for c in ('qty', 'disc', 'tax'))})
  SELECT feature, {r('f', 4)} AS f, row_number() OVER (ORDER BY f DESC) <= 2 AS kept FROM s
  UNION ALL SELECT 'flat', NULL, false""")
def sel_f_regression(spark, sf):
    return rounded(screening.f_regression(correlated(spark, sf), "net", ["qty", "disc", "tax", "flat"], 2), 4)


F_CLASS = f"""{LI2}, long AS ({long_sql(LI_NUM, 'l2')}), g AS (SELECT feature, label, count(x) AS n, avg(x) AS m, var_pop(x) AS v
    FROM long WHERE x IS NOT NULL GROUP BY ALL), t AS (SELECT feature, sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS mm
    FROM g GROUP BY 1),
  s AS (SELECT feature, (sum(n * pow(m - mm, 2)) / (any_value(k) - 1)) / (sum(n * v) / (any_value(nn) - any_value(k))) AS f
    FROM g JOIN t USING (feature) GROUP BY feature)"""


@query("sel_f_classif", f"WITH {F_CLASS} SELECT feature, {r('f', 5)} AS f, row_number() OVER (ORDER BY f DESC) <= 2 AS kept FROM s")
def sel_f_classif(spark, sf):
    return rounded(screening.f_classification(items(spark, sf), "label", LI_NUM, 2), 5)


@query("sel_vif", f"""WITH {LI}, c AS (SELECT corr(qty, price) AS r FROM li)
  SELECT unnest(['qty', 'price']) AS feature, {r('1 / (1 - r * r)')} AS vif, 1 / (1 - r * r) <= 10 AS kept FROM c""")
def sel_vif(spark, sf):
    return rounded(screening.variance_inflation(line_items(spark, sf), ["qty", "price"]))


# coefficients of three, two and one standardised features in closed form from the correlations
@query("sel_recursive", f"""WITH {LI}, w AS (SELECT qty, disc, tax, price FROM li WHERE qty IS NOT NULL AND disc IS NOT NULL AND tax IS NOT NULL AND price IS NOT NULL),
  c AS (SELECT corr(qty, disc) AS a, corr(qty, tax) AS b, corr(disc, tax) AS c, corr(qty, price) AS x, corr(disc, price) AS y, corr(tax, price) AS z FROM w),
  d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c),
  three AS (SELECT unnest(['qty', 'disc', 'tax']) AS feature, unnest([((1 - c * c) * x + (b * c - a) * y + (a * c - b) * z) / det,
    ((b * c - a) * x + (1 - b * b) * y + (a * b - c) * z) / det, ((a * c - b) * x + (a * b - c) * y + (1 - a * a) * z) / det]) AS beta FROM d),
  one AS (SELECT feature, beta FROM three ORDER BY abs(beta) LIMIT 1),
  two AS (SELECT unnest(CASE one.feature WHEN 'qty' THEN ['disc', 'tax'] WHEN 'disc' THEN ['qty', 'tax'] ELSE ['qty', 'disc'] END) AS feature,
    unnest(CASE one.feature WHEN 'qty' THEN [(y - c * z) / (1 - c * c), (z - c * y) / (1 - c * c)] WHEN 'disc' THEN [(x - b * z) / (1 - b * b), (z - b * x) / (1 - b * b)]
      ELSE [(x - a * y) / (1 - a * a), (y - a * x) / (1 - a * a)] END) AS beta FROM one, d),
  next AS (SELECT feature, beta FROM two ORDER BY abs(beta) LIMIT 1),
  last AS (SELECT f.feature, CASE f.feature WHEN 'qty' THEN x WHEN 'disc' THEN y ELSE z END AS beta FROM (SELECT feature FROM three
    EXCEPT SELECT feature FROM one EXCEPT SELECT feature FROM next) f, d)
  SELECT feature, 3 AS rank, {r('beta')} AS beta, false AS kept FROM one UNION ALL SELECT feature, 2, {r('beta')}, false FROM next
  UNION ALL SELECT feature, 1, {r('beta')}, true FROM last""")
def sel_recursive(spark, sf):
    return rounded(screening.recursive_elimination(line_items(spark, sf), "price", ["qty", "disc", "tax"], 1))


# chosen on the training rows by the F test, then counted in both tables
@query("select_k_best", f"""WITH {LI2.replace('l2 AS', 'l2all AS')}, l2 AS (SELECT * FROM l2all WHERE l_orderkey % 10 < 7),
  {F_CLASS[F_CLASS.index('long AS'):]}
  SELECT feature, (SELECT count(*) FROM l2) AS n_train, (SELECT count(*) FROM l2all WHERE l_orderkey % 10 >= 7) AS n_test
  FROM s ORDER BY f DESC LIMIT 2""")
def select_k_best(spark, sf):
    df = items(spark, sf)
    train, test, names = screening.select_k_best(df.where("l_orderkey % 10 < 7"), df.where("l_orderkey % 10 >= 7"),
                                                 "label", LI_NUM, 2)
    n = train.agg(F.count(F.lit(1)).alias("n_train"), F.lit(1).alias("k")).join(
        test.agg(F.count(F.lit(1)).alias("n_test"), F.lit(1).alias("k")), "k")
    return n.select(F.explode(F.array(*[F.lit(c) for c in names])).alias("feature"), "n_train", "n_test")


SEQ = ["qty", "price", "disc", "tax", "net", "flat"]


def _sequence_table(spark, sf):
    return line_items(spark, sf).select(
        "qty", "price", "disc", F.when(F.col("l_orderkey") % 3 == 0, F.col("tax")).alias("tax"),
        (F.col("price") * (1 - F.col("disc")) + 20 * F.col("qty")).alias("net"), F.lit(5.1).alias("flat"),
        F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0).alias("label"))


# missing rate removes tax, correlation removes net and (if so high) price, variance removes disc and flat
@query("sel_sequential", f"""WITH {LI}, q AS (SELECT qty, price, disc, CASE WHEN l_orderkey % 3 = 0 THEN tax END AS tax,
    price * (1 - disc) + 20 * qty AS net, CAST(5.1 AS DOUBLE) AS flat FROM li),
  a AS (SELECT avg(CASE WHEN tax IS NULL THEN 1.0 ELSE 0.0 END) AS mr, abs(corr(qty, price)) AS r1, abs(corr(qty, net)) AS r2,
    abs(corr(price, net)) AS r3, greatest(abs(corr(qty, disc)), abs(corr(price, disc))) AS r4, var_samp(disc) AS vd FROM q)
  SELECT 'qty' AS feature, 'selected' AS status, '' AS step FROM a UNION ALL
  SELECT 'price', CASE WHEN r1 > 0.8 THEN 'removed' ELSE 'selected' END, CASE WHEN r1 > 0.8 THEN 'correlation' ELSE '' END FROM a
  UNION ALL SELECT 'disc', CASE WHEN r4 > 0.8 OR vd < 0.01 THEN 'removed' ELSE 'selected' END,
    CASE WHEN r4 > 0.8 THEN 'correlation' WHEN vd < 0.01 THEN 'variance' ELSE '' END FROM a
  UNION ALL SELECT 'tax', CASE WHEN mr > 0.5 THEN 'removed' ELSE 'selected' END, CASE WHEN mr > 0.5 THEN 'missing_rate' ELSE '' END FROM a
  UNION ALL SELECT 'net', CASE WHEN greatest(r2, r3) > 0.8 THEN 'removed' ELSE 'selected' END,
    CASE WHEN greatest(r2, r3) > 0.8 THEN 'correlation' ELSE '' END FROM a
  UNION ALL SELECT 'flat', 'removed', 'variance' FROM a""")
def sel_sequential(spark, sf):
    df = _sequence_table(spark, sf)
    selector = screening.FeatureSelector("label", correlation_threshold=0.8).fit(df, SEQ)
    return selector.summary(df)


@query("sel_all_steps")
def sel_all_steps(spark, sf):
    df = _sequence_table(spark, sf)
    selector = screening.FeatureSelector("label", methods=screening.ORDER, iv_threshold=0.0, mutual_info_k=4,
                                         importance_threshold=0.0, f_classif_k=2).fit(df, SEQ)
    return selector.summary(df)


@query("sel_importance")
def sel_importance(spark, sf):
    df = line_items(spark, sf)
    forest = screening.model_importance(df, "label", LI_NUM, family="RF")
    linear = screening.model_importance(df, "label", LI_NUM, family="LR")
    return forest.withColumn("family", F.lit("RF")).unionByName(linear.withColumn("family", F.lit("LR")))


@query("explore_features", f"""WITH {LI}, q AS (SELECT qty, price, price * (1 - disc) + 20 * qty AS net, status FROM li),
    a AS (SELECT abs(corr(qty, price)) AS r1, greatest(abs(corr(qty, net)), abs(corr(price, net))) AS r2 FROM q)
  SELECT feature, kept FROM (SELECT 'qty' AS feature, true AS kept FROM a UNION ALL SELECT 'price', r1 <= 0.8 FROM a
    UNION ALL SELECT 'net', r2 <= 0.8 FROM a UNION ALL SELECT 'status', true FROM a)""")
def explore_features(spark, sf):
    df = line_items(spark, sf).select("l_orderkey", "l_partkey", "qty", "price",
                                      (F.col("price") * (1 - F.col("disc")) + 20 * F.col("qty")).alias("net"),
                                      "status", "label")
    found = explore.explore_features(df, "label", ["qty", "price", "net"], ["status"], correlation_threshold=0.8)
    rows = [(c, c in found.sources) for c in ("qty", "price", "net", "status")]
    return spark.createDataFrame(rows, "feature string, kept boolean")


