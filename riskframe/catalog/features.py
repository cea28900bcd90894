from pyspark.sql import functions as F

from riskframe.catalog.registry import LI, OR, labelled_orders, line_items, query, r, rounded, table
from riskframe.catalog.sampling import FOLD, RANKED
from riskframe.operators import generate, preprocess, sampling
from riskframe.operators.preprocess import TabularPreprocessor

TEXT = ["flag", "status"]


def _imputed(df, fills):
    return df.select("l_orderkey", "l_partkey", *[preprocess.fill(c, v).alias(c) for c, v in fills.items()])


@query("impute_median", f"""WITH {LI}, m AS (SELECT median(tax) AS t, median(qty) AS q FROM li)
  SELECT l_orderkey, l_partkey, {r('coalesce(tax, t)')} AS tax, {r('coalesce(qty, q)')} AS qty FROM li, m""")
def impute_median(spark, sf):
    df = line_items(spark, sf)
    return rounded(_imputed(df, preprocess.medians(df, ["tax", "qty"])))


@query("impute_mean", f"""WITH {LI}, m AS (SELECT avg(tax) AS t FROM li)
  SELECT l_orderkey, l_partkey, {r('coalesce(tax, t)')} AS tax FROM li, m""")
def impute_mean(spark, sf):
    df = line_items(spark, sf)
    return rounded(_imputed(df, preprocess.means(df, ["tax"])))


@query("impute_mode", f"""WITH {LI}, m AS (SELECT status AS s FROM li WHERE status IS NOT NULL GROUP BY status
  ORDER BY count(*) DESC, status LIMIT 1) SELECT l_orderkey, l_partkey, coalesce(status, s) AS status FROM li, m""")
def impute_mode(spark, sf):
    df = line_items(spark, sf)
    return _imputed(df, preprocess.modes(df, ["status"]))


@query("impute_const", f"WITH {LI} SELECT l_orderkey, l_partkey, coalesce(status, 'missing') AS status FROM li")
def impute_const(spark, sf):
    return _imputed(line_items(spark, sf), {"status": "missing"})


@query("scale_standard", f"""WITH {LI}, m AS (SELECT avg(qty) AS aq, stddev_pop(qty) AS sq, avg(price) AS ap,
  stddev_pop(price) AS sp FROM li) SELECT l_orderkey, l_partkey, {r('(qty - aq) / sq')} AS qty,
  {r('(price - ap) / sp')} AS price FROM li, m""")
def scale_standard(spark, sf):
    df = line_items(spark, sf).select("l_orderkey", "l_partkey", "qty", "price")
    model = TabularPreprocessor(numericCols=["qty", "price"], scale="standard").fit(df)
    return rounded(model.transform(df))


@query("scale_minmax", f"""WITH {LI}, m AS (SELECT min(price) AS lo, max(price) AS hi FROM li)
  SELECT l_orderkey, l_partkey, {r('(price - lo) / (hi - lo)')} AS price FROM li, m""")
def scale_minmax(spark, sf):
    df = line_items(spark, sf).select("l_orderkey", "l_partkey", "price")
    return rounded(TabularPreprocessor(numericCols=["price"], scale="minmax").fit(df).transform(df))


@query("scale_robust", f"""WITH {LI}, m AS (SELECT median(price) AS mid, quantile_cont(price, 0.25) AS a,
  quantile_cont(price, 0.75) AS b FROM li) SELECT l_orderkey, l_partkey, {r('(price - mid) / (b - a)')} AS price FROM li, m""")
def scale_robust(spark, sf):
    df = line_items(spark, sf).select("l_orderkey", "l_partkey", "price")
    return rounded(TabularPreprocessor(numericCols=["price"], scale="robust").fit(df).transform(df))


@query("cap_outliers_iqr", """WITH m AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
  SELECT event_id, """ + r("greatest(least(value, b + 0.5 * (b - a)), a - 0.5 * (b - a))") + " AS value FROM events, m")
def cap_outliers_iqr(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return rounded(TabularPreprocessor(numericCols=["value"], scale="none", outliers="iqr", outlierLimit=0.5)
                   .fit(df).transform(df))


@query("cap_outliers_zscore", """WITH m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM events)
  SELECT event_id, """ + r("greatest(least(value, a + 1.5 * s), a - 1.5 * s)") + " AS value FROM events, m")
def cap_outliers_zscore(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return rounded(TabularPreprocessor(numericCols=["value"], scale="none", outliers="zscore", outlierLimit=1.5)
                   .fit(df).transform(df))


@query("transform_log", "SELECT event_id, " + r("ln(1 + value)") + " AS value FROM events")
def transform_log(spark, sf):
    return rounded(preprocess.log_transform(table(spark, sf, "events").select("event_id", "value"), ["value"]))


@query("transform_quantile", "SELECT event_id, " + r("cume_dist() OVER (ORDER BY value)") + " AS value_rank FROM events")
def transform_quantile(spark, sf):
    df = preprocess.quantile_rank(table(spark, sf, "events").select("event_id", "value"), "value")
    return rounded(df.select("event_id", "value_rank"))


_GRID = [i / 4 for i in range(-8, 9)]
_YJ = " UNION ALL ".join(
    f"SELECT CAST({g} AS DOUBLE) AS lam, -count(*) / 2.0 * ln(var_pop({f'(pow(value + 1, {g}) - 1) / {g}' if g else 'ln(1 + value)'}))"
    f" + ({g} - 1) * sum(ln(1 + value)) AS ll FROM events" for g in _GRID)


@query("transform_power", f"WITH s AS ({_YJ}) SELECT 'value' AS feature, lam AS lambda, {r('ll', 3)} AS log_likelihood "
       "FROM s ORDER BY ll DESC LIMIT 1")
def transform_power(spark, sf):
    return rounded(preprocess.power_lambda(table(spark, sf, "events"), ["value"], _GRID), 3)


_BC = " UNION ALL ".join(
    f"SELECT CAST({g} AS DOUBLE) AS lam, -count(*) / 2.0 * ln(var_pop({f'(pow(value, {g}) - 1) / {g}' if g else 'ln(value)'}))"
    f" + ({g} - 1) * sum(ln(value)) AS ll FROM events" for g in _GRID)


@query("transform_box_cox", f"WITH s AS ({_BC}), b AS (SELECT lam FROM s ORDER BY ll DESC LIMIT 1) SELECT event_id, "
       + r("CASE WHEN lam = 0 THEN ln(value) ELSE (pow(value, lam) - 1) / nullif(lam, 0) END") + " AS value FROM events, b")
def transform_box_cox(spark, sf):
    return rounded(preprocess.power_transform(table(spark, sf, "events").select("event_id", "value"), ["value"], _GRID, "box-cox"))


@query("encode_onehot", f"""WITH {LI} SELECT l_orderkey, l_partkey, CAST(flag = 'A' AS INTEGER) AS flag_A,
  CAST(flag = 'N' AS INTEGER) AS flag_N, CAST(flag = 'R' AS INTEGER) AS flag_R,
  CAST(coalesce(status, m) = 'F' AS INTEGER) AS status_F, CAST(coalesce(status, m) = 'O' AS INTEGER) AS status_O
  FROM li, (SELECT status AS m FROM li WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def encode_onehot(spark, sf):
    df = line_items(spark, sf).select("l_orderkey", "l_partkey", *TEXT)
    return TabularPreprocessor(categoricalCols=TEXT, family="LR").fit(df).transform(df)


# trained on the customers of even keys, so that some names are unseen
@query("encode_ordinal", """WITH d AS (SELECT c_name, dense_rank() OVER (ORDER BY c_name) - 1 AS code
    FROM (SELECT DISTINCT c_name FROM customer WHERE c_custkey % 2 = 0))
  SELECT c_custkey, CAST(coalesce(code, -1) AS BIGINT) AS code FROM customer LEFT JOIN d USING (c_name)""")
def encode_ordinal(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    codes = preprocess.ordinal_table(c.where("c_custkey % 2 = 0"), "c_name")
    return preprocess.encode_by_table(c, "c_name", codes, "code").select("c_custkey", "code")


@query("encode_target", f"""WITH {RANKED}, f AS (SELECT *, {FOLD.format(rank='rn', size='n', k=5)} AS fold FROM rk),
  t AS (SELECT sum(label) AS s, count(*) AS n FROM f), g AS (SELECT fold, sum(label) AS s, count(*) AS n FROM f GROUP BY 1),
  v AS (SELECT o_orderpriority AS p, sum(label) AS s, count(*) AS n FROM f GROUP BY 1),
  vf AS (SELECT o_orderpriority AS p, fold, sum(label) AS s, count(*) AS n FROM f GROUP BY 1, 2)
  SELECT o_orderkey, f.fold, {r('(v.s - vf.s + 10.0 * ((t.s - g.s) / (t.n - g.n))) / (v.n - vf.n + 10.0)')} AS encoded
  FROM f JOIN v ON v.p = o_orderpriority JOIN vf ON vf.p = o_orderpriority AND vf.fold = f.fold JOIN g ON g.fold = f.fold, t""")
def encode_target(spark, sf):
    df = sampling.with_folds(labelled_orders(spark, sf), ["o_orderkey"], 5)
    out = preprocess.target_encode(df, "o_orderpriority", "label", "fold", 10.0, "encoded")
    return rounded(out.select("o_orderkey", "fold", "encoded"))


_STD = f"""{LI}, m AS (SELECT median(qty) AS mq, median(tax) AS mt FROM li),
  s AS (SELECT avg(coalesce(tax, mt)) AS ta, stddev_pop(coalesce(tax, mt)) AS ts, avg(qty) AS aq, stddev_pop(qty) AS sq FROM li, m),
  c AS (SELECT status AS ms FROM li WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


@query("preprocess_linear", f"""WITH {_STD} SELECT l_orderkey, l_partkey, {r('(qty - aq) / sq')} AS qty,
  {r('(coalesce(tax, mt) - ta) / ts')} AS tax, CAST(coalesce(status, ms) = 'F' AS INTEGER) AS status_F,
  CAST(coalesce(status, ms) = 'O' AS INTEGER) AS status_O, label FROM li, m, s, c""")
def preprocess_linear(spark, sf):
    df = line_items(spark, sf).select("l_orderkey", "l_partkey", "qty", "tax", "status", "label")
    return rounded(TabularPreprocessor(numericCols=["qty", "tax"], categoricalCols=["status"], family="LR")
                   .fit(df).transform(df))


@query("preprocess_forest", f"""WITH {_STD} SELECT l_orderkey, l_partkey, {r('qty')} AS qty, {r('coalesce(tax, mt)')} AS tax,
  CAST(CASE coalesce(status, 'missing') WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INTEGER) AS status, label FROM li, m""")
def preprocess_forest(spark, sf):
    df = line_items(spark, sf).select("l_orderkey", "l_partkey", "qty", "tax", "status", "label")
    return rounded(TabularPreprocessor(numericCols=["qty", "tax"], categoricalCols=["status"], family="RF")
                   .fit(df).transform(df))


@query("preprocess_boost", f"""WITH {_STD} SELECT l_orderkey, l_partkey, {r('qty')} AS qty, {r('coalesce(tax, mt)')} AS tax,
  CAST(CASE coalesce(status, 'missing') WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS DOUBLE) AS status, label FROM li, m""")
def preprocess_boost(spark, sf):
    df = line_items(spark, sf).select("l_orderkey", "l_partkey", "qty", "tax", "status", "label")
    return rounded(TabularPreprocessor(numericCols=["qty", "tax"], categoricalCols=["status"], family="XGB")
                   .fit(df).transform(df))


@query("preprocess_other", f"""WITH {_STD} SELECT l_orderkey, l_partkey, {r('(qty - aq) / sq')} AS qty,
  {r('(coalesce(tax, mt) - ta) / ts')} AS tax,
  CAST(CASE coalesce(status, ms) WHEN 'F' THEN 0 ELSE 1 END AS INTEGER) AS status, label FROM li, m, s, c""")
def preprocess_other(spark, sf):
    df = line_items(spark, sf).select("l_orderkey", "l_partkey", "qty", "tax", "status", "label")
    return rounded(TabularPreprocessor(numericCols=["qty", "tax"], categoricalCols=["status"], family="OTHER")
                   .fit(df).transform(df))


@query("preprocess_train_test", f"""WITH {OR}, rk AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR))) AS rn,
    count(*) OVER () AS n FROM o),
  sp AS (SELECT *, rn <= ceil(n * 0.3) AS test FROM rk),
  m AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM sp WHERE NOT test),
  c AS (SELECT o_orderstatus, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS code FROM (SELECT DISTINCT o_orderstatus FROM sp WHERE NOT test))
  SELECT o_orderkey, CASE WHEN test THEN 'test' ELSE 'train' END AS split, {r('(o_totalprice - a) / s')} AS o_totalprice,
    CAST(coalesce(code, -1) AS INTEGER) AS o_orderstatus FROM sp LEFT JOIN c USING (o_orderstatus), m""")
def preprocess_train_test(spark, sf):
    df = sampling.with_split(labelled_orders(spark, sf), ["o_orderkey"], 0.3).select(
        "o_orderkey", "split", "o_totalprice", "o_orderstatus")
    model = TabularPreprocessor(numericCols=["o_totalprice"], categoricalCols=["o_orderstatus"], family="KNN").fit(
        df.where("split = 'train'"))
    return rounded(model.transform(df))


# ---- generation ----------------------------------------------------------------------

_P = ["p_size", "p_retailprice"]


def _parts(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


@query("gen_polynomial", f"""SELECT p_partkey, {r('p_size', 2)} AS p_size, {r('p_retailprice', 2)} AS p_retailprice,
  {r('CAST(p_size AS DOUBLE) * p_size', 2)} AS "p_size^2", {r('p_size * p_retailprice', 2)} AS "p_size p_retailprice",
  {r('p_retailprice * p_retailprice', 2)} AS "p_retailprice^2", 1.0::DOUBLE AS "1" FROM part""")
def gen_polynomial(spark, sf):
    return rounded(generate.add_polynomial(_parts(spark, sf), _P, 2, bias=True), 2)


@query("gen_polynomial_3", f"""SELECT p_partkey, {r('CAST(p_size AS DOUBLE) * p_size * p_size', 2)} AS "p_size^3",
  {r('CAST(p_size AS DOUBLE) * p_size * p_retailprice', 1)} AS "p_size^2 p_retailprice" FROM part""")
def gen_polynomial_3(spark, sf):
    wide = generate.add_polynomial(_parts(spark, sf), _P, 3)
    return rounded(wide.select("p_partkey", "`p_size^3`", "`p_size^2 p_retailprice`"), 2, **{"p_size^2 p_retailprice": 1})


@query("gen_interaction_all", f"""SELECT {r('l_quantity')} AS qty, {r('l_discount')} AS disc, {r('l_tax')} AS tax,
  {r('l_quantity * l_discount')} AS qty_x_disc, {r('l_quantity * l_tax')} AS qty_x_tax,
  {r('l_discount * l_tax')} AS disc_x_tax FROM lineitem""")
def gen_interaction_all(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"),
                                             F.col("l_tax").alias("tax"))
    return rounded(generate.add_interactions(df))


@query("gen_interaction_pairs", f"""SELECT l_orderkey, l_partkey, {r('l_quantity * l_extendedprice', 2)} AS qty_x_price FROM lineitem""")
def gen_interaction_pairs(spark, sf):
    df = generate.add_interactions(line_items(spark, sf), [("qty", "price"), ("qty", "flag")])
    return rounded(df.select("l_orderkey", "l_partkey", "qty_x_price"), 2)


_GENERATED = ["a^2", "a b", "b^2", "a_x_b", "a_x_a^2", "a_x_a b", "a_x_b^2", "b_x_a^2", "b_x_a b", "b_x_b^2",
              "a^2_x_a b", "a^2_x_b^2", "a b_x_b^2"]


@query("gen_summary", "SELECT unnest(" + repr(_GENERATED) + ") AS feature, unnest(" + repr(
    ["polynomial"] * 3 + ["interaction"] * 10) + ") AS type, count(*) AS n_rows FROM part")
def gen_summary(spark, sf):
    df = _parts(spark, sf).select(F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"))
    wide, summary = generate.generate(df, polynomial=True, interaction=True)
    n = wide.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(1).alias("k"))
    return summary.withColumn("k", F.lit(1)).join(n, "k").drop("k")


@query("gen_group_statistics", f"""SELECT o_orderkey, o_orderpriority, {r('avg(o_totalprice) OVER w', 4)} AS o_totalprice_mean_by_o_orderpriority,
  {r('stddev_samp(o_totalprice) OVER w', 4)} AS o_totalprice_std_by_o_orderpriority,
  {r('min(o_totalprice) OVER w', 4)} AS o_totalprice_min_by_o_orderpriority,
  {r('max(o_totalprice) OVER w', 4)} AS o_totalprice_max_by_o_orderpriority FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""")
def gen_group_statistics(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(generate.add_group_statistics(o, "o_orderpriority", ["o_totalprice"]).drop("o_totalprice"), 4)


@query("gen_bins", f"""WITH {LI}, long AS (SELECT 'qty' AS feature, qty AS x FROM li UNION ALL SELECT 'tax', tax FROM li),
  edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM long GROUP BY 1)
  SELECT l_orderkey, l_partkey, CAST(len(list_filter(a.e[2:len(a.e) - 1], lambda v: v < qty)) AS INTEGER) AS qty_bin,
  CASE WHEN tax IS NOT NULL THEN CAST(len(list_filter(b.e[2:len(b.e) - 1], lambda v: v < tax)) AS INTEGER) END AS tax_bin
  FROM li, edges a, edges b WHERE a.feature = 'qty' AND b.feature = 'tax'""")
def gen_bins(spark, sf):
    return generate.add_bins(line_items(spark, sf), ["qty", "tax"], 4).select("l_orderkey", "l_partkey", "qty_bin", "tax_bin")


@query("gen_trailing", f"""SELECT event_id, user_id, {r('sum(value) OVER w', 4)} AS value_sum_last_3,
  {r('avg(value) OVER w', 4)} AS value_mean_last_3 FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def gen_trailing(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return rounded(generate.add_trailing(e, "user_id", "ts", ["value"], 3, ["event_id"]).drop("ts", "value"), 4)




@query("trailing_nulls", f"""SELECT event_id, k, {r('sum(value) OVER w', 4)} AS value_sum_last_3, {r('avg(value) OVER w', 4)} AS value_mean_last_3
  FROM (SELECT *, CASE WHEN user_id % 5 <> 0 THEN user_id % 5 END AS k FROM events)
  WINDOW w AS (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def trailing_nulls(spark, sf):
    key = F.col("user_id") % 5
    e = table(spark, sf, "events").select("event_id", F.when(key != 0, key).alias("k"), "ts", "value")
    return rounded(generate.add_trailing(e, "k", "ts", ["value"], 3, ["event_id"], per_range=200).drop("ts", "value"), 4)
