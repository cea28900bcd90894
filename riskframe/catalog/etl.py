from pyspark.sql import functions as F

from riskframe.catalog.registry import LI, line_items, query, r, rounded, table
from riskframe.operators import clean, profile
from riskframe.plans import etl
from riskframe.sources.lineage import checkpointed

# a raw export: everything is text, missing values are tokens
RAW = """raw AS (SELECT CAST(o_orderkey AS VARCHAR) AS id,
  CASE WHEN o_orderkey % 50 = 0 THEN '\\N' WHEN o_orderkey % 50 = 1 THEN 'None'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'NaN' ELSE '1.5' END AS sparse,
  CASE WHEN o_orderkey % 5 < 2 THEN '0' ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS zeros,
  CASE WHEN o_orderkey % 40 = 7 THEN 'nan' ELSE o_orderpriority END AS priority,
  CASE WHEN o_custkey % 12 = 0 THEN '1' ELSE '0' END AS label FROM orders)"""
TOKENS = "('\\N', '\\n', 'None', 'nan', 'NaN', '')"


def raw_orders(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("id"),
        F.when(k % 50 == 0, "\\N").when(k % 50 == 1, "None")
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "NaN").otherwise("1.5").alias("sparse"),
        F.when(k % 5 < 2, "0").otherwise((k % 5).cast("string")).alias("zeros"),
        F.when(k % 40 == 7, "nan").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_custkey") % 12 == 0, "1").otherwise("0").alias("label"))


@query("proj_select", "SELECT c_custkey, c_mktsegment FROM customer")
def proj_select(spark, sf):
    return clean.select_columns(table(spark, sf, "customer"), ["c_custkey", "c_mktsegment"])


@query("proj_rename", "SELECT c_custkey AS customer, c_mktsegment AS segment, c_acctbal, c_name, c_nationkey FROM customer")
def proj_rename(spark, sf):
    return clean.rename_columns(table(spark, sf, "customer"),
                                {"c_custkey": "customer", "c_mktsegment": "segment", "absent": "nothing"})


@query("proj_cast", f"""WITH {RAW} SELECT id, TRY_CAST(amount AS DOUBLE) AS amount,
  CASE WHEN isnan(TRY_CAST(sparse AS DOUBLE)) THEN NULL ELSE TRY_CAST(sparse AS DOUBLE) END AS sparse,
  TRY_CAST(zeros AS DOUBLE) AS zeros, priority, TRY_CAST(label AS INTEGER) AS label FROM raw""")
def proj_cast(spark, sf):
    typed = clean.cast_columns(raw_orders(spark, sf), ["priority"], "label", keep=["id"])
    return clean.null_tokens(typed, tokens=["\u0000"])


@query("proj_drop", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def proj_drop(spark, sf):
    return clean.drop_columns(table(spark, sf, "orders"), ["o_totalprice", "o_orderdate", "o_orderpriority", "absent"])


@query("clean_null_tokens", f"WITH {RAW} SELECT " + ", ".join(
    f"CASE WHEN {c} IN {TOKENS} THEN NULL ELSE {c} END AS {c}"
    for c in ("id", "amount", "sparse", "zeros", "priority", "label")) + " FROM raw")
def clean_null_tokens(spark, sf):
    return clean.null_tokens(raw_orders(spark, sf))


@query("check_any_null", f"""WITH {RAW} SELECT 'raw' AS stage, bool_or(amount IN {TOKENS} OR sparse IN {TOKENS}
  OR priority IN {TOKENS}) AS any_token, bool_or(amount IS NULL) AS any_null FROM raw
  UNION ALL SELECT 'clean', false, bool_or(amount IN {TOKENS} OR sparse IN {TOKENS}) FROM raw""")
def check_any_null(spark, sf):
    raw = raw_orders(spark, sf)
    stages = [clean.any_left(d).select(F.lit(s).alias("stage"), "any_token", "any_null")
              for s, d in (("raw", raw), ("clean", clean.null_tokens(raw)))]
    return stages[0].unionByName(stages[1])


@query("filter_label", f"WITH {LI} SELECT l_orderkey, l_partkey, qty, label FROM li WHERE label = 1")
def filter_label(spark, sf):
    return clean.filter_label(line_items(spark, sf), "label", 1).select("l_orderkey", "l_partkey", "qty", "label")


CLEAN = f"""cl AS (SELECT id, TRY_CAST(CASE WHEN amount IN {TOKENS} THEN NULL ELSE amount END AS DOUBLE) AS amount,
  TRY_CAST(CASE WHEN sparse IN {TOKENS} THEN NULL ELSE sparse END AS DOUBLE) AS sparse,
  TRY_CAST(zeros AS DOUBLE) AS zeros, CASE WHEN priority IN {TOKENS} THEN NULL ELSE priority END AS priority,
  CAST(label AS INTEGER) AS label FROM raw)"""


@query("etl_missing_prune", f"""WITH {RAW}, {CLEAN}, rates AS (
  SELECT 'amount' AS feature, avg(CASE WHEN amount IS NULL THEN 1.0 ELSE 0.0 END) AS rate FROM cl
  UNION ALL SELECT 'sparse', avg(CASE WHEN sparse IS NULL THEN 1.0 ELSE 0.0 END) FROM cl
  UNION ALL SELECT 'zeros', avg(CASE WHEN zeros IS NULL THEN 1.0 ELSE 0.0 END) FROM cl
  UNION ALL SELECT 'priority', avg(CASE WHEN priority IS NULL THEN 1.0 ELSE 0.0 END) FROM cl)
  SELECT feature, {r('rate')} AS missing_rate, rate <= 0.2 AS kept FROM rates""")
def etl_missing_prune(spark, sf):
    df = clean.null_tokens(clean.cast_columns(clean.null_tokens(raw_orders(spark, sf)), ["priority"], "label", ["id"]))
    rates = clean.column_rates(df, ["id", "label"])
    return rounded(rates.select("feature", "missing_rate", (F.col("missing_rate") <= 0.2).alias("kept")))


@query("etl_zero_prune", f"""WITH {RAW}, {CLEAN}, rates AS (
  SELECT 'amount' AS feature, avg(CASE WHEN amount = 0 THEN 1.0 ELSE 0.0 END) AS rate FROM cl
  UNION ALL SELECT 'sparse', avg(CASE WHEN sparse = 0 THEN 1.0 ELSE 0.0 END) FROM cl
  UNION ALL SELECT 'zeros', avg(CASE WHEN zeros = 0 THEN 1.0 ELSE 0.0 END) FROM cl
  UNION ALL SELECT 'priority', avg(CASE WHEN priority = '0' THEN 1.0 ELSE 0.0 END) FROM cl)
  SELECT feature, {r('rate')} AS zero_rate, rate <= 0.3 AS kept FROM rates""")
def etl_zero_prune(spark, sf):
    df = clean.null_tokens(clean.cast_columns(clean.null_tokens(raw_orders(spark, sf)), ["priority"], "label", ["id"]))
    rates = clean.column_rates(df, ["id", "label"])
    return rounded(rates.select("feature", "zero_rate", (F.col("zero_rate") <= 0.3).alias("kept")))


@query("etl_complete_case", f"WITH {LI} SELECT * FROM li WHERE tax IS NOT NULL AND status IS NOT NULL")
def etl_complete_case(spark, sf):
    return clean.complete_cases(line_items(spark, sf))


@query("value_counts", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def value_counts(spark, sf):
    return clean.value_counts(table(spark, sf, "lineitem"), "l_returnflag")


@query("etl_random_target", """SELECT o_orderkey, o_totalprice,
  CAST(('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 300 AS INTEGER) AS label FROM orders""")
def etl_random_target(spark, sf):
    return clean.hashed_target(table(spark, sf, "orders"), ["o_orderkey"]).select("o_orderkey", "o_totalprice", "label")


@query("feature_columns", "SELECT unnest(['o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderpriority']) AS feature, "
       "count(*) AS n_rows FROM orders")
def feature_columns(spark, sf):
    o = table(spark, sf, "orders")
    names = clean.feature_columns(o, "o_orderkey", ["o_orderdate"])
    return o.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), "n_rows")


@query("split_types", """SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS feature,
  unnest(['numeric', 'categorical', 'categorical', 'categorical', 'numeric', 'numeric']) AS kind, count(*) AS n_rows FROM part""")
def split_types(spark, sf):
    p = table(spark, sf, "part")
    numeric, text = clean.split_by_type(p, p.columns)
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(k).alias("kind"))
            for k, names in (("numeric", numeric), ("categorical", text)) for c in names]
    return p.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(F.array(*rows)), "n_rows")


_DETECT = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice"]


@query("detect_categorical", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CASE WHEN count(DISTINCT {c}) <= 10 THEN count(DISTINCT {c}) END AS n_distinct, "
    f"{str(c in ('l_returnflag', 'l_linestatus')).lower()} OR count(DISTINCT {c}) <= 10 AS is_categorical FROM lineitem"
    for c in _DETECT))
def detect_categorical(spark, sf):
    return clean.detect_categorical(table(spark, sf, "lineitem"), _DETECT)


_NAMES = {"amount": "order_amount", "priority": "order_priority"}
ETL = f"""{RAW}, {CLEAN}, done AS (SELECT id, amount AS order_amount, priority AS order_priority, label FROM cl
  WHERE amount IS NOT NULL AND priority IS NOT NULL AND label IS NOT NULL)"""


def _flow(spark, sf):
    raw = raw_orders(spark, sf)
    return etl.clean_subscribers([raw.where("label = '0'"), raw.where("label = '1'")], "id", names=_NAMES,
                                 text=["order_priority"], drop=[])


@query("etl_flow", f"""WITH {ETL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id)) AS rn
    FROM done), bad AS (SELECT count(*) AS n FROM done WHERE label = 1)
  SELECT id, order_amount, order_priority, label FROM ranked, bad WHERE label = 1 OR rn <= 2 * n""")
def etl_flow(spark, sf):
    return etl.ratio_samples(checkpointed(_flow(spark, sf).rows), "id", ratios=[2])["data_ratio_1_2"]


@query("etl_flow_samples", f"""WITH {ETL}, c AS (SELECT count(*) FILTER (label = 1) AS bad, count(*) AS total FROM done)
  SELECT 'data_all' AS sample, total AS n_rows, bad AS n_bad FROM c
  UNION ALL SELECT 'data_ratio_1_' || CAST(k AS VARCHAR), bad * (k + 1), bad FROM c, unnest([1, 2, 3, 4, 5]) AS t(k)""")
def etl_flow_samples(spark, sf):
    samples = etl.samples(checkpointed(_flow(spark, sf).rows), "id")
    return samples.groupBy("sample").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_bad"))


@query("union_all", """SELECT s_suppkey AS id, s_acctbal AS balance, 'supplier' AS kind FROM supplier
  UNION ALL SELECT c_custkey, c_acctbal, 'customer' FROM customer""")
def union_all(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"),
                                            F.lit("supplier").alias("kind"))
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"),
                                            F.col("c_custkey").alias("id"))
    return clean.concat_tables(s, c)


@query("validate_dataset", """SELECT unnest(['not_empty', 'columns_present', 'target_present', 'target_varies']) AS "check",
  min(l_quantity) IS NOT NULL AS passed, unnest(['', 'qty,price', 'label', 'classification']) AS detail FROM lineitem""")
def validate_dataset(spark, sf):
    return profile.validate_dataset(line_items(spark, sf), ["qty", "price"], "label")


@query("profile_label", f"""WITH {LI} SELECT label, count(*) AS n, {r('count(*) / (SELECT count(*) FROM li)')} AS share
  FROM li GROUP BY label""")
def profile_label(spark, sf):
    return rounded(profile.profile_label(line_items(spark, sf), "label"))


@query("profile_target", f"""SELECT count(DISTINCT o_totalprice) AS n_distinct, count(o_totalprice) AS n,
  {r('avg(o_totalprice)', 4)} AS mean, {r('stddev_samp(o_totalprice)', 4)} AS std, {r('min(o_totalprice)', 4)} AS min,
  {r('quantile_cont(o_totalprice, 0.25)', 4)} AS q25, {r('quantile_cont(o_totalprice, 0.5)', 4)} AS q50,
  {r('quantile_cont(o_totalprice, 0.75)', 4)} AS q75, {r('max(o_totalprice)', 4)} AS max FROM orders""")
def profile_target(spark, sf):
    return rounded(profile.profile_target(table(spark, sf, "orders"), "o_totalprice"), 4)


@query("profile_missing", f"""WITH {LI} SELECT 'tax' AS feature, count(*) AS n_missing FROM li WHERE tax IS NULL
  UNION ALL SELECT 'status', count(*) FROM li WHERE status IS NULL""")
def profile_missing(spark, sf):
    return profile.profile_missing(line_items(spark, sf))


