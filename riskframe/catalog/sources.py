from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskframe.catalog.evaluation import RESULTS, _results
from riskframe.catalog.registry import query, r, rounded, scratch, table
from riskframe.operators import evaluate, screening, tuning
from riskframe.sources import registry, reports, tables


@query("src_csv_roundtrip", f"""SELECT o_orderkey, o_orderstatus, {r('o_totalprice', 2)} AS o_totalprice FROM orders""")
def src_csv_roundtrip(spark, sf):
    path = scratch(spark) + "/orders.csv"
    tables.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return rounded(tables.read_table(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double"), 2)


@query("src_table_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_table_scan(spark, sf):
    return tables.read_table(spark, f"{sf.rstrip('/')}/customer.parquet")


_VERSIONS = """v AS (SELECT o_orderpriority AS name, 'v' || CAST(o_orderkey AS VARCHAR) AS version, o_orderdate AS created_at FROM orders)"""


def _registry(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("name"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("version"),
        F.lit("path").alias("path"), F.col("o_orderdate").alias("created_at"))


@query("registry_list", f"""WITH {_VERSIONS} SELECT name, version, strftime(created_at, '%Y-%m-%d') AS created,
  CAST(row_number() OVER (PARTITION BY name ORDER BY created_at DESC, version DESC) AS INTEGER) AS age_rank FROM v""")
def registry_list(spark, sf):
    ranked = registry.with_version_rank(_registry(spark, sf))
    return registry.list_models(ranked).select("name", "version", F.date_format("created_at", "yyyy-MM-dd").alias("created"),
                                               "age_rank")


@query("registry_latest", f"""WITH {_VERSIONS} SELECT name, version, strftime(created_at, '%Y-%m-%d') AS created FROM v
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY created_at DESC, version DESC) = 1""")
def registry_latest(spark, sf):
    latest = registry.latest_models(_registry(spark, sf))
    return latest.select("name", "version", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


def _stored_documents(spark, sf):
    """One result document per model, each in a file of its own as a training run stores it, read back."""
    folder = scratch(spark) + "/results"
    for x in _results(spark, sf).collect():  # three models
        metrics = {m: x[m] for m in ("accuracy", "precision", "recall", "f1", "auc", "ks")}
        reports.write_result(spark, folder, {"model_name": x.model_name, "evaluation_results": {
            "model_name": x.model_name, "data_name": "line_items", "imbalance_method": "random_over", "status": "success",
            "metrics": {"train_metrics": metrics, "test_metrics": metrics}}})
    return reports.read_results(spark, folder)


@query("global_comparison", f"""WITH {RESULTS} SELECT 'line_items' AS data_name, 'random_over' AS imbalance_method, model_name,
  'classification' AS task_type, {r('acc')} AS accuracy, {r('wp')} AS precision, {r('wr')} AS recall, {r('wf')} AS f1, {r('auc')} AS auc, {r('ks')} AS ks FROM res""")
def global_comparison(spark, sf):
    return rounded(evaluate.compare_runs(_stored_documents(spark, sf)))


@query("global_summary", f"""WITH {RESULTS} SELECT count(*) AS n_runs, count(DISTINCT 1) AS n_data, count(DISTINCT 2) AS n_samplers,
  count(DISTINCT model_name) AS n_models, 'line_items' AS best_data, 'random_over' AS best_sampler,
  arg_max(model_name, auc) AS best_model, {r('max(auc)')} AS best_auc FROM res""")
def global_summary(spark, sf):
    return rounded(evaluate.runs_summary(evaluate.compare_runs(_stored_documents(spark, sf))))


# three files of many are read as one table; their names say what they hold
@query("result_files", f"""WITH {RESULTS} SELECT 'line_items' AS data_name, 'random_over' AS imbalance_method, model_name,
  {r('auc')} AS auc, CAST(row_number() OVER (ORDER BY auc DESC) AS INTEGER) AS place FROM res""")
def result_files(spark, sf):
    found = _stored_documents(spark, sf)
    auc = F.col("evaluation_results.metrics.test_metrics.auc")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(auc.desc()))  # a row a result file
    return rounded(found.select(*[e.alias(n) for n, e in reports.names_from_file().items()], auc.alias("auc"), place.alias("place")))


@query("feature_list_sink", """SELECT 'orders' AS name, 'o_custkey,o_totalprice' AS features, 2 AS feature_count, '2024-02-01' AS created
  FROM orders HAVING var_samp(o_custkey) >= 0.01 AND var_samp(o_totalprice) >= 0.01""")
def feature_list_sink(spark, sf):
    o = table(spark, sf, "orders").withColumn("flat", F.lit(1.0))
    kept = {x["feature"] for x in screening.variances(o, ["o_custkey", "o_totalprice", "flat"]).where("kept").collect()}
    names = [c for c in ("o_custkey", "o_totalprice", "flat") if c in kept]
    path = scratch(spark) + "/features"
    reports.write_json(reports.feature_list(spark, "orders", names, datetime(2024, 2, 1)), path)
    back = spark.read.schema("name string, features array<string>, feature_count int, created_at timestamp").json(path)
    return back.select("name", F.array_join("features", ",").alias("features"), "feature_count",
                       F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("grid_expand", """SELECT source AS data_name, s AS sampler, m AS model, CAST(d AS INTEGER) AS max_depth FROM (SELECT DISTINCT source FROM documents),
  unnest(['random_over', 'smote']) AS a(s), unnest(['LR', 'XGB', 'RF']) AS b(m), unnest([3, 6]) AS c(d)""")
def grid_expand(spark, sf):
    data = table(spark, sf, "documents").select(F.col("source").alias("data_name")).distinct()
    return tuning.expand_grid(data, {"sampler": ["random_over", "smote"], "model": ["LR", "XGB", "RF"], "max_depth": [3, 6]})



# the names in a result file's name, for files named after the customers
@query("names_from_file", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'test_creditcard' ELSE 'new_customers' END AS data_name,
  CASE WHEN c_custkey % 3 = 0 THEN 'smote' ELSE 'random_over' END AS imbalance_method, 'XGB' AS model_name FROM customer""")
def names_from_file(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(
        F.lit("runs/pipeline_"), F.when(F.col("c_custkey") % 2 == 0, "test_creditcard").otherwise("new_customers"),
        F.when(F.col("c_custkey") % 3 == 0, "_smote_").otherwise("_random_over_"), F.lit("XGB_results.json")).alias("file_path"))
    return c.select("c_custkey", *[e.alias(n) for n, e in reports.names_from_file().items()])
