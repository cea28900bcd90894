from datetime import datetime

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskframe.catalog.registry import query, r, rounded, scratch, table
from riskframe.operators import boosting, evaluate, forest, generate, sampling, scorecard, scoring, tuning
from riskframe.operators.models import importances, prepare, train
from riskframe.operators.preprocess import TabularPreprocessor
from riskframe.plans import training
from riskframe.sources import registry, reports
from riskframe.sources.lineage import checkpointed

NUM = ["n_chars", "n_lines", "n_words", "digits"]
TEXT = ["lang"]
AT = datetime(2024, 2, 1)
GBT_TREES = 100  # Spark grows trees one after the other; the default of 1000 takes minutes on any table


def documents(spark, sf):
    """All documents with simple counts as features; the quality label is NULL where there is none."""
    text = F.col("text")
    counted = table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.regexp_count(text, F.lit("\n")).cast("double").alias("n_lines"),
        F.regexp_count(text, F.lit(" ")).cast("double").alias("n_words"), F.regexp_count(text, F.lit("[0-9]")).cast("double").alias("digits"), "lang")
    return counted.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")


def labelled(spark, sf):
    return documents(spark, sf).where("label is not null")


PRICE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def prices(spark, sf):
    """Line items with the price as target."""
    li = table(spark, sf, "lineitem")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in PRICE_KEY])
    return li.select(key.alias("key"), "l_quantity", "l_discount", "l_tax", "l_returnflag", F.col("l_extendedprice").alias("label"))


def _scored_metrics(spark, model, df, label, task):
    return training.evaluate_model(model, df, label, task)


def _classifier(spark, sf, code, **kw):
    # the features are made from whole texts once and kept as a table
    df = checkpointed(sampling.with_split(labelled(spark, sf), ["doc_id"], 0.3, label="label"))
    model = train(df.where("split = 'train'").drop("split"), "label", code, NUM, TEXT, key="doc_id", **kw)
    return _scored_metrics(spark, model, df, "label", "classification")


# at the optimum the weighted residuals balance the penalty, for every feature and for the intercept
@query("train_lr", """WITH f AS (SELECT unnest(['n_chars', 'n_lines', 'n_words', 'digits', 'intercept'] || list('lang_' || lang)) AS feature
    FROM (SELECT DISTINCT lang FROM documents JOIN labels USING (doc_id)))
  SELECT feature, 0.0::DOUBLE AS gradient, (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL) AS n_rows FROM f""")
def train_lr(spark, sf):
    df = checkpointed(labelled(spark, sf))
    ready = prepare(df, "label", "LR", NUM, TEXT, key="doc_id")
    ready.data.persist()
    model = ready.fit("LR").stages[-1]
    names = [*ready.prep.outputs(), "intercept"]
    p = vector_to_array("probability")[1]
    residual = F.col("_weight") * (p - F.col("label"))
    x = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    pieces = model.transform(ready.data).select(residual.alias("r"), "_weight", F.posexplode(x).alias("i", "x"))
    sums = pieces.groupBy("i").agg(F.sum(F.col("r") * F.col("x")).alias("g"), F.sum("_weight").alias("w"), F.count(F.lit(1)).alias("n_rows"))
    beta = F.array(*[F.lit(float(b)) for b in model.coefficients], F.lit(0.0))
    out = checkpointed(sums.select(F.array(*[F.lit(n) for n in names])[F.col("i")].alias("feature"),
                                   F.round(F.col("g") / F.col("w") + F.lit(model.getRegParam()) * beta[F.col("i")], 2).alias("gradient"), "n_rows"))
    ready.data.unpersist()
    return out.withColumn("gradient", F.col("gradient") + F.lit(0.0))


@query("train_lr_smote")
def train_lr_smote(spark, sf):
    return _classifier(spark, sf, "LR", sampler="smote")


@query("train_gbt")
def train_gbt(spark, sf):
    return _classifier(spark, sf, "XGB", sampler="random_over", n_estimators=GBT_TREES)


@query("train_gbt_stopped")
def train_gbt_stopped(spark, sf):
    return _classifier(spark, sf, "LGB", early_stopping=True)


@query("train_rf")
def train_rf(spark, sf):
    return _classifier(spark, sf, "RF", sampler="random_under")


def _regressor(spark, sf, code, **kw):
    df = sampling.with_split(prices(spark, sf), ["key"], 0.3)
    model = train(df.where("split = 'train'").drop("split"), "label", code, ["l_quantity", "l_discount", "l_tax"],
                  ["l_returnflag"], key="key", **kw)
    return _scored_metrics(spark, model, df, "label", "regression")


# two centred features: the ridge solution in closed form from the moments
@query("train_ridge", f"""WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS aq, avg(l_discount) AS ad, avg(l_extendedprice) AS ay,
    stddev_pop(l_quantity) AS sq, stddev_pop(l_discount) AS sd, covar_pop(l_quantity, l_discount) AS cqd,
    covar_pop(l_quantity, l_extendedprice) AS cqy, covar_pop(l_discount, l_extendedprice) AS cdy FROM lineitem),
  z AS (SELECT n, ay, n + 10.0 AS a, n * cqd / (sq * sd) AS b, n * cqy / sq AS y1, n * cdy / sd AS y2 FROM m)
  SELECT {r('(a * y1 - b * y2) / (a * a - b * b)', 3)} AS l_quantity, {r('(a * y2 - b * y1) / (a * a - b * b)', 3)} AS l_discount,
    {r('ay', 3)} AS intercept FROM z""")
def train_ridge(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_discount", F.col("l_extendedprice").alias("label"))
    last = train(df, "label", "RIDGE", ["l_quantity", "l_discount"], alpha=10.0).stages[-1]
    b = [float(x) for x in last.coefficients]
    return rounded(spark.createDataFrame([(b[0], b[1], float(last.intercept))],
                                         "l_quantity double, l_discount double, intercept double"), 3)


@query("train_gbt_reg")
def train_gbt_reg(spark, sf):
    return _regressor(spark, sf, "XGB_REG", n_estimators=GBT_TREES)


@query("train_lgb_reg")
def train_lgb_reg(spark, sf):
    return _regressor(spark, sf, "LGB_REG", early_stopping=True)


# ---- second-order boosting -----------------------------------------------------------

def _leaves(model, data, label, slope, curve):
    """One row: rows, base and leaves of the first tree, and how many leaves are not -rate * G / (H + lambda) by sums over their rows."""
    s = model.settings
    sums = model.transform(data, leaf=True).groupBy(F.col("leaf").alias("node")).agg(
        F.sum(slope(F.lit(model.base), F.col(label))).alias("g"), F.sum(curve(F.lit(model.base))).alias("h"), F.count("*").alias("rows"))
    off = F.abs(F.col("value") + s.learning_rate * F.col("g") / (F.col("h") + s.reg_lambda)) > 1e-6 * (1 + F.abs("value"))
    first = model.table(data.sparkSession).where("tree = 0 AND feature < 0").select("node", "value", "n")
    return first.join(sums.drop("n"), "node", "left").agg(
        F.sum("rows").alias("n_rows"), F.round(F.lit(float(model.base)), 4).alias("base"), F.count("*").alias("leaves"),
        F.sum((off | (F.col("n") != F.col("rows"))).cast("int")).cast("long").alias("wrong"))


def _lines(spark, sf, label):
    x = [F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")]
    return table(spark, sf, "lineitem").select(F.array(*x).alias("features"), label.cast("double").alias("label"))


@query("boost_leaves", "SELECT count(*) AS n_rows, round(avg(l_extendedprice), 4) AS base, 0::BIGINT AS wrong FROM lineitem")
def boost_leaves(spark, sf):
    df = _lines(spark, sf, F.col("l_extendedprice"))
    model = boosting.fit(df, boosting.Settings(objective="squared", n_estimators=1))
    return _leaves(model, df, "label", lambda base, y: base - y, lambda base: F.lit(1.0)).drop("leaves")


@query("boost_leafwise", """SELECT count(*) AS n_rows, round(ln(avg((l_returnflag = 'R')::INT) / (1 - avg((l_returnflag = 'R')::INT))), 4) AS base,
    31::BIGINT AS leaves, 0::BIGINT AS wrong FROM lineitem""")
def boost_leafwise(spark, sf):
    df = _lines(spark, sf, F.col("l_returnflag") == "R")
    model = boosting.fit(df, boosting.Settings(n_estimators=1, num_leaves=31, max_depth=None, min_child_samples=20, reg_lambda=0.0, min_child_weight=1e-3))
    p = lambda base: 1 / (1 + F.exp(-base))
    return _leaves(model, df, "label", lambda base, y: p(base) - y, lambda base: p(base) * (1 - p(base)))


@query("boost_stopped")
def boost_stopped(spark, sf):
    """Test metrics of up to 1000 rounds that end after ten without a lower validation loss."""
    df = checkpointed(sampling.with_split(labelled(spark, sf), ["doc_id"], 0.3, label="label"))
    ready = prepare(df.where("split = 'train'").drop("split"), "label", "XGB", NUM, TEXT, key="doc_id", early_stopping=True)
    model = boosting.fit(ready.data, boosting.Settings(patience=10), weight=ready.weight, validation=ready.validation)
    test = ready.assembler.transform(ready.prep.transform(df.where("split = 'test'"))).select("features", F.col("label").cast("double").alias("label"))
    scored = model.transform(test)
    scored = scored.select(F.lit("test").alias("split"), "label", "prediction", vector_to_array("probability")[1].alias("probability"))
    return evaluate.evaluate_bundle(scored, "classification", "label", "prediction", "probability")


@query("train_rf_reg")
def train_rf_reg(spark, sf):
    return _regressor(spark, sf, "RF_REG")


# a tree without limits ends at rows that cannot be told apart, so it predicts their mean
@query("forest_cell_means", f"""SELECT {r('avg(l_extendedprice) OVER (PARTITION BY l_quantity, l_discount, l_tax, l_linenumber)', 7)} AS prediction,
    l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""")
def forest_cell_means(spark, sf):
    x = [F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")]
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array(*x).alias("features"),
                                             F.col("l_extendedprice").cast("double").alias("label"))
    model = forest.fit(df, forest.Settings(n_estimators=3, bootstrap=False, max_features=2))
    return model.transform(df).drop("features", "label").withColumn("prediction", F.round("prediction", 7))


# every leaf of a forest of classes that ends early: the rows that reach it, and the share of the class among them
@query("forest_leaves", "SELECT count(*) AS n_rows, true AS several, 0::BIGINT AS wrong FROM lineitem")
def forest_leaves(spark, sf):
    df = _lines(spark, sf, F.col("l_returnflag") == "R")
    model = forest.fit(df, forest.Settings("classification", n_estimators=1, bootstrap=False, min_samples_leaf=50, subtree_rows=20_000))
    scored = model.transform(df).select("label", vector_to_array("probability")[1].alias("p"))
    shares = scored.groupBy(F.round("p", 9).alias("p")).agg(F.sum("label").alias("hits"), F.count("*").alias("rows"))
    leaves = model.nodes().where("feature < 0").groupBy(F.round(F.col("value")[1], 9).alias("p")).agg(F.sum("rows").alias("held"), F.count("*").alias("leaves"))
    off = (F.col("rows") != F.col("held")) | (F.abs(F.col("hits") / F.col("rows") - F.col("p")) > 1e-6) | (F.col("rows") < 50 * F.col("leaves"))
    return shares.join(leaves, "p", "full").agg(F.sum("rows").alias("n_rows"), (F.sum("leaves") > 1).alias("several"),
                                                F.sum(F.coalesce(off, F.lit(True)).cast("int")).cast("long").alias("wrong"))


@query("importance_table")
def importance_table(spark, sf):
    model = train(labelled(spark, sf), "label", "RF", NUM, TEXT)
    rows = spark.createDataFrame(list(importances(model).items()), "feature string, importance double")
    return evaluate.importance_table(rows)


# ---- tuning --------------------------------------------------------------------------

def _folds(spark, sf, code, **kw):
    df = checkpointed(labelled(spark, sf))  # folds are cut and prepared in several passes, texts are read in one
    return tuning.FoldedTable(df, "label", code, NUM, TEXT, "doc_id", **kw)


def _searched(spark, trials):
    """The trials with their place; the place of the best is what the search picks."""
    best = tuning.best_trial(trials)
    rows = tuning.trials_table(spark, trials)
    n_better = F.count(F.when(F.col("score") > F.lit(float(best.score)), 1)).over(Window.partitionBy())
    return rows.select("trial", F.size("params").alias("n_settings"), ((F.col("score") >= 0) & (F.col("score") <= 1)).alias("is_share"),
                       n_better.cast("int").alias("n_better_than_best"))


def _trials_sql(n, settings):
    return (f"SELECT CAST(t AS INTEGER) AS trial, {settings} AS n_settings, true AS is_share, 0 AS n_better_than_best "
            f"FROM unnest(range(0, {n})) AS x(t) WHERE (SELECT count(*) FROM labels) > 0")


@query("search_random", _trials_sql(20, 4))
def search_random(spark, sf):
    t = _folds(spark, sf, "LR", k=5, sampler="random_over")
    trials = t.search(tuning.random_candidates("LR", 20))
    t.close()
    return _searched(spark, trials)


@query("search_grid", _trials_sql(4, 2))
def search_grid(spark, sf):
    t = _folds(spark, sf, "RF", k=5, metric="f1_weighted")
    trials = t.search(tuning.grid_candidates({"n_estimators": [20, 50], "max_depth": [4, 8]}))
    t.close()
    return _searched(spark, trials)


@query("search_sequential", _trials_sql(50, 4))
def search_sequential(spark, sf):
    t = _folds(spark, sf, "LR", k=3)
    trials = t.sequential(50)
    t.close()
    return _searched(spark, trials)


def _calibrated(spark, sf, method):
    """Every document: the calibrated probability never falls while the raw one rises."""
    df = checkpointed(documents(spark, sf))
    model = tuning.calibrate(df.where("label is not null"), "label", "RF", NUM, TEXT, "doc_id", method)
    out = checkpointed(model.transform(df.withColumn("label", F.coalesce("label", F.lit(0)))).select("doc_id", "raw_probability", "probability"))
    # the greatest calibrated value below a raw one, over the distinct raw values: as many as leaves combine to
    steps = out.groupBy("raw_probability").agg(F.min("probability").alias("low"), F.max("probability").alias("high"))
    before = F.max("high").over(Window.partitionBy(F.lit(0)).orderBy("raw_probability").rowsBetween(Window.unboundedPreceding, -1))
    rising = checkpointed(steps.select("raw_probability", (F.coalesce(before, F.lit(0.0)) <= F.col("low") + 1e-12).alias("rising")))
    inside = (F.col("probability") >= 0) & (F.col("probability") <= 1)
    return out.join(rising, "raw_probability").select("doc_id", inside.alias("is_share"), "rising")


_CALIBRATED = "SELECT doc_id, true AS is_share, true AS rising FROM documents"


@query("calibrate_isotonic", _CALIBRATED)
def calibrate_isotonic(spark, sf):
    return _calibrated(spark, sf, "isotonic")


@query("calibrate_sigmoid", _CALIBRATED)
def calibrate_sigmoid(spark, sf):
    return _calibrated(spark, sf, "sigmoid")


@query("train_many", f"""SELECT unnest(['LR', 'RF']) AS model_name, unnest(['random_over', 'none']) AS imbalance_method, true AS is_share, 3::BIGINT AS total,
  2::BIGINT AS succeeded, 1::BIGINT AS failed, {r('2 / 3.0')} AS success_rate FROM (SELECT count(*) AS n FROM labels) WHERE n > 0""")
def train_many(spark, sf):
    jobs = [{"code": "LR", "sampler": "random_over"}, {"code": "RF", "sampler": "none"}, {"code": "NB"}]
    runs = training.train_many(labelled(spark, sf), "label", jobs, NUM, TEXT, "doc_id")
    done = [x["result"] for x in runs if x["status"] == "success"]
    compared = evaluate.compare_runs(reports.result_rows(spark, done))
    summary = evaluate.batch_summary(spark.createDataFrame([(x["status"],) for x in runs], "status string"))
    return compared.select("model_name", "imbalance_method", F.col("auc").between(0, 1).alias("is_share"), F.lit(1).alias("k")).join(
        summary.withColumn("k", F.lit(1)), "k").drop("k").withColumn("success_rate", F.round("success_rate", 6))


# ---- stored models, scoring, tree scorecards -----------------------------------------

@query("model_save_load", "SELECT doc_id, true AS same FROM documents")
def model_save_load(spark, sf):
    """Every document gets from the stored newest version what the model gave before it was stored."""
    df = checkpointed(documents(spark, sf))
    fit_rows, root = df.where("label is not null"), scratch(spark)
    registry.save_model(train(fit_rows, "label", "LR", NUM, TEXT, C=0.1), root, "quality", "v1", AT)
    newest = train(fit_rows, "label", "LR", NUM, TEXT)
    registry.save_model(newest, root, "quality", "v2", datetime(2024, 2, 2))
    model = registry.load_model(spark, root, "quality")
    before, after = (scoring.predict(m, df, [*NUM, *TEXT]).select("doc_id", F.struct("prediction", "probability").alias(n))
                     for m, n in ((newest, "a"), (model, "b")))
    return before.join(after, "doc_id").select("doc_id", (F.col("a") == F.col("b")).alias("same"))


@query("score_batch", """SELECT doc_id, true AS is_share, true AS cut_at_half, 'XGB' AS model_name, 'v1' AS model_version,
  '2024-02-01' AS scored FROM documents""")
def score_batch(spark, sf):
    """Every document is scored, also those without a label."""
    df = checkpointed(documents(spark, sf))
    model = train(df.where("label is not null"), "label", "XGB", NUM, TEXT, key="doc_id", early_stopping=True)
    scored = scoring.with_provenance(scoring.predict(model, df, [*NUM, *TEXT]), "XGB", "v1", AT)
    p = F.col("probability")
    return scored.select("doc_id", p.between(0, 1).alias("is_share"), ((p > 0.5) == (F.col("prediction") == 1)).alias("cut_at_half"), "model_name",
                         "model_version", F.date_format("scored_at", "yyyy-MM-dd").alias("scored"))


@query("gbm_lr_scorecard", "SELECT doc_id, true AS is_share FROM documents")
def gbm_lr_scorecard(spark, sf):
    df = VectorAssembler(inputCols=NUM, outputCol="v").transform(checkpointed(documents(spark, sf)))
    known = df.where("label is not null")
    trees = GBTClassifier(featuresCol="v", labelCol="label", maxIter=20, maxDepth=3, seed=42).fit(known)
    model = scorecard.fit_leaf_logistic(trees, known, "v", "label")
    return scorecard.apply_leaf_logistic(model, df.select("doc_id", "v")).select("doc_id", F.col("probability").between(0, 1).alias("is_share"))


# a leaf's probability is the share of its labelled documents, its score the score of that
@query("tree_scorecard", "SELECT doc_id, true AS leaf_mean, true AS leaf_score FROM documents")
def tree_scorecard(spark, sf):
    df = VectorAssembler(inputCols=NUM, outputCol="v").transform(checkpointed(documents(spark, sf)))
    tree = DecisionTreeClassifier(featuresCol="v", labelCol="label", maxDepth=3, leafCol="leaf", seed=42).fit(df.where("label is not null"))
    leaves = tree.transform(df).select("doc_id", "label", "leaf", vector_to_array("probability")[1].alias("probability"))
    card = scorecard.leaf_scores(leaves, "leaf", "probability")
    share = leaves.groupBy("leaf").agg(F.avg("label").alias("_share"))
    scored = scorecard.apply_leaf(leaves, "leaf", card).join(share, "leaf")
    return scored.select("doc_id", (F.abs(F.col("probability") - F.col("_share")) < 1e-9).alias("leaf_mean"),
                         (F.col("score") == scorecard.prob_to_score(F.col("_share"))).alias("leaf_score"))


@query("lr_scorecard")
def lr_scorecard(spark, sf):
    df = checkpointed(documents(spark, sf))
    model, card = scorecard.fit_logistic_scorecard(df.where("label is not null"), "label", NUM, TEXT)
    return scorecard.apply_points(df, model, card).select("doc_id", "score", "label")


# two standardised columns: the shares are (1 + |r|) / 2 and (1 - |r|) / 2
@query("gen_components", f"""WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r, count(*) AS n FROM lineitem)
  SELECT CAST(unnest([1, 2]) AS INTEGER) AS component, {r('unnest([(1 + r) / 2, (1 - r) / 2])')} AS share, n AS n_rows FROM c""")
def gen_components(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    cols = li.columns
    scaled = TabularPreprocessor(numericCols=cols, scale="standard").fit(li).transform(li)
    wide, shares = generate.add_components(scaled, cols, k=2)
    rows = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(x).alias("share")) for i, x in enumerate(shares)])
    return rounded(wide.agg(F.count("pc1").alias("n_rows")).select(F.inline(rows), "n_rows"))
