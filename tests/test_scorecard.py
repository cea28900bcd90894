import math

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskframe.operators import scorecard

B = 20 / math.log(2)


@pytest.fixture(scope="module")
def loans(spark):
    data = [(i, float(i % 40), "xyz"[i % 3], int((i % 40) + 7 * (i % 3) + (i * 13) % 17 > 35)) for i in range(600)]
    return spark.createDataFrame(data, "id int, a double, t string, y int")


def test_probability_and_score(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (1.0,), (0.8,), (None,)], "p double")
    got = [r[0] for r in df.select(scorecard.prob_to_score(F.col("p"))).collect()]
    assert got == [600, round(600 - B * math.log(0.001 / 0.999)), round(600 - B * math.log(999)), round(600 - B * math.log(4)), None]
    s = spark.createDataFrame([(300.0,), (320.0,)], "s double")
    assert [r[0] for r in s.select(scorecard.score_to_prob(F.col("s"))).collect()] == [pytest.approx(0.5), pytest.approx(2 / 3)]


def test_bands(spark):
    df = spark.createDataFrame([(800,), (799,), (600,), (550,), (499,)], "s int")
    assert [r[0] for r in df.select(scorecard.risk_band_5(F.col("s"))).collect()] == ["优秀", "良好", "一般", "风险", "高风险"]
    assert [r[0] for r in df.select(scorecard.risk_band_6(F.col("s"))).collect()] == [
        "极低风险", "极低风险", "中高风险", "高风险", "极高风险"]


def test_weighted_bins_at_their_limits(spark):
    w = scorecard.importance_weights({"a": 3.0, "b": 1.0})
    assert w == {"a": 525.0, "b": 175.0}
    df = spark.createDataFrame([(-1.0, 0.0), (-0.5, None), (0.0, 1.0), (1.0, 5.0), (-9.0, -9.0)], "a double, b double")
    # bins are closed on the left, missing counts as zero, the sum is cut and limited
    want = [int(300 - 0.3 * 525 + 0.3 * 175), int(300 + 0 + 0.3 * 175), int(300 + 0.3 * 525 + 0.7 * 175), 790, 0]
    assert [r["score"] for r in scorecard.apply_weighted_bins(df, w).collect()] == want
    parts = scorecard.bin_contributions(df.withColumn("k", F.monotonically_increasing_id()), ["k"], w)
    assert parts.count() == 10
    assert scorecard.weighted_bins(spark, w).count() == 12


def test_linear_card(spark):
    w = scorecard.importance_weights({"a": 1.0}, scorecard.LINEAR_WEIGHT)
    df = spark.createDataFrame([(-3.0,), (0.0,), (99.0,), (None,)], "a double")
    assert [r["score"] for r in scorecard.linear_score(df, w).collect()] == [600, 850, 850, None]
    assert [r["score"] for r in scorecard.linear_score(df, w, scale=0.02).collect()] == [600, 700, 800, None]
    p = spark.createDataFrame([(620,), (600,), (300,)], "s int").select(
        *[e.alias(n) for n, e in scorecard.linear_probability(F.col("s")).items()]).collect()
    assert [r["predicted"] for r in p] == [1, 0, 0] and p[0]["probability"] == pytest.approx(2 / 3) and p[2]["probability"] == 0.001


def test_points_add_up_to_the_log_odds(loans):
    model = scorecard.fit_woe(loans, "y", ["a"], ["t"], 5)
    coef, intercept = {"a": 0.9, "t": 0.4}, -0.3
    card = scorecard.scorecard_points(model.table, coef, intercept, digits=None)
    scored = scorecard.apply_points(loans, model, card)
    woe = model.transform(scored)
    for r in woe.limit(50).collect():
        log_odds = intercept + 0.9 * r["a_woe"] + 0.4 * r["t_woe"]
        assert r["score"] == pytest.approx(600 + B * math.log(50) - B * log_odds)


def test_long_bin_lists_use_a_join_and_give_the_same(loans, monkeypatch):
    model = scorecard.fit_woe(loans, "y", ["a"], ["t"])
    inline = {r["id"]: (r["a_woe"], r["t_woe"]) for r in model.transform(loans).collect()}
    monkeypatch.setattr(scorecard, "INLINE_BINS", 0)
    assert {r["id"]: (r["a_woe"], r["t_woe"]) for r in model.transform(loans).collect()} == inline


def test_unseen_category_weighs_nothing(spark, loans):
    model = scorecard.fit_woe(loans, "y", ["a"], ["t"])
    new = spark.createDataFrame([(1, 3.0, "q", 0)], loans.schema)
    assert model.transform(new).first()["t_woe"] == 0.0


def test_bins_have_limits(loans):
    b = [r for r in scorecard.fit_woe(loans, "y", ["a"], bins=4).bins().orderBy("bin").collect()]
    assert b[0]["low"] is None and b[-1]["high"] is None and b[1]["low"] == b[0]["high"]


def test_leaf_scores_and_unknown_leaf(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4), (2, 0.0)], "leaf int, p double")
    card = scorecard.leaf_scores(df, "leaf", "p")
    got = {r["leaf"]: (r["n"], r["score"]) for r in card.collect()}
    assert got == {1: (2, round(600 - B * math.log(0.3 / 0.7))), 2: (1, round(600 - B * math.log(0.001 / 0.999)))}
    new = spark.createDataFrame([(2,), (7,)], "leaf int")
    assert [r["score"] for r in scorecard.apply_leaf(new, "leaf", card).orderBy("leaf").collect()] == [got[2][1], 300]


def test_leaf_logistic_of_a_forest_survives_saving(loans, tmp_path):
    from pyspark.ml import PipelineModel

    data = VectorAssembler(inputCols=["a"], outputCol="v").transform(loans)
    forest = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=3, maxDepth=2, seed=1).fit(data)
    model = scorecard.fit_leaf_logistic(forest, data, "v", "y")
    out = {r["id"]: r["score"] for r in scorecard.apply_leaf_logistic(model, data).collect()}
    model.write().overwrite().save(str(tmp_path / "m"))
    again = scorecard.apply_leaf_logistic(PipelineModel.load(str(tmp_path / "m")), data)
    assert {r["id"]: r["score"] for r in again.collect()} == out and len(set(out.values())) > 2


def test_fitted_card_separates_the_classes(loans):
    model, card = scorecard.fit_logistic_scorecard(loans, "y", ["a"], ["t"], 5)
    means = {r["y"]: r["m"] for r in scorecard.apply_points(loans, model, card).groupBy("y").agg(F.avg("score").alias("m")).collect()}
    assert means[0] > means[1] + 20  # a bad customer scores low
    s = scorecard.score_statistics(scorecard.apply_points(loans, model, card), "score").first()
    assert s["min_score"] <= s["avg_score"] <= s["max_score"]
