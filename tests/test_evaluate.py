import json
import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import evaluate
from riskframe.sources import reports
from tests.conftest import rows

# Golden matrix and metrics of a published test run.
MATRIX = [[168, 13], [23, 125]]


@pytest.fixture(scope="module")
def golden(spark):
    cells = [(t, p, MATRIX[t][p]) for t in (0, 1) for p in (0, 1)]
    return spark.createDataFrame(cells, "label int, prediction int, n long")


def test_golden_matrix(golden):
    got = {r["class"]: tuple(r)[1:] for r in evaluate.report_from_matrix(golden).collect()}
    assert got["0"] == (pytest.approx(0.8795811518324608), pytest.approx(0.9281767955801105), pytest.approx(0.9032258064516129), 181)
    assert got["1"] == (pytest.approx(0.9057971014492754), pytest.approx(0.8445945945945946), pytest.approx(0.8741258741258742), 148)
    assert got["macro avg"][2] == pytest.approx(0.8886758402887436)
    assert got["weighted avg"][:3] == (pytest.approx(0.8913743449731554), pytest.approx(0.8905775075987842), pytest.approx(0.8901352593871468))
    assert got["accuracy"][0] == pytest.approx(0.8905775075987842)


def test_class_never_predicted_scores_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "label int, prediction int")
    got = {r["class"]: tuple(r)[1:] for r in evaluate.classification_report(df, "label", "prediction").collect()}
    assert got["1"] == (0.0, 0.0, 0.0, 2)
    b = evaluate.binary_metrics(df, "label", "prediction").first()
    assert (b["precision"], b["recall"], b["predicted_positive_rate"]) == (0.0, 0.0, 0.0)


def brute_auc_ks(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ks = max([0.0] + [sum(p >= t for p in pos) / len(pos) - sum(n >= t for n in neg) / len(neg) for _, t in pairs])
    return auc, ks


@pytest.mark.parametrize("per_range", [None, 5])
def test_auc_and_ks_with_ties(spark, monkeypatch, per_range):
    if per_range:
        monkeypatch.setattr("riskframe.operators.ordering.ROWS_PER_RANGE", per_range)
    rng = random.Random(9)
    pairs = [(int(rng.random() < 0.3), 0.5 if rng.random() < 0.33 else round(rng.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "y int, s double").repartition(3)
    got = evaluate.auc_ks(df, "y", "s").first()
    auc, ks = brute_auc_ks(pairs)
    assert (got["auc"], got["ks"]) == (pytest.approx(auc), pytest.approx(ks))
    curve = evaluate.roc_curve(df, "y", "s")
    assert curve.count() == len({s for _, s in pairs}) + 1
    best = evaluate.ks_threshold(df, "y", "s").first()
    assert best["ks"] == pytest.approx(ks)


def test_single_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.7)], "y int, s double")
    assert tuple(evaluate.auc_ks(df, "y", "s").first()) == (None, None)


def test_inverse_scores_have_ks_zero_floor(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.9)], "y int, s double")
    assert tuple(evaluate.auc_ks(df, "y", "s").first()) == (0.0, 0.0)


def test_average_precision(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    assert evaluate.average_precision(df, "y", "s").first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_histogram_has_all_bins_and_a_closed_end(spark):
    df = spark.createDataFrame([(0.0,), (0.019,), (1.0,), (1.5,), (-0.1,)], "p double")
    got = {r["bin"]: r["n"] for r in evaluate.score_histogram(df, "p").collect()}
    assert len(got) == 50 and got[0] == 2 and got[49] == 1 and sum(got.values()) == 3


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    r = evaluate.regression_metrics(df, "y", "p").first()
    assert r["mse"] == pytest.approx(2 / 3) and r["mae"] == pytest.approx(2 / 3)
    assert r["r2"] == pytest.approx(1 - 2 / (14 / 3)) and r["mape"] == pytest.approx((1 + 0 + 0.25) / 3)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "y double, p double")
    assert evaluate.regression_metrics(flat, "y", "p").first()["r2"] is None


def test_error_histogram(spark):
    df = spark.createDataFrame([(0.0, float(i)) for i in range(20)], "y double, p double")
    got = evaluate.error_histogram(df, "y", "p").orderBy("bin").collect()
    assert len(got) == 19 and got[18]["n"] == 2 and sum(r["percent"] for r in got) == pytest.approx(100)
    exact = spark.createDataFrame([(1.0, 1.0)], "y double, p double")
    assert [tuple(r) for r in evaluate.error_histogram(exact, "y", "p").collect()] == [(0, 0.0, 0.0, 1, 100.0)]


# (sampler, model, accuracy, precision, recall, f1, auc, ks) of six published runs
RUNS = [("random_over", "RF", 0.92097, 0.92125, 0.92097, 0.92080, 0.9689413, 0.8648649),
        ("random_over", "XGB", 0.90274, 0.90292, 0.90274, 0.90252, 0.9548305, 0.8194341),
        ("smote", "RF", 0.92401, 0.92544, 0.92401, 0.92367, 0.9548305, 0.8550470),
        ("random_over", "LR", 0.88754, 0.89159, 0.88754, 0.88649, 0.9519561, 0.7973346),
        ("smote", "XGB", 0.89058, 0.89137, 0.89058, 0.89014, 0.9453860, 0.8187995),
        ("smote", "LR", 0.87234, 0.87757, 0.87234, 0.87087, 0.9026056, 0.7395849)]


def test_stored_results_are_ranked_like_the_published_table(spark, tmp_path):
    names = ("accuracy", "precision", "recall", "f1", "auc", "ks")
    for sampler, model, *values in reversed(RUNS):
        doc = {"model_name": model, "evaluation_results": {
            "model_name": model, "data_name": "test_creditcard", "imbalance_method": sampler,
            "metrics": {"test_metrics": dict(zip(names, values))}, "best_params": {"a__b": 1.5}, "status": "success"}}
        (tmp_path / f"pipeline_test_creditcard_{sampler}_{model}_results.json").write_text(json.dumps(doc, indent=2))
    stored = reports.read_results(spark, str(tmp_path))
    ranked = evaluate.compare_runs(stored)
    assert [(r["imbalance_method"], r["model_name"]) for r in ranked.collect()] == [(s, m) for s, m, *_ in RUNS]
    named = stored.select(*[e.alias(n) for n, e in reports.names_from_file().items()])
    assert rows(named, "imbalance_method", "model_name") == sorted([(s, m) for s, m, *_ in RUNS], key=repr)
    assert {r["data_name"] for r in named.collect()} == {"test_creditcard"}
    s = evaluate.runs_summary(ranked).first()
    assert (s["n_runs"], s["n_data"], s["n_samplers"], s["n_models"], s["best_model"]) == (6, 1, 2, 3, "RF")


def test_missing_metric_counts_as_zero(spark):
    doc = {"model_name": "LR", "evaluation_results": {"model_name": "LR", "data_name": "d", "imbalance_method": "none",
                                                      "metrics": {"test_metrics": {"accuracy": 1}}}}
    r = evaluate.compare_runs(reports.result_rows(spark, [doc])).first()
    assert (r["accuracy"], r["auc"]) == (1.0, 0.0)


def test_batch_summary_and_best_model(spark):
    jobs = spark.createDataFrame([("success",), ("failed",), ("success",)], "status string")
    assert tuple(evaluate.batch_summary(jobs).first()) == (3, 2, 1, pytest.approx(2 / 3))
    res = spark.createDataFrame([("b", 0.9), ("a", 0.9), ("c", 0.1)], "model_name string, auc double")
    assert tuple(evaluate.best_model(res, "auc").first()) == ("a", 0.9)
    assert [r["model_name"] for r in evaluate.compare_models(res).collect()] == ["a", "b", "c"]
    imp = spark.createDataFrame([("x", 3.0), ("y", 1.0)], "feature string, importance double")
    assert [tuple(r) for r in evaluate.importance_table(imp).collect()] == [("x", 3.0, 0.75, 525.0), ("y", 1.0, 0.25, 175.0)]
    assert evaluate.evaluate_bundle(spark.createDataFrame([("test", 1.0, 1.5), ("train", 2.0, 2.0), ("train", 1.0, 1.0)],
                                                          "split string, y double, p double"),
                                    "regression", "y", "p").where(F.col("metric") == "mae").count() == 2


def test_groups_without_scores_stay(spark):
    df = spark.createDataFrame([("train", 1, 1, 0.9), ("train", 0, 0, 0.1), ("test", 1, 1, None), (None, 1, 0, 0.5), (None, 0, 0, float("nan"))],
                               "split string, y int, p int, s double")
    got = {(r["split"], r["metric"]): r["value"] for r in evaluate.evaluate_bundle(df, "classification", "y", "p", "s").collect()}
    assert got["train", "auc"] == 1.0 and got["test", "auc"] is None and got["test", "accuracy"] == 1.0 and got[None, "accuracy"] == 0.5
    hist = evaluate.score_histogram(df, "s", 2, ["split"])
    assert {(r["split"], r["bin"]): r["n"] for r in hist.collect()}[None, 1] == 1


def test_scores_that_are_not_numbers_are_missing(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (0, float("nan"))], "y int, s double")
    assert evaluate.auc_ks(df, "y", "s").first()["auc"] == 1.0


def test_classes_can_be_text(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y string, p string")
    assert {(r["label"], r["prediction"], r["n"]) for r in evaluate.confusion_matrix(df, "y", "p").collect()} == {
        ("a", "a", 1), ("a", "b", 1), ("b", "b", 1)}
    report = {r["class"]: r["recall"] for r in evaluate.classification_report(df, "y", "p").collect()}
    assert report["a"] == 0.5 and report["b"] == 1.0
