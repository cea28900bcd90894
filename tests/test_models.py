import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import evaluate, models, scoring, tuning
from riskframe.plans import training
from riskframe.sources import registry, reports, tables


@pytest.fixture(scope="module")
def loans(spark):
    rng = np.random.default_rng(0)
    n = 400
    a, b = rng.normal(size=n), rng.normal(size=n)
    t = np.where(rng.random(n) < 0.5, "x", "y")
    y = (a + 0.5 * b + np.where(t == "x", 0.7, 0.0) + rng.normal(scale=0.4, size=n) > 0.9).astype(int)
    data = [(i, float(a[i]) if i % 10 else None, float(b[i]), str(t[i]), int(y[i]), float(3 * a[i] - b[i])) for i in range(n)]
    return spark.createDataFrame(data, "id int, a double, b double, t string, y int, target double").cache()


def auc(model, df):
    return evaluate.auc_ks(scoring.predict(model, df), "y", "probability").first()["auc"]


@pytest.mark.parametrize("code,options", [
    ("LR", {}), ("LR", {"sampler": "smote"}), ("LR", {"penalty": "l1"}), ("RF", {"n_estimators": 10, "max_depth": 5}),
    ("XGB", {"n_estimators": 5, "max_depth": 3, "sampler": "random_over"}),
    ("LGB", {"n_estimators": 5, "num_leaves": 8, "early_stopping": True}), ("DT", {"sampler": "random_under"})])
def test_classifiers_learn(loans, code, options):
    model = models.train(loans, "y", code, ["a", "b"], ["t"], key="id", **options)
    assert auc(model, loans) > 0.85
    assert set(models.importances(model)) >= {"a", "b"}


@pytest.mark.parametrize("code,options", [
    ("RIDGE", {}), ("XGB_REG", {"n_estimators": 10, "max_depth": 4}), ("RF_REG", {"n_estimators": 10, "max_depth": 6}),
    ("LGB_REG", {"n_estimators": 10, "num_leaves": 16, "early_stopping": True})])
def test_regressors_learn(loans, code, options):
    known = loans.where("a is not null")
    model = models.train(known, "target", code, ["a", "b"], key="id", **options)
    r2 = evaluate.regression_metrics(scoring.predict(model, known, task="regression"), "target", "prediction").first()["r2"]
    assert r2 > 0.8


def test_ridge_is_the_closed_form(loans):
    known = loans.where("a is not null")
    model = models.train(known, "target", "RIDGE", ["a", "b"], alpha=7.0).stages[-1]
    x = np.array([[r["a"], r["b"]] for r in known.collect()])
    y = np.array([r["target"] for r in known.collect()])
    x = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(x.T @ x + 7.0 * np.eye(2), x.T @ (y - y.mean()))
    assert list(model.coefficients) == pytest.approx(list(beta), abs=1e-6)


def test_logistic_penalty_matches_a_newton_solution(loans):
    known = loans.where("a is not null")
    model = models.train(known, "y", "LR", ["a", "b"], C=0.5, class_weight=None, tol=1e-12).stages[-1]
    data = known.collect()
    x = np.array([[r["a"], r["b"]] for r in data])
    x = np.c_[(x - x.mean(0)) / x.std(0), np.ones(len(x))]
    y, w = np.array([r["y"] for r in data]), np.zeros(3)
    penalty = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(0.5 * (x.T * (p * (1 - p))) @ x + penalty, 0.5 * x.T @ (p - y) + penalty @ w)
    assert list(model.coefficients) == pytest.approx(list(w[:2]), abs=1e-5)


def test_wrong_requests(loans):
    with pytest.raises(ValueError, match="classification"):
        models.train(loans, "target", "RIDGE", ["b"], key="id", sampler="smote")
    with pytest.raises(ValueError, match="unknown model"):
        models.train(loans, "y", "NB", ["b"])
    with pytest.raises(ValueError, match="row key"):
        models.train(loans, "y", "LR", ["b"], sampler="smote")
    model = models.train(loans, "y", "LR", ["a", "b"], max_iter=5)
    with pytest.raises(ValueError, match="missing columns"):
        scoring.predict(model, loans.drop("a"), ["a", "b"])


def test_registry(spark, loans, tmp_path):
    root = str(tmp_path)
    for v, at in (("v1", datetime(2024, 1, 1)), ("v2", datetime(2024, 1, 2))):
        model = models.train(loans, "y", "LR", ["a", "b"], ["t"], max_iter=3 if v == "v1" else 20)
        registry.save_model(model, root, "risk", v, at)
    listed = registry.list_models(registry.records(spark, root)).collect()
    assert [r["version"] for r in listed] == ["v2", "v1"]
    same = scoring.predict(registry.load_model(spark, root, "risk"), loans)
    assert same.columns == [*loans.columns, "prediction", "probability"]
    assert auc(registry.load_model(spark, root, "risk"), loans) == pytest.approx(auc(model, loans))
    with pytest.raises(ValueError):
        registry.load_model(spark, root, "risk", "v9")


def test_search_and_calibration(loans):
    folds = tuning.FoldedTable(loans, "y", "LR", ["a", "b"], ["t"], "id", k=3, sampler="random_over")
    trials = folds.search(tuning.grid_candidates({"C": [1e-6, 1.0], "penalty": ["l1"], "max_iter": [20]}))
    assert tuning.best_trial(trials).params["C"] == 1.0
    more = folds.sequential(3, {"C": (0.5, 2.0), "max_iter": [10]}, warmup=1)
    assert len(more) == 3 and all(t.score > 0.8 for t in more)
    folds.close()
    assert tuning.random_candidates("XGB", 4) == tuning.random_candidates("XGB", 4)
    for method in ("isotonic", "sigmoid"):
        cal = tuning.calibrate(loans, "y", "RF", ["a", "b"], ["t"], "id", method, n_estimators=5, max_depth=4)
        out = cal.transform(loans)
        gap = out.agg(F.abs(F.avg("probability") - F.avg("y"))).first()[0]
        assert gap < 0.1 and out.where("probability < 0 or probability > 1").count() == 0


def test_many_models_survive_a_failing_one(spark, loans):
    runs = training.train_many(loans, "y", [{"code": "LR", "max_iter": 10}, {"code": "NB"}], ["a", "b"], ["t"], "id", retries=1)
    assert [r["status"] for r in runs] == ["success", "failed"] and "NB" in runs[1]["error"]
    doc = runs[0]["result"]["evaluation_results"]
    matrix = doc["metrics"]["detailed_report"]["confusion_matrix"]
    assert sum(map(sum, matrix)) == pytest.approx(120, abs=1)
    ranked = evaluate.compare_runs(reports.result_rows(spark, [runs[0]["result"]])).first()
    assert ranked["auc"] > 0.85 and ranked["model_name"] == "LR"


def test_scoring_summary_and_provenance(loans):
    model = models.train(loans, "y", "LR", ["a", "b"], ["t"], max_iter=10)
    raw = model.transform(loans).select("id", vector_to_array("probability")[1].alias("p"))
    out = scoring.with_provenance(scoring.predict(model, loans), "LR", "v1", datetime(2024, 1, 1))
    assert out.join(raw, "id").where("p <> probability").count() == 0
    s = scoring.score_summary(out).first()
    assert s["n"] == 400 and s["positives"] + s["negatives"] == 400


def test_tables(spark, loans, tmp_path):
    path = str(tmp_path / "x.csv")
    tables.write_csv(loans.select("id", "t"), path)
    assert tables.read_table(spark, path, "id int, t string").count() == 400
    with pytest.raises(ValueError, match="unknown file type"):
        tables.read_table(spark, str(tmp_path / "x.xlsx"))
    loans.createOrReplaceTempView("loans_view")
    assert tables.read_table(spark, "loans_view").count() == 400
    tables.write_samples({"a": loans.limit(3)}, str(tmp_path / "s"), ["id"])
    assert tables.read_csv(spark, str(tmp_path / "s" / "a")).count() == 3


def test_registered_forest_regression_keeps_its_defaults(monkeypatch):
    from riskframe.catalog import modelling

    monkeypatch.setattr(modelling, "_regressor", lambda spark, sf, code, **kw: (code, kw))
    assert modelling.train_rf_reg(None, None) == ("RF_REG", {})


def test_boosted_regression_of_many_rows_is_fitted_on_different_features(spark, monkeypatch):
    rng = random.Random(5)
    data = [(str(i), a := rng.randrange(6) * 1.0, b := rng.randrange(5) * 1.0, rng.choice("uv"), 3 * a - b * b + rng.gauss(0, 1)) for i in range(900)]
    df = spark.createDataFrame(data + [("none", 1.0, None, "u", None)], "k string, a double, b double, t string, y double").repartition(3)
    fitted = []
    whole = models.make_estimator
    monkeypatch.setattr(models, "make_estimator", lambda *args, **kw: fitted.append(kw["weight"]) or whole(*args, **kw))

    def predicted(**more):
        model = models.train(df, "y", "XGB_REG", ["a", "b"], ["t"], key="k", n_estimators=6, max_depth=3, **more)
        return [r["prediction"] for r in model.transform(df.where("y is not null")).orderBy("k").collect()]

    slow = predicted()
    monkeypatch.setattr(models, "FEW_ROWS", 100)
    assert predicted() == pytest.approx(slow, abs=1e-8) and fitted == [None, "_weight"]
    predicted(subsample=0.5)  # samples and leaves of a least size are of rows
    predicted(min_child_weight=5)
    predicted(early_stopping=True)
    assert fitted[2:] == [None] * 3
    ready = models.prepare(df, "y", "XGB_REG", ["a", "b"], ["t"])
    cells = ready.collapsed("XGB_REG").data
    assert cells.count() <= 6 * 5 * 2 and cells.agg({"_weight": "sum"}).first()[0] == 900


def test_folds_of_documents_are_cut_from_counts_read_once(spark, tmp_path, monkeypatch):
    from riskframe.catalog import modelling

    docs = [(1, "a b 12\nc", "en", 8), (2, None, "de", 0), (3, "7", None, 1), (4, "no label", "en", 8), (5, "x", "en", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 0), (3, 1), (5, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(tuning, "FoldedTable", lambda df, *args, **kw: df)
    df = modelling._folds(spark, str(tmp_path), "LR", k=2)
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    got = sorted((r["doc_id"], r["n_lines"], r["n_words"], r["digits"], r["label"]) for r in df.collect())
    assert got == [(1, 1.0, 2.0, 2.0, 1), (2, None, None, None, 0), (3, 0.0, 0.0, 1.0, 1)]
