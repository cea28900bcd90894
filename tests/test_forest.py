from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import forest
from riskframe.operators.forest import Settings


def made(n=1500, seed=0, classes=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(1)
    x[rng.random((n, 3)) < 0.05] = np.nan
    x[: n // 3] = x[0]  # a third of the rows cannot be told apart
    y = np.nan_to_num(x[:, 0]) * 2 + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(size=n)
    return x, (y > 1).astype(float) if classes else y, rng.integers(1, 4, n).astype(float)


def frame(spark, x, y, w, parts=3):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(y)), "features": list(x), "label": y, "w": w})).repartition(parts)


def cell_means(x, y, w):
    d = pd.DataFrame(np.nan_to_num(x, nan=-1e9), columns=list("abc")).assign(y=y * w, w=w)
    g = d.groupby(list("abc"))
    return (g["y"].transform("sum") / g["w"].transform("sum")).to_numpy()


def predictions(model, df):
    out = model.transform(df).orderBy("id").toPandas()
    return out["prediction"].to_numpy()


@pytest.mark.parametrize("subtree_rows", [10_000, 120])
def test_an_unlimited_tree_ends_at_rows_that_cannot_be_told_apart(spark, subtree_rows):
    x, y, w = made()
    df = frame(spark, x, y, w)
    model = forest.fit(df, Settings(n_estimators=2, bootstrap=False, subtree_rows=subtree_rows, max_bins=8), weight="w", key="id")
    assert (len(model.tops[0][0]) > 1) == (subtree_rows < 1500)
    np.testing.assert_allclose(predictions(model, df), cell_means(x, y, w), atol=1e-9)
    leaves = model.nodes().where("feature < 0")
    assert leaves.groupBy("tree").agg(F.sum("rows")).collect()[0][1] == len(y)


@pytest.mark.parametrize("classes", [False, True])
@pytest.mark.parametrize("bootstrap", [False, True])
def test_rows_of_equal_features_are_taken_together_and_give_the_same_forest(spark, bootstrap, classes):
    rng = np.random.default_rng(8)
    x = rng.integers(0, [6, 5, 4], size=(900, 3)).astype(float)
    x[rng.random((900, 3)) < 0.05] = np.nan
    y = 3 * np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1]) ** 2 + rng.normal(size=900)
    y, w = ((y > np.median(y)).astype(float) if classes else y), rng.integers(1, 4, 900).astype(float)
    df = frame(spark, x, y, w)
    s = Settings("classification" if classes else "regression", n_estimators=4, bootstrap=bootstrap, max_features="all", min_samples_leaf=4, subtree_rows=400)
    model, rows = forest.fit(df, s, weight="w", key="id"), forest.fit(df, replace(s, subtree_rows=10_000), weight="w", key="id")
    assert [len(t[0]) for t in model.tops] == [1] * 4  # few cells, many rows: one task grows a tree
    np.testing.assert_allclose(predictions(model, df), predictions(rows, df), atol=1e-9)
    np.testing.assert_allclose(model.featureImportances.toArray(), rows.featureImportances.toArray(), atol=1e-9)
    held = [m.nodes().where("feature < 0").groupBy("tree").agg(F.sum("rows"), F.count("*")).orderBy("tree").collect() for m in (model, rows)]
    assert held[0] == held[1]
    topped = forest.fit(df, replace(s, subtree_rows=60, max_depth=3), weight="w", key="id")  # more cells than a task should hold
    assert len(topped.tops[0][0]) > 1
    plain = forest.fit(df, replace(s, subtree_rows=10_000, max_depth=3), weight="w", key="id")
    np.testing.assert_allclose(predictions(topped, df), predictions(plain, df), atol=1e-9)


def test_scores_are_remembered_by_features_and_right_when_names_meet(monkeypatch):
    rng = np.random.default_rng(1)
    asked = []

    def means(m):
        asked.append(len(m))
        return m.sum(axis=1, keepdims=True)

    known = forest._Known(means, 2, 1)
    batches = [rng.integers(0, 5, (300, 2)).astype(float) for _ in range(4)]
    for m in batches:
        np.testing.assert_array_equal(known.of(m)[:, 0], m.sum(axis=1))
    assert sum(asked) <= 25
    monkeypatch.setattr(forest, "_mix", lambda x: x * np.uint64(0))  # all names are equal
    known = forest._Known(means, 2, 1)
    for m in batches:
        np.testing.assert_array_equal(known.of(m)[:, 0], m.sum(axis=1))


def brute(x, y, w, depth, least):
    """Mean of each row's leaf by trying every cut of every node."""
    x = np.where(np.isnan(x), -np.inf, x)
    out = np.zeros(len(y))

    def node(rows, d):
        best = None
        if d < depth and len(set(y[rows])) > 1:
            for f in range(x.shape[1]):
                for t in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= t
                    if min(left.sum(), (~left).sum()) >= least:
                        gain = sum((w[r] * y[r]).sum() ** 2 / w[r].sum() for r in (rows[left], rows[~left]))
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, rows[left], rows[~left]
        if best is None:
            out[rows] = (w[rows] * y[rows]).sum() / w[rows].sum()
        else:
            node(best[1], d + 1)
            node(best[2], d + 1)

    node(np.arange(len(y)), 0)
    return out


def test_splits_are_the_best_of_all(spark):
    x, y, w = made(300, 4)
    y = y - np.average(y, weights=None)
    df = frame(spark, x, y, w)
    model = forest.fit(df, Settings(n_estimators=1, bootstrap=False, max_depth=3, min_samples_leaf=5), weight="w", key="id")
    np.testing.assert_allclose(predictions(model, df), brute(x, y, w, 3, 5), atol=1e-9)


def test_same_forest_on_any_partitioning_and_by_joining(spark):
    x, y, w = made(800, 2)
    s = Settings(n_estimators=5, subtree_rows=200, seed=3)
    a, b = (forest.fit(frame(spark, x, y, w, p), s, weight="w", key="id") for p in (2, 5))
    df = frame(spark, x, y, w)
    first = predictions(a, df)
    np.testing.assert_allclose(first, predictions(b, df), atol=1e-9)
    a.broadcast_bytes = 0
    np.testing.assert_allclose(first, predictions(a, df), atol=1e-9)
    clash = df.withColumns({"_row": F.struct("id", "label"), "_FOREST": F.col("id") + 1})  # as scoring names the rows that it takes along
    for size in (0, forest.BROADCAST_BYTES):
        a.broadcast_bytes = size
        kept = a.transform(clash).select("_row.*", "_FOREST", "prediction").orderBy("id").toPandas()
        np.testing.assert_allclose(kept["prediction"], first, atol=1e-9)
        assert (kept["_FOREST"] == kept["id"] + 1).all()
    sampled = a.nodes().where("feature < 0").agg(F.sum("rows")).first()[0] / (5 * 800)
    assert 0.58 < sampled < 0.69  # rows that a sample of n out of n holds: 1 - 1/e


def test_classes_importance_and_storing(spark, tmp_path):
    x, y, w = made(900, 5, classes=True)
    df = frame(spark, x, y, w)
    model = forest.fit(df, Settings("classification", n_estimators=8, subtree_rows=300), weight="w", key="id")
    out = model.transform(df).select("id", "label", "prediction", vector_to_array("probability").alias("p")).orderBy("id").toPandas()
    p = np.stack(out["p"])
    np.testing.assert_allclose(p.sum(axis=1), 1)
    assert ((p[:, 1] > 0.5) == (out["prediction"] == 1)).all()
    assert (out["prediction"] == out["label"])[300:].mean() > 0.9
    shares = model.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares.argmin() == 2
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    np.testing.assert_array_equal(predictions(again, df), out["prediction"])
    with pytest.raises(ValueError):
        forest.fit(df.withColumn("label", F.lit(0.5)), Settings("classification"))


def test_empty_and_missing(spark):
    x, y, w = made(50)
    df = frame(spark, x, y, w)
    none = forest.fit(df.where("false"), Settings(n_estimators=2))
    assert none.transform(df).where("prediction is not null").isEmpty()
    one = forest.fit(df.withColumn("label", F.lit(2.0)), Settings(n_estimators=2), key="id")
    holes = df.withColumn("features", F.when(F.col("id") > 3, F.col("features")))
    got = one.transform(holes).orderBy("id").toPandas()["prediction"]
    assert got[:4].isna().all() and np.allclose(got[4:], 2.0)
    assert one.nodes().count() == 2


def test_numbers_of_features():
    assert [Settings("classification").tried(16), Settings().tried(16), Settings(max_features="log2").tried(16), Settings(max_features=0.5).tried(16),
            Settings(max_features=3).tried(16), Settings(max_features="0.25").tried(16)] == [4, 16, 4, 8, 3, 4]
