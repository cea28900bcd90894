import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import boosting
from riskframe.operators.boosting import Settings


def made(n=2000, seed=0, squared=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(1)
    x[rng.random((n, 4)) < 0.1] = np.nan
    x[:, 3] = rng.integers(0, 3, n)
    signal = np.nan_to_num(x[:, 0]) * 2 + np.nan_to_num(x[:, 1], nan=2.0) ** 2 + x[:, 3] + rng.normal(size=n)
    return x, signal if squared else (signal > 2).astype(float), rng.random(n) + 0.5


def frame(spark, x, y, w, held=None):
    return spark.createDataFrame(pd.DataFrame({"features": list(x), "label": y, "w": w, "held": np.zeros(len(y), bool) if held is None else held})).repartition(3)


def plain_margin(x, y, w, s, cuts, base):
    """Trees grown by trying every cut of every node on its rows, without histograms."""
    def soft(g):
        return np.sign(g) * max(abs(g) - s.reg_alpha, 0)

    margin, sizes = np.full(len(y), base), []
    for _ in range(s.n_estimators):
        p = 1 / (1 + np.exp(-margin))
        g, h = ((margin - y) * w, w.copy()) if s.objective == "squared" else ((p - y) * w, p * (1 - p) * w)

        def best(rows, g=g, h=h):
            score = lambda r: soft(g[r].sum()) ** 2 / (h[r].sum() + s.reg_lambda)
            out = None
            for f in range(x.shape[1]):
                v = x[rows, f]
                for c in cuts[f]:
                    for missing_left in (True, False):
                        left = np.where(np.isnan(v), missing_left, v <= c)
                        a, b = rows[left], rows[~left]
                        if min(len(a), len(b)) < max(1, s.min_child_samples) or min(h[a].sum(), h[b].sum()) < s.min_child_weight:
                            continue
                        gain = 0.5 * (score(a) + score(b) - score(rows)) - s.gamma
                        if gain > 1e-12 and (out is None or gain > out[0] + 1e-9):
                            out = gain, a, b
            return out

        leaves = [(0, np.arange(len(y)))]
        if s.num_leaves:
            while len(leaves) < s.num_leaves:
                found = [(k, best(r)) for k, (_, r) in enumerate(leaves)]
                found = [x for x in found if x[1]]
                if not found:
                    break
                k, (_, a, b) = max(found, key=lambda x: x[1][0])
                leaves[k:k + 1] = [(0, a), (0, b)]
        else:
            done = []
            while leaves:
                d, r = leaves.pop()
                found = best(r) if d < s.max_depth else None
                if found:
                    leaves += [(d + 1, found[1]), (d + 1, found[2])]
                else:
                    done.append((d, r))
            leaves = done
        sizes.append(len(leaves))
        margin = margin.copy()
        for _, r in leaves:
            margin[r] -= s.learning_rate * soft(g[r].sum()) / (h[r].sum() + s.reg_lambda)
    return margin, sizes


@pytest.mark.parametrize("settings", [
    {"max_depth": 3}, {"max_depth": 3, "reg_alpha": 2.0, "reg_lambda": 3.0, "gamma": 1.0, "min_child_weight": 5.0}, {"num_leaves": 7, "max_depth": None},
    {"objective": "squared", "max_depth": 2, "min_child_samples": 40}, {"objective": "squared", "num_leaves": 5, "max_depth": None, "reg_alpha": 1.0}])
def test_equals_growing_on_rows(spark, settings):
    s = Settings(n_estimators=4, max_bins=12, **settings)
    x, y, w = made(squared=s.objective == "squared")
    df = frame(spark, x, y, w)
    model = boosting.fit(df, s, weight="w")
    mean = (y * w).sum() / w.sum()
    assert model.base == pytest.approx(mean if s.objective == "squared" else np.log(mean / (1 - mean)), abs=1e-12)
    want, sizes = plain_margin(x, y, w, s, model.cuts, model.base)
    assert [sum(f < 0 for f in t.feature) for t in model.trees] == sizes
    if s.num_leaves:
        assert set(sizes) == {s.num_leaves}
    got = model.transform(df).select("features", "label", "w", "prediction", *(["probability"] if s.objective == "logistic" else [])).collect()
    value = (lambda r: r.prediction) if s.objective == "squared" else (lambda r: np.log(r.probability[1] / r.probability[0]))
    by = dict(zip(w.tolist(), want.tolist(), strict=True))  # weights are all different
    assert len(by) == len(got) and max(abs(value(r) - by[r.w]) for r in got) < 1e-9


def test_leaves_are_minus_g_over_h(spark):
    x, y, w = made()
    df = frame(spark, x, y, w)
    s = Settings(n_estimators=1, reg_lambda=2.0)
    model = boosting.fit(df, s, weight="w")
    p = 1 / (1 + np.exp(-model.base))
    sums = model.transform(df, leaf=True).groupBy("leaf").agg(F.sum((F.lit(p) - F.col("label")) * F.col("w")).alias("g"), F.sum(F.lit(p * (1 - p)) * F.col("w")).alias("h"))
    nodes = {r.node: r for r in model.table(spark).where("feature < 0").collect()}
    found = {r.leaf: r for r in sums.collect()}
    assert found.keys() == nodes.keys()
    for k, r in found.items():
        assert nodes[k].value == pytest.approx(-0.1 * r.g / (r.h + 2.0), abs=1e-12) and nodes[k].g == pytest.approx(r.g, abs=1e-9)


def test_patience_and_sampling(spark, monkeypatch):
    x, y, w = made(3000, 5)
    held = np.arange(3000) % 4 == 0
    df = frame(spark, x, y, w, held)
    s = Settings(n_estimators=200, learning_rate=0.5, patience=4, subsample=0.7, colsample_bytree=0.75)
    model = boosting.fit(df, s, validation="held")
    losses = [h for _, _, h in model.history]
    best = int(np.argmin(losses))
    assert len(model.trees) == best > 0 and len(losses) == best + 5
    again = boosting.fit(df, s, validation="held")
    assert [t.feature for t in again.trees] == [t.feature for t in model.trees]
    monkeypatch.setattr(boosting, "KEPT_BYTES", 0)  # a worker that forgets, several tasks, and sums in a tree
    monkeypatch.setattr(boosting, "TASK_ROWS", 1000)
    monkeypatch.setattr(boosting, "PARTIALS", 1)
    forgetful = boosting.fit(df, Settings(n_estimators=5), weight="w")
    monkeypatch.undo()
    assert [t.feature for t in forgetful.trees] == [t.feature for t in boosting.fit(df, Settings(n_estimators=5), weight="w").trees]
    with pytest.raises(ValueError):
        boosting.fit(df, Settings(patience=3))


def test_edges(spark):
    empty = frame(spark, *made(5)).where("label > 5")
    model = boosting.fit(empty, Settings(n_estimators=3))
    assert model.trees == []
    one = spark.createDataFrame([([1.0], 1.0), ([1.0], 1.0), ([float("nan")], None)], "features array<double>, label double")
    model = boosting.fit(one, Settings(n_estimators=3))
    assert len(model.trees) == 1 and model.transform(one).count() == 3  # nothing to split on
    for bad in ({"objective": "x"}, {"max_depth": None}, {"max_bins": 1}):
        with pytest.raises(ValueError):
            Settings(**bad)
