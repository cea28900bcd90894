import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import forest, screening
from riskframe.plans import explore
from tests.conftest import rows


@pytest.fixture(scope="module")
def sample(spark):
    """A hundred rows: ordinary columns, a half-missing one, a constant one and a copy."""
    rng = random.Random(42)
    data = []
    for i in range(100):
        age, score = rng.gauss(40, 10), rng.gauss(650, 60)
        data.append((age, score, 2 * score + 1, None if i % 2 else rng.random(), 5.0, "ab"[i % 2], int(score > 650)))
    return data, spark.createDataFrame(data, "age double, score double, twin double, holes double, flat double, t string, y int")


def test_information_value_against_a_plain_computation(sample):
    data, df = sample
    got = {r["feature"]: r["iv"] for r in screening.information_values(df, "y", ["age", "holes"], ["t"]).collect()}
    bad_all = sum(r[-1] for r in data)
    good_all = len(data) - bad_all
    for c, i in (("age", 0), ("holes", 3), ("t", 5)):
        known = [r[i] for r in data if r[i] is not None]
        if c == "t":
            bins = [r[i] for r in data]
        else:
            edges = np.unique(np.quantile(known, np.linspace(0, 1, 11)))[1:-1]
            bins = ["missing" if r[i] is None else int((edges < r[i]).sum()) for r in data]
        iv = 0.0
        for b in set(bins):
            bad = sum(r[-1] for r, x in zip(data, bins) if x == b)
            good = sum(1 - r[-1] for r, x in zip(data, bins) if x == b)
            if good and bad:
                iv += (bad / bad_all - good / good_all) * math.log((bad / bad_all) / (good / good_all))
        assert got[c] == pytest.approx(abs(iv))


def test_constant_feature_and_single_class(sample):
    _, df = sample
    table = screening.woe_table(df, "y", ["flat"]).collect()
    assert len(table) == 1 and table[0]["iv_part"] == pytest.approx(0.0)
    one = screening.information_values(df.where("y = 1"), "y", ["age"]).first()
    assert one["iv"] is None and one["kept"]


def test_correlations_are_pairwise_complete(sample):
    data, df = sample
    r = screening.correlations(df, ["age", "score", "twin", "holes", "flat"])
    a = np.array([[np.nan if v is None else v for v in row[:5]] for row in data], float)
    both = ~np.isnan(a[:, 3])
    assert r["age", "score"] == pytest.approx(np.corrcoef(a[:, 0], a[:, 1])[0, 1])
    assert r["score", "twin"] == pytest.approx(1.0)
    assert r["score", "holes"] == pytest.approx(np.corrcoef(a[both, 1], a[both, 3])[0, 1])
    assert r["age", "flat"] is None and r["holes", "flat"] is None


def test_a_dropped_column_still_drops_later_ones(spark):
    rng = random.Random(1)
    base = [rng.gauss(0, 1) for _ in range(500)]
    data = [(x, x + rng.gauss(0, 0.3), x + rng.gauss(0, 0.3)) for x in base]
    df = spark.createDataFrame(data, "a double, b double, c double")
    kept = {r["feature"]: r["kept"] for r in screening.correlation_screen(df, ["a", "b", "c"], 0.85).collect()}
    assert kept == {"a": True, "b": False, "c": False}


def test_f_tests(sample):
    data, df = sample
    f = {r["feature"]: r["f"] for r in screening.f_classification(df, "y", ["age", "flat", "holes"], 2).collect()}
    groups = [np.array([r[0] for r in data if r[-1] == c]) for c in (0, 1)]
    grand = np.mean([r[0] for r in data])
    between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert f["age"] == pytest.approx(between / (within / 98)) and f["flat"] is None
    reg = {r["feature"]: (r["f"], r["kept"]) for r in screening.f_regression(df, "score", ["age", "twin", "flat"], 2).collect()}
    corr = np.corrcoef([r[0] for r in data], [r[1] for r in data])[0, 1]
    assert reg["age"] == (pytest.approx(corr ** 2 * 98 / (1 - corr ** 2)), True)
    assert reg["twin"][0] > 1e12 and reg["flat"] == (None, False)


def test_mutual_information_of_a_copy_is_its_entropy(spark):
    df = spark.createDataFrame([(float(i % 4), 5.0, str(i % 4), i % 4) for i in range(400)],
                               "x double, flat double, t string, y int")
    got = {r["feature"]: r["mi"] for r in screening.mutual_information(df, "y", ["x", "flat"], ["t"]).collect()}
    assert got["t"] == pytest.approx(math.log(4))
    # the smallest value shares the first interval with the next one
    assert got["x"] == pytest.approx(0.5 * math.log(2) + 0.5 * math.log(4))
    assert got["flat"] == pytest.approx(0.0, abs=1e-12)
    reg = screening.mutual_information(df, "x", ["flat"], task="regression").first()
    assert reg["mi"] == pytest.approx(0.0, abs=1e-12)


def test_vif_and_chi_square(spark):
    data = [(i % 2, (i // 2) % 2, i % 2 if i % 10 else 1 - i % 2) for i in range(200)]
    df = spark.createDataFrame([(float(a), float(b), c) for a, b, c in data], "a double, b double, y int")
    chi = {r["feature"]: (r["chi2"], r["kept"]) for r in screening.chi_square(df, "y", ["a", "b"], k=1).collect()}
    assert chi["a"][1] and not chi["b"][1] and chi["a"][0] > chi["b"][0]
    vif = rows(screening.variance_inflation(df, ["a", "b"]))
    assert [v[1] for v in vif] == [pytest.approx(1.0), pytest.approx(1.0)]


def test_steps_in_a_row_keep_schema_order(sample):
    _, df = sample
    cols = ["age", "score", "twin", "holes", "flat"]
    s = screening.FeatureSelector("y", missing_rate_threshold=0.4).fit(df, cols)
    assert s.get_removed_features() == {"missing_rate": ["holes"], "correlation": ["twin"], "variance": ["flat"]}
    assert s.get_selected_features() == ["age", "score"] and s.transform(df).columns == ["age", "score", "y"]
    with pytest.raises(ValueError):
        screening.FeatureSelector("y").get_selected_features()
    train, test, names = screening.select_k_best(df, df.limit(5), "y", ["age", "score"], 1)
    assert names == ["score"] and test.columns == ["score", "y"] and train.count() == 100


def test_exploration_maps_encoded_columns_back(sample):
    _, df = sample
    found = explore.explore_features(df, "y", ["age", "score", "holes", "flat"], ["t"], missing_rate_threshold=0.4)
    assert found.sources == ["age", "score", "t"]
    assert found.selector.removed["missing_rate"] == ["holes"] and "flat" in found.selector.removed["variance"]


def test_recursive_elimination(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    x[:, 3] = x[:, 0] * 0.9 + 0.3 * x[:, 3]
    x[:, 5] = 2.0
    y = x @ [3.0, -0.2, 1.0, 0.5, 0.05, 0.0] + rng.normal(size=400)
    names = [f"c{k}" for k in range(6)]
    rows = [(*map(float, v), float(t)) for v, t in zip(x, y, strict=True)]
    rows += [(None, *[1.0] * 5, 9.0), (*[1.0] * 6, float("nan"))]
    df = spark.createDataFrame(rows, [*names, "y"]).repartition(3)
    left, want = [0, 1, 2, 3, 4], {5: 0.0}
    order = [5]
    z = (x[:, :5] - x[:, :5].mean(axis=0)) / x[:, :5].std(axis=0)
    t = (y - y.mean()) / y.std()
    while len(left) > 2:  # refit every time
        beta = np.linalg.lstsq(z[:, left], t, rcond=None)[0]
        k = left[int(np.abs(beta).argmin())]
        want[k] = beta[np.abs(beta).argmin()]
        order.append(k)
        left.remove(k)
    want.update(zip(left, np.linalg.lstsq(z[:, left], t, rcond=None)[0], strict=True))
    got = {r.feature: r for r in screening.recursive_elimination(df, "y", names, 2).collect()}
    assert [got[f"c{k}"].rank for k in order] == [5, 4, 3, 2] and [got[f"c{k}"].kept for k in left] == [True, True]
    assert all(got[f"c{k}"].beta == pytest.approx(b, abs=1e-9) for k, b in want.items())
    with pytest.raises(ValueError):
        screening.recursive_elimination(df, "y", names, 0)


def test_importance_of_many_rows_is_grown_on_counted_bins(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"a": rng.integers(0, 12, 4000) * 1.0, "b": rng.integers(0, 40, 4000) / 7, "flat": 2.0, "c": rng.integers(0, 3, 4000) * 1.0})
    df = spark.createDataFrame(x.assign(y=(x["a"] + 0.2 * x["b"] + rng.normal(size=4000) > 6).astype(int))).repartition(3)
    cols = list(x.columns)
    slow = {r["feature"]: r["importance"] for r in screening.model_importance(df, "y", cols, family="RF").collect()}
    seen = []
    monkeypatch.setattr(screening, "FEW_ROWS", 100)
    monkeypatch.setattr(screening, "cell_importance", lambda s, cells, settings: seen.append(cells) or forest.cell_importance(s, cells, settings))
    got = screening.model_importance(df, "y", cols, family="RF").collect()
    assert len(seen) == 1 and len(seen[0].x) <= 12 * 32 * 3 and seen[0].parts.sum() == 4000
    fast = {r["feature"]: r["importance"] for r in got}
    assert list(fast) == cols and sum(fast.values()) == pytest.approx(1)
    assert fast["flat"] == 0 and all(abs(fast[c] - slow[c]) < 0.05 for c in cols)
    assert got == screening.model_importance(df.repartition(5), "y", cols, family="RF").collect()
    apart = df.withColumn("a", F.rand(1)).withColumn("b", F.rand(2)).withColumn("c", F.rand(3))  # bins tell all rows apart: Spark's forest
    screening.model_importance(apart, "y", cols, family="RF", trees=2)
    assert len(seen) == 2
