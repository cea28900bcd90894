import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import binning


def brute(good, bad, bins, share, trend):
    n, best = len(good), (-np.inf, [])
    for k in range(min(bins, n)):
        for cuts in itertools.combinations(range(1, n), k):
            at = [0, *cuts, n]
            g = np.array([good[a:b].sum() for a, b in itertools.pairwise(at)], float)
            b = np.array([bad[a:b].sum() for a, b in itertools.pairwise(at)], float)
            if (g == 0).any() or (b == 0).any() or (g + b < share * (good.sum() + bad.sum())).any():
                continue
            step = np.diff(b / (g + b))
            if not {"any": True, "rising": (step > 0).all(), "falling": (step < 0).all(), "monotone": (step > 0).all() or (step < 0).all()}[trend]:
                continue
            pg, pb = g / good.sum(), b / bad.sum()
            iv = ((pb - pg) * np.log(pb / pg)).sum()
            if iv > best[0] + 1e-12:
                best = iv, list(cuts)
    return best[1]


@pytest.mark.parametrize("trend", binning.TRENDS)
@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_best_of_all(trend, seed):
    rng = np.random.default_rng(seed)
    n = 12 if seed else 3
    good, bad = rng.integers(0, 60, n), rng.integers(0, 30, n) + (np.arange(n) * (seed % 3)).astype(int)
    for bins, share in ((5, 0.05), (3, 0.15), (12, 0.0)):
        assert binning.best_cuts(good, bad, bins, share, trend) == brute(good, bad, bins, share, trend)


def test_no_cuts():
    zero = np.zeros(4, int)
    assert binning.best_cuts(zero, np.ones(4, int), 3) == [] == binning.best_cuts(zero[:0], zero[:0], 3)
    assert binning.best_cuts(np.array([5]), np.array([5]), 3) == []
    with pytest.raises(ValueError):
        binning.best_cuts(zero, zero, 3, trend="up")


def test_model(spark):
    x = F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise((F.col("id") * 37 % 1000).cast("double"))
    bad = (F.pmod(F.xxhash64("id"), F.lit(100)) < F.when(F.col("x") > 700, 70).when(F.col("x") > 300, 40).otherwise(10)).cast("int")
    df = spark.range(5000).withColumn("x", x).withColumn("y", bad).withColumn("t", F.when(F.col("id") % 3 > 0, "a")).withColumn("flat", F.lit(1.0))
    model = binning.fit_woe_supervised(df, "y", ["x", "flat"], ["t"], fine=40)
    assert any(abs(e - 700) < 30 for e in model.edges["x"]) and any(abs(e - 300) < 30 for e in model.edges["x"]) and model.edges["flat"] == []
    rows = model.bins().toPandas()
    assert rows.groupby("feature")[["good", "bad"]].sum().sum(axis=1).eq(5000).all()
    known = rows[(rows["feature"] == "x") & (rows["bin"] != "missing")].sort_values("low", na_position="first")
    rate = (known["bad"] / (known["good"] + known["bad"])).to_numpy()
    assert (np.diff(rate) > 0).all() and ((known["good"] + known["bad"]) >= 0.05 * 4500).all()
    counted = df.where("x is not null").select(F.col("x").cast("double").alias("x")).toPandas()["x"]
    assert [int(v) for v in np.histogram(counted, [-np.inf, *np.nextafter(model.edges["x"], np.inf), np.inf])[0]] == (known["good"] + known["bad"]).tolist()
    scored = model.transform(df)
    assert scored.where("x_woe is null or t_woe is null or flat_woe is null").isEmpty()
    empty = binning.fit_woe_supervised(df.where("false"), "y", ["x"], ["t"])
    assert empty.edges == {"x": []} and empty.table.isEmpty()
