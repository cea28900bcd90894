import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import ordering
from tests.conftest import rows


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    data = [(("a", "b")[i % 2], rng.choice([5.0, round(rng.gauss(0, 10), 3)])) for i in range(6000)]
    return data, spark.createDataFrame(data, "g string, x double").repartition(5)


def brute_totals(data):
    out = []
    for g in sorted({g for g, _ in data}):
        values = sorted(x for k, x in data if k == g)
        for v in sorted(set(values)):
            out.append((g, v, values.count(v), sum(1 for y in values if y <= v), len(values)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_range", [None, 50])
def test_running_totals_is_the_same_with_and_without_ranges(numbers, per_range):
    data, df = numbers
    got = ordering.running_totals(df, ["g"], "x", {"n": F.lit(1)}, per_range)
    assert rows(got, "g", "x", "n", "n_cum", "n_all") == brute_totals(data)


def test_cut_points_spread_distinct_values(numbers):
    data, df = numbers
    points = ordering.cut_points(df, ["g"], "x", per_range=100)
    distinct = sorted({x for _, x in data})
    sizes = np.histogram(distinct, bins=[-math.inf, *points, math.inf])[0]
    assert len(points) > 10 and max(sizes) < 8 * 100
    assert ordering.cut_points(df, ["g"], "x") == []


@pytest.mark.parametrize("kind", ["double", "string"])
def test_position_by_binary_search(spark, kind):
    values = [1.0, 2.5, 2.75, 9.0, 11.0] if kind == "double" else ["b", "c", "ca", "x"]
    probes = [0.0, 1.0, 2.6, 9.0, 100.0] if kind == "double" else ["a", "b", "c'", "cb", "é"]
    df = spark.createDataFrame([(p,) for p in probes] + [(None,)], f"x {kind}")
    got = {r["x"]: r["pos"] for r in ordering.with_position(df, F.col("x"), values, "pos").collect()}
    assert got == {None: 0, **{p: sum(v < p for v in values) for p in probes}}


@pytest.mark.parametrize("small", [200_000, 0])
def test_percentiles_are_exact_on_both_paths(spark, small):
    rng = random.Random(5)
    # one value holds a third of the rows
    data = [(7.0 if i % 3 == 0 else rng.uniform(-50, 50), None if i % 4 else float(i % 13), None) for i in range(5001)]
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = ordering.exact_percentiles(df, ["a", "b", "c"], probs, small, per_range=20)
    for i, c in enumerate("ab"):
        want = np.quantile([r[i] for r in data if r[i] is not None], probs)
        assert got[c] == pytest.approx(list(want), abs=1e-12)
    assert got["c"] == [None] * len(probs)


def test_percentiles_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(4.0,)], "a double")
    for small in (10, 0):
        assert ordering.exact_percentiles(one, ["a"], [0.0, 0.5, 1.0], small) == {"a": [4.0, 4.0, 4.0]}
        assert ordering.exact_percentiles(one.where("false"), ["a"], [0.5], small) == {"a": [None]}


def test_group_of_nulls_on_both_paths(spark):

    df = spark.createDataFrame([("a" if i < 20 else None, float(i)) for i in range(30)], "g string, v double")
    for per_range in (None, 3):
        got = ordering.running_totals(df, ["g"], "v", {"n": F.lit(1)}, per_range).collect()
        assert sorted((r["g"] or "", r["v"], r["n_cum"], r["n_all"]) for r in got) == sorted(
            [("a", float(i), i + 1, 20) for i in range(20)] + [("", float(i), i - 19, 10) for i in range(20, 30)])


def test_trailing_without_a_key_on_both_paths(spark):
    from riskframe.operators.generate import add_trailing

    df = spark.createDataFrame([(None if i < 12 else 1, i, 1.0) for i in range(20)], "k int, t int, x double")
    want = sorted([(i, float(min(i + 1, 4))) for i in range(12)] + [(i, float(min(i - 11, 4))) for i in range(12, 20)])
    for per_range in (None, 3):
        got = add_trailing(df, "k", "t", ["x"], 3, per_range=per_range)
        assert sorted((r["t"], r["x_sum_last_3"]) for r in got.collect()) == want
