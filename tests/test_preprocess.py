import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskframe.operators import generate, preprocess
from riskframe.operators.preprocess import TabularPreprocessor, TabularPreprocessorModel
from tests.conftest import rows

TRAIN = [(1.0, 5.0, "b"), (2.0, 5.0, "a"), (float("nan"), 5.0, None), (4.0, 5.0, "a"), (None, 5.0, "b")]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, "x double, flat double, c string")


def fit(train, **kw):
    return TabularPreprocessor(numericCols=["x", "flat"], categoricalCols=["c"], **kw).fit(train)


def test_linear_family(spark, train):
    model = fit(train, family="LR")
    out = model.transform(train)
    assert out.columns == ["x", "flat", "c_a", "c_b"]
    filled = [1.0, 2.0, 2.0, 4.0, 2.0]
    mean = sum(filled) / 5
    std = math.sqrt(sum((v - mean) ** 2 for v in filled) / 5)
    for r, v in zip(out.collect(), filled):
        assert r["x"] == pytest.approx((v - mean) / std) and r["flat"] == 0.0
    # a tie between categories is filled with the smaller one; unseen values give zeros
    assert [(r["c_a"], r["c_b"]) for r in out.collect()] == [(0, 1), (1, 0), (1, 0), (1, 0), (0, 1)]
    new = model.transform(spark.createDataFrame([(None, None, "z")], "x double, flat double, c string")).first()
    assert (new["c_a"], new["c_b"]) == (0, 0)
    assert model.outputs() == {"x": "x", "flat": "flat", "c_a": "c", "c_b": "c"}


def test_forest_and_other_families(spark, train):
    forest = fit(train, family="RF").transform(train).collect()
    assert [(r["x"], r["c"]) for r in forest] == [(1.0, 1), (2.0, 0), (2.0, 2), (4.0, 0), (2.0, 1)]
    unseen = spark.createDataFrame([(3.0, 5.0, "z")], "x double, flat double, c string")
    assert fit(train, family="RF").transform(unseen).first()["c"] == -1
    assert fit(train, family="KNN").transform(train).collect()[2]["c"] == 0
    boost = fit(train, family="XGB_REG").transform(unseen)
    assert boost.first()["c"] == 3.0 and boost.schema["c"].metadata["ml_attr"]["type"] == "nominal"


def test_long_dictionaries_give_the_same_codes(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "c string")
    model = TabularPreprocessor(categoricalCols=["c"], family="RF").fit(df)
    probe = spark.createDataFrame([("k000",), ("k049",), ("k0005",), ("zz",), (None,)], "c string")
    assert [r["c"] for r in model.transform(probe).collect()] == [0, 49, -1, -1, -1]
    table = preprocess.ordinal_table(df, "c")
    got = preprocess.encode_by_table(probe, "c", table, "code")
    assert {r["c"]: r["code"] for r in got.collect()} == {"k000": 0, "k049": 49, "k0005": -1, "zz": -1, None: -1}


def test_scales_and_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(1000.0,)], "x double")
    low = TabularPreprocessor(numericCols=["x"], scale="none", outliers="iqr").fit(df).transform(df)
    q1, q3 = 2.75, 8.25
    assert low.agg(F.max("x")).first()[0] == pytest.approx(q3 + 1.5 * (q3 - q1))
    minmax = TabularPreprocessor(numericCols=["x"], scale="minmax").fit(df).transform(df)
    assert minmax.agg(F.min("x"), F.max("x")).first() == (0.0, 1.0)
    robust = TabularPreprocessor(numericCols=["x"], scale="robust").fit(df).transform(df).collect()
    assert robust[0]["x"] == pytest.approx((0 - 5.5) / (q3 - q1))


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, c string")
    for family in ("LR", "RF"):
        model = TabularPreprocessor(numericCols=["x"], categoricalCols=["c"], family=family).fit(df)
        assert model.transform(df).first()["x"] is None
    assert preprocess.modes(df, ["c"]) == {"c": None}


def test_too_many_categories_is_refused(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="ordinal_table"):
        preprocess.bounded_counts(df, ["c"], limit=100)


def test_sparse_vectors_for_many_values(spark):
    train = spark.range(20_000).select(F.concat(F.lit("c"), "id").alias("c"))
    df = spark.createDataFrame([("c0",), ("c19999",), ("new",), (None,)], "c string")
    got = {r["c"]: r["v"] for r in preprocess.sparse_onehot(df, "c", preprocess.ordinal_table(train, "c"), "v").collect()}
    order = sorted(f"c{i}" for i in range(20_000))
    assert {v.size for v in got.values()} == {20_000}
    assert got["c0"].indices.tolist() == [order.index("c0")] and got["c19999"].indices.tolist() == [order.index("c19999")]
    assert not len(got["new"].indices) and not len(got[None].indices)


def test_saved_inside_a_model(spark, train, tmp_path):
    model = PipelineModel([fit(train, family="LR"), VectorAssembler(inputCols=["x", "c_a"], outputCol="v")])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert rows(again.transform(train).select("x", "c_b")) == rows(model.transform(train).select("x", "c_b"))
    with pytest.raises(ValueError, match="fitted"):
        TabularPreprocessorModel().transform(train)


def test_target_encoding_never_uses_the_own_fold(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("b", 0, 1), ("b", 1, 1), ("c", 0, 0)], "v string, fold int, y int")
    got = {(r["v"], r["fold"]): r["v_te"] for r in preprocess.target_encode(df, "v", "y", "fold", 1.0).collect()}
    prior0, prior1 = 1 / 2, 2 / 3
    assert got["a", 0] == pytest.approx((0 + prior0) / 2) and got["a", 1] == pytest.approx((1 + prior1) / 2)
    assert got["c", 0] == pytest.approx(prior0)


def test_polynomial_names_and_order(spark):
    df = spark.createDataFrame([(2, 3.0, "t")], "a int, b double, c string")
    out = generate.add_polynomial(df, degree=3, bias=True)
    assert out.columns == ["a", "b", "c", "1", "a^2", "a b", "b^2", "a^3", "a^2 b", "a b^2", "b^3"]
    assert tuple(out.first())[3:] == (1.0, 4.0, 6.0, 9.0, 8.0, 12.0, 18.0, 27.0)
    wide, summary = generate.generate(df, interaction=True, pairs=[("a", "b"), ("a", "c")])
    assert wide.columns[-1] == "a_x_b" and rows(summary) == [("a_x_b", "interaction")]
    with pytest.raises(ValueError, match="new columns"):
        generate.add_interactions(spark.createDataFrame([tuple(range(102))], ", ".join(f"c{i} int" for i in range(102))), most=5000)


@pytest.mark.parametrize("per_range", [None, 3])
def test_trailing_windows_across_ranges(spark, monkeypatch, per_range):
    if per_range:
        monkeypatch.setattr("riskframe.operators.ordering.ROWS_PER_RANGE", per_range)
    data = [(i, "hot" if i % 3 else f"k{i % 7}", (i * 37) % 50, float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "id int, k string, t int, v double").repartition(3)
    got = {r["id"]: r["v_sum_last_3"] for r in generate.add_trailing(df, "k", "t", ["v"], 3, ["id"]).collect()}
    want = {}
    for key in {d[1] for d in data}:
        line = sorted((t, i, v) for i, k, t, v in data if k == key)
        for n, (_, i, _) in enumerate(line):
            want[i] = sum(v for _, _, v in line[max(0, n - 3):n + 1])
    assert got == want
