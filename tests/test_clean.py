import pytest
from pyspark.sql import functions as F

from riskframe.operators import clean, profile
from riskframe.plans import etl
from tests.conftest import rows

RAW = [("a1", "34", "F", "10", "0", "\\N", "1"), ("a2", "51", "M", "None", "0", "\\N", "1"),
       ("a3", "28", "F", "7", "0", "3", "1"), ("a4", "45", "M", "12", "1", "", "0"),
       ("a5", "nan", "F", "3", "0", "NaN", "0"), ("a6", "60", "M", "9", "0", "2", "0"),
       ("a7", "22", "F", "15", "2", "5", "0"), ("a8", "39", "M", "1", "3", "6", "0")]
COLS = ["msisdn", "AGE", "SEX", "voice_cnt", "zero_col", "sparse_col", "label"]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, ", ".join(f"{c} string" for c in COLS))


def test_whole_flow_on_the_eight_row_table(raw):
    out = etl.clean_subscribers([raw.where("label = '0'"), raw.where("label = '1'")], "msisdn", text=["性别"])
    assert out.dropped_missing == ["sparse_col"]
    assert out.dropped_zero == ["zero_col"]
    assert out.rows.columns == ["msisdn", "年龄", "性别", "voice_cnt", "label"]
    assert [r["msisdn"] for r in out.rows.orderBy("msisdn").collect()] == ["a1", "a3", "a4", "a6", "a7", "a8"]
    sample = etl.ratio_samples(out.rows, "msisdn", ratios=[1])["data_ratio_1_1"].collect()
    keys = {r["msisdn"] for r in sample}
    assert {"a1", "a3"} <= keys and len(keys) == 4
    assert sum(r["label"] for r in sample) == 2
    with pytest.raises(ValueError):
        etl.ratio_samples(out.rows, "msisdn", ratios=[3])


def test_tokens_become_null_in_text_and_numbers(spark):
    df = spark.createDataFrame([("\\N", float("nan")), ("\\n", 1.0), ("None", None), ("", 2.0), ("x", 3.0)], "a string, b double")
    got = clean.null_tokens(df)
    assert [tuple(r) for r in got.collect()] == [(None, None), (None, 1.0), (None, None), (None, 2.0), ("x", 3.0)]
    assert clean.any_left(df).first()["any_token"] and clean.any_left(got).first() == (False, True)


def test_casting_bad_text_gives_null(spark):
    df = spark.createDataFrame([("k", "12.5", "abc", "1"), ("l", "oops", "7", "x")], "id string, a string, b string, label string")
    got = clean.cast_columns(df, ["b"], "label", keep=["id"])
    assert dict(got.dtypes) == {"id": "string", "a": "double", "b": "string", "label": "int"}
    assert [tuple(r) for r in got.collect()] == [("k", 12.5, "abc", 1), ("l", None, "7", None)]


def test_rename_ignores_unknown_names_and_drop_too(raw):
    assert clean.rename_columns(raw, {"AGE": "age", "zzz": "y"}).columns[1] == "age"
    assert clean.drop_columns(raw, ["AGE", "zzz"]).columns == [c for c in COLS if c != "AGE"]


def test_rates_treat_null_as_missing_not_zero(spark):
    df = spark.createDataFrame([(0.0, "0"), (None, "1"), (2.0, None), (0.0, "0")], "a double, b string")
    assert rows(clean.column_rates(df)) == [("a", 0.25, 0.5), ("b", 0.25, 0.5)]
    kept, gone = clean.prune_zero(df, 0.3, keep=["b"])
    assert gone == ["a"] and kept.columns == ["b"]


def test_detect_categorical(spark):
    df = spark.createDataFrame([(i, i % 10, i % 11, str(i), i % 2 == 0) for i in range(400)],
                               "many int, ten int, eleven int, text string, flag boolean")
    got = {r["feature"]: (r["n_distinct"], r["is_categorical"]) for r in clean.detect_categorical(df, df.columns).collect()}
    assert got == {"many": (None, False), "ten": (10, True), "eleven": (None, False), "text": (None, True), "flag": (2, True)}
    assert clean.split_by_type(df, df.columns) == (["many", "ten", "eleven"], ["text", "flag"])


def test_validation(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "x int, label int")
    assert profile.validate_dataset(df, ["x"], "label").where("passed").count() == 4
    with pytest.raises(ValueError, match="missing columns"):
        profile.validate_dataset(df, ["y"], "label")
    with pytest.raises(ValueError, match="target"):
        profile.validate_dataset(df, ["x"], "target")
    with pytest.raises(ValueError, match="empty"):
        profile.validate_dataset(df.where("false"), ["x"], "label")
    with pytest.raises(ValueError, match="two classes"):
        profile.validate_dataset(df.where("label = 1"), ["x"], "label")
    assert profile.validate_dataset(df.where("label = 1"), ["x"], "label", "regression").count() == 4


def test_scoring_input(spark):
    df = spark.createDataFrame([(1, 0)], "x int, label int")
    profile.check_input(df, ["x"])
    with pytest.raises(ValueError, match="missing columns"):
        profile.check_input(df, ["z"])
    with pytest.raises(ValueError, match="empty"):
        profile.check_input(df.where("false"), ["x"])


def test_union_matches_columns_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2)], "s string, i int")
    assert rows(clean.concat_tables(a, b)) == [(1, "x"), (2, "y")]
    assert clean.filter_label(clean.concat_tables(a, b), "i", 2).select(F.col("s")).first()[0] == "y"
