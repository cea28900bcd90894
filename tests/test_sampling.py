import hashlib
from collections import Counter

import pytest

from riskframe.operators import sampling
from riskframe.operators.models import class_weights

N, POS = 3000, 137


def digest(key, seed=42):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, int(i < POS)) for i in range(N)], "id long, label int").repartition(7).cache()


def ids(df):
    return {r["id"] for r in df.collect()}


def smallest(keys, n, seed=42):
    return set(sorted(keys, key=lambda k: digest(k, seed))[:n])


def test_plain_split_takes_the_smallest_hashes(table):
    train, test = sampling.train_test(table, ["id"], 0.3)
    assert ids(test) == smallest(range(N), 900) and ids(train) == set(range(N)) - ids(test)


def test_stratified_split_rounds_half_up(table):
    _, test = sampling.train_test(table, ["id"], 0.25, label="label")
    want = smallest(range(POS), 34) | smallest(range(POS, N), 716)
    assert ids(test) == want


def test_third_round_ranks_rows_with_a_common_prefix(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PREFIX", 1)  # short prefixes leave many rows for the last round
    df = spark.range(2000)
    cut = sampling.hash_cutoffs(df, ["id"], 7, {None: 333})
    assert ids(df.where(sampling.chosen(["id"], 7, cut))) == smallest(range(2000), 333, 7)


def test_folds(table):
    folds = {r["id"]: r["fold"] for r in sampling.with_folds(table, ["id"], 5).collect()}
    order = sorted(range(N), key=digest)
    assert folds == {k: i // (N // 5) for i, k in enumerate(order)}
    uneven = {r["id"]: r["fold"] for r in sampling.with_folds(table.where("id < 13"), ["id"], 5).collect()}
    assert [uneven[k] for k in sorted(range(13), key=digest)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    strat = sampling.with_folds(table, ["id"], 5, label="label").collect()
    per_class = Counter((r["label"], r["fold"]) for r in strat)
    for c, n in ((1, POS), (0, N - POS)):
        assert {per_class[c, f] for f in range(5)} <= {n // 5, n // 5 + 1}
    with pytest.raises(ValueError):
        sampling.with_folds(table.where("id < 3 or id > 200"), ["id"], 5, label="label")


def test_ratio_and_fixed_samples(table):
    assert Counter(r["label"] for r in sampling.ratio_sample(table, ["id"], "label", 3).collect()) == {1: POS, 0: 3 * POS}
    got = ids(sampling.fixed_sample(table, ["id"], "label", 100))
    assert got == set(range(POS)) | smallest(range(POS, N), 100)
    with pytest.raises(ValueError):
        sampling.ratio_sample(table, ["id"], "label", 1000)


def test_over_and_under_sampling(table):
    over = sampling.over_sample(table, ["id"], "label").collect()
    assert Counter(r["label"] for r in over) == {0: N - POS, 1: N - POS}
    copies = Counter(r["id"] for r in over if r["label"] == 1)
    assert set(copies.values()) == {(N - POS) // POS, (N - POS) // POS + 1}
    assert len({(r["id"], r["copy"]) for r in over}) == len(over)
    under = sampling.under_sample(table, ["id"], "label").collect()
    assert Counter(r["label"] for r in under) == {0: POS, 1: POS}


def test_validation_split_and_errors(table, spark):
    marked = sampling.with_validation(table, ["id"], "label", 0.1)
    assert Counter((r["label"], r["is_validation"]) for r in marked.collect())[1, True] == 14
    with pytest.raises(ValueError):
        sampling.train_test(table, ["id"], 1.0)
    with pytest.raises(ValueError):
        sampling.train_test(spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, label int"), ["id"], 0.5, label="label")


def test_hash_sample_is_repeatable(table):
    a, b = ids(sampling.hash_sample(table, ["id"], 50)), ids(sampling.hash_sample(table.repartition(3), ["id"], 50))
    assert a == b and len(a) == 50
    assert sampling.hash_sample(table, ["id"], 10 * N).count() == N


def test_split_needs_no_shuffle_of_the_table(table):
    plan = sampling.train_test(table, ["id"], 0.3)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_folds_need_no_shuffle(table):
    plan = sampling.with_folds(table, ["id"], 5, label="label")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange hash" not in plan


def test_rows_without_a_label_are_never_lost(spark):
    df = spark.createDataFrame([(i, None if i % 8 == 0 else i % 2) for i in range(400)], "id int, label int")
    train, test = sampling.train_test(df, ["id"], 0.3, label="label")
    assert (train.count(), test.count()) == (280, 120)
    assert test.where("label is null").count() == 15
    folds = sampling.with_folds(df, ["id"], 5, label="label")
    assert folds.where("fold is null").count() == 0 and folds.where("label is null").groupBy("fold").count().count() == 5
    assert sampling.with_validation(df, ["id"], "label").where("is_validation is null").count() == 0
    assert sampling.over_sample(df, ["id"], "label").where("label is null").count() == 50
    assert sampling.under_sample(df, ["id"], "label").where("label is null").count() == 50
    with pytest.raises(ValueError, match="50 rows"):
        sampling.fixed_sample(df, ["id"], "label", 10)


def test_many_classes(spark):
    df = spark.range(4000).selectExpr("id", "cast(id % 500 as string) as label")
    train, test = sampling.train_test(df, ["id"], 0.25, label="label")
    assert test.groupBy("label").count().where("count = 2").count() == 500


def test_all_ratios_at_once(table):
    got = Counter((r["k"], r["label"]) for r in sampling.ratio_samples(table, ["id"], "label", (1, 5)).collect())
    assert got == {(1, 1): POS, (1, 0): POS, (5, 1): POS, (5, 0): 5 * POS}


def test_class_weights(table):
    got = {r["label"]: r["weight"] for r in class_weights(table, "label").collect()}
    assert got[1] == pytest.approx(N / (2 * POS)) and got[0] == pytest.approx(N / (2 * (N - POS)))
