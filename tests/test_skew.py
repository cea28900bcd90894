from riskframe.functions.skew import hot_keys, lookup


def test_lookup_finds_what_a_plain_left_join_finds(spark):
    left = spark.createDataFrame([(k % 3 if k < 90 else None, k) for k in range(100)], "key int, n int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "key int, v string")
    want = sorted((tuple(r) for r in left.join(right, "key", "left").select("key", "n", "v").collect()), key=repr)
    for hot in ([], [0], [2], [0, 1, 2, 7]):  # hot keys may be absent from the table
        found = lookup(left, right, "key", spark.createDataFrame([(k,) for k in hot], "key int") if hot else None)
        assert sorted((tuple(r) for r in found.select("key", "n", "v").collect()), key=repr) == want


def test_hot_keys(spark):
    counts = spark.createDataFrame([(1, 10), (2, 5000)], "key int, n long")
    assert [r.key for r in hot_keys(counts, "key", counts.n > 100).collect()] == [2]
    assert hot_keys(counts, "key", counts.n > 10**6) is None
