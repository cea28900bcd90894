import zlib
from collections import Counter

import numpy as np
import pytest

from riskframe.llm import queries, sharding
from tests.llm.helpers import DOCS, awkward, clashing


def test_matrix_rows_add_up():
    sizes, room = np.array([7, 0, 12, 1, 30]), np.array([10, 10, 15, 15])
    rows = np.array([sharding.matrix_row(3, sizes, room, p) for p in range(len(sizes))])
    assert rows.sum(axis=1).tolist() == sizes.tolist() and rows.sum(axis=0).tolist() == room.tolist()
    assert (rows >= 0).all()


def test_matrix_law():
    """The share of a partition's rows that go to a destination has the hypergeometric mean and variance."""
    sizes, room = np.array([20, 30, 50]), np.array([25, 75])
    got = np.array([sharding.matrix_row(s, sizes, room, 1)[0] for s in range(3000)])
    mean, var = 30 * 0.25, 30 * 0.25 * 0.75 * 70 / 99
    assert abs(got.mean() - mean) < 0.15 and abs(got.var() / var - 1) < 0.1


def test_large_populations(monkeypatch):
    monkeypatch.setattr(sharding, "LIBRARY_MOST", 10)
    rng = np.random.default_rng(1)
    got = np.array([sharding.hypergeometric(rng, 40, 60, 30) for _ in range(4000)])
    assert abs(got.mean() - 12) < 0.2 and abs(got.var() / (30 * 0.24 * 70 / 99) - 1) < 0.1
    assert abs(sharding.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**9) / 10**9 - 0.3) < 1e-3
    drawn = sharding.draw(rng, np.array([5, 0, 9, 6]), 20)
    assert drawn.tolist() == [5, 0, 9, 6]
    assert sharding.draw(rng, np.array([50, 0, 90, 60]), 33).sum() == 33


@pytest.mark.parametrize("block", [5, 16_384])
def test_shuffle(spark, block):
    rows = awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS), "shard", "slot", "row").repartition(4)
    got = sharding.shuffle(docs, shards=5, block_rows=block).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    assert sharding.shuffle(docs.limit(0)).collect() == []
    assert sum(1 for _ in sharding.shuffle(docs.limit(2), shards=8).collect()) == 2


def test_shuffle_is_uniform(spark):
    """Where the first rows of the input come out, over many seeds."""
    docs = spark.range(24, numPartitions=3)
    places = Counter()
    for seed in range(40):
        for r in sharding.shuffle(docs, shards=4, seed=seed, block_rows=3, stable=True).collect():
            if r.row.id < 6:
                places[r.shard] += 1
    assert all(abs(places[k] - 60) < 30 for k in range(4))


def test_op5_contract(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is not None]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_uniform_shards(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
