import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from riskframe.llm import oracles, queries, recompression
from tests.llm.helpers import DOCS, awkward, clashing

LAST = 2**63 - 1


def plain(rows, window):
    docs = [(LAST if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for place, _, w in docs:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            least[key] = min(least.get(key, place), place)
    out = []
    for place, i, w in docs:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < place:
                gone[k:k + window] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n, window):
    """Texts of few or many different words that share passages, also plain ones, with copies, repeated rows and rows without id or text."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range([2, 5, 400][seed % 3])]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(window - 3, 4 * window))] for _ in range(4)] + [["a"] * (2 * window), ["a", "b"] * window]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice(vocab) if rng.random() < 0.8 else f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                words += p[rng.randint(0, 10):len(p) - rng.randint(0, 10)]
        rows.append((i if rng.random() > 0.05 else None, " ".join(words)))
    rows += [(k + n, t) for k, (_, t) in enumerate(rows[:10])] + rows[:5] + [(900, None), (901, ""), (902, " \n ")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window", [50, 8, 20])
@pytest.mark.parametrize("seed", range(6))
def test_no_repeated_window_is_cut_by_a_symbol_of_one_document(seed, window):
    docs = [(LAST if i is None else i, (t or "").encode().split()) for i, t in made(seed, 30, window)]
    of, name, place = recompression.marks([w for _, w in docs], window)
    owner = {}
    for k, n in zip(of.tolist(), name.tolist(), strict=True):
        owner.setdefault(n, set()).add(docs[k][0])
    alive = np.array([n == 0 or len(owner[n]) > 1 for n in name.tolist()])
    at = {}
    for d, w in docs:
        for q in range(len(w) - window + 1):
            at.setdefault(tuple(w[q:q + window]), set()).add(d)
    for k, (_, w) in enumerate(docs):
        candidate = set()
        for a, b in recompression.stretches(place[(of == k) & alive], window):
            assert 0 <= a < b <= len(w) - window + 1
            assert candidate.isdisjoint(range(a, b))
            candidate.update(range(a, b))
        assert {q for q in range(len(w) - window + 1) if len(at[tuple(w[q:q + window])]) > 1} <= candidate


def test_most_windows_that_do_not_repeat_are_cut():
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(100)]
    docs = [[f"w{rng.randrange(3000)}".encode() for _ in range(400)] + [x.encode() for x in passage] + [f"w{rng.randrange(3000)}".encode() for _ in range(400)] for _ in range(20)]
    of, name, place = recompression.marks(docs, 50)
    owner = {}
    for k, n in zip(of.tolist(), name.tolist(), strict=True):
        owner.setdefault(n, set()).add(k)
    alive = np.array([len(owner[n]) > 1 for n in name.tolist()])
    found = [recompression.stretches(place[(of == k) & alive], 50) for k in range(20)]
    assert all(any(a <= 400 and b >= 451 for a, b in x) for x in found)
    total = sum(b - a for x in found for a, b in x)
    assert 51 * 20 <= total < 0.15 * 20 * 851  # the passage's windows, ragged edges, and the few without a symbol of their own


@pytest.mark.parametrize("common", [False, True])
def test_removed(spark, tmp_path, monkeypatch, common):
    if common:  # every symbol and window that the sample, here all documents, holds twice is common
        for name, value in (("SAMPLE", 1), ("HOT_SHARE", 10**9), ("COMMON", 1)):
            monkeypatch.setattr(recompression, name, value)
    rows = made(2, 40, 50) + awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS), "doc", "h", "places", "z", "ranges", "n_words").repartition(4)
    out = recompression.removed(docs).collect()
    assert sorted((tuple(r)[:4] for r in out), key=repr) == plain(rows, 50)
    assert all(sum(b - a for a, b in r.ranges) == r.n_removed for r in out)
    if common:
        return
    docs.select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op12_recompression_cut(spark, str(tmp_path)).collect()), key=repr) == plain(rows, 50)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(oracles.repeated_windows()).fetchall(), key=repr) == plain(rows, 50)
    assert recompression.removed(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        recompression.removed(docs, window=1000)


def test_texts_that_share_nothing_are_not_carried_on(spark, monkeypatch):
    carried, real = [], recompression.checkpointed

    def noted(df):
        out = real(df)
        if {"z", "doc_id"} <= set(out.columns):
            carried.extend((r.doc_id, r.z is not None) for r in out.select("doc_id", "z").collect())
        return out

    monkeypatch.setattr(recompression, "checkpointed", noted)
    rng = random.Random(31)
    long = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(6)]
    passage = " ".join(f"p{k}" for k in range(30))  # shared symbols, but no window of 50 words
    rows = [(k, t) for k, t in enumerate(long[:4])] + [(4, f"{long[4]} {passage}"), (5, f"{passage} {long[5]}"), (6, f"start {long[0]}"), (7, "short"), (8, None)]
    for given in (rows, rows[1:6], rows[7:]):
        carried.clear()
        out = recompression.removed(spark.createDataFrame(given, DOCS).repartition(3)).collect()
        assert sorted((tuple(r)[:4] for r in out), key=repr) == plain(given, 50)
        assert sorted(k for k, z in carried if z) == ([0, 6] if given is rows else [])


def test_windows_of_many_stretches_make_a_batch():
    rng = random.Random(31)
    texts = [[f"w{rng.randrange(50)}" for _ in range(rng.randint(50, 90))] for _ in range(300)] + [[f"w{k}" for k in range(70_000)]]
    packed = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array(range(301)), pa.array(range(301)), pa.array(
        [zstandard.compress(" ".join(x).encode()) for x in texts], pa.binary())], names=["doc", "h", "s1", "z"])
    out = list(recompression._windows_of([packed], 50))
    assert len(out) <= 4 and max(b.num_rows for b in out) < 65_536
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    halves = [np.frombuffer(xxhash.xxh3_128_digest(" ".join(x[k:k + 50]).encode()), np.int64).tolist() for x in texts for k in range(len(x) - 49)]
    assert got == [(*h, d, d, d, k) for h, (d, k) in zip(halves, ((d, k) for d, x in enumerate(texts) for k in range(len(x) - 49)), strict=True)]
