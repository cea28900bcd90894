import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from riskframe.llm import common, queries, simhash
from tests.llm.helpers import DOCS, awkward, clashing, grouped, sentence


def plain_print(text, n, seed=42):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k:k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, seed) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints(spark):
    rows = awkward()
    got = {(r.doc_id, r.f0 & (2**64 - 1), r.f1 & (2**64 - 1)) for r in simhash.fingerprints(spark.createDataFrame(rows, DOCS), 4, 2).collect()}
    assert got == {(i, plain_print(t, 4), plain_print(t, 4, 43)) for i, t in rows}
    # the hash is the engine's own XXH64
    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("a b c d", 42)


@pytest.mark.parametrize("radius, words", [(4, 1), (26, 2)])
@pytest.mark.parametrize("short", [2, 48])
def test_close_rows_connect_all_that_is_close(monkeypatch, radius, words, short):
    monkeypatch.setattr(simhash, "SHORT", short)
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 2**64, (6, words), np.uint64)
    f = centre[rng.integers(0, 6, 120)] ^ (np.uint64(1) << rng.integers(0, 64, (120, words)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (120, words)).astype(np.uint64))
    key = np.sort(rng.integers(0, 3, 120))
    i, j = simhash.close_rows(key, f, radius)
    lab = common.local_components(120, i, j)
    want = grouped(120, lambda a, b: key[a] == key[b] and np.bitwise_count(f[a] ^ f[b]).sum() <= radius)
    assert lab.tolist() == want


@pytest.mark.parametrize("bucket_rows", [3, 4096])
def test_hamming_links_lose_nothing(spark, bucket_rows):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(8)})
    df = spark.createDataFrame([(k, int(np.uint64(p).view(np.int64)), 0) for k, p in enumerate(prints)], "id long, f0 long, f1 long")
    root = {r.node: r.root for r in simhash.linked(df, 4, 6, 1, bucket_rows).collect()}
    names = range(len(prints))
    want = grouped(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = [root.get(n, n) for n in names]
    for a in range(len(prints)):
        for b in range(a):
            assert (got[a] == got[b]) == (want[a] == want[b])


def test_groups(spark, tmp_path):
    rows = awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS), "fingerprint", "component_id", "f0").repartition(5)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(docs).collect()), key=repr)
    prints = [plain_print(t, 4) for _, t in rows]
    root = grouped(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, root, strict=True)), key=repr)
    assert got == want
    assert simhash.groups(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        simhash.groups(docs, radius=5, blocks=6)
    docs.drop("fingerprint", "component_id", "f0").write.parquet(f"{tmp_path}/documents.parquet")
    again = queries.op4_simhash_groups(spark, str(tmp_path))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in again.collect()), key=repr) == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 500)] + [(700, k) for k in range(701, 790)] + [(5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {k: k for e in edges for k in e}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        up[find(a)] = find(b)
    linked = {k for a, b in edges if a != b for k in (a, b)}
    assert set(got) == linked
    pairs = {(find(k), got[k]) for k in linked}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_lookup_with_hot_keys(spark):
    left = spark.createDataFrame([(k % 3 if k < 90 else None, k) for k in range(100)], "key int, n int")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "key int, v string")
    want = sorted(((r.key, r.n, r.v) for r in left.join(right, "key", "left").collect()), key=repr)
    hot = spark.createDataFrame([(0,), (2,)], "key int")  # one of them is not in the table
    assert sorted(((r.key, r.n, r.v) for r in common.lookup(left, right, "key", hot).collect()), key=repr) == want


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    x, y = sets
    return 1.0 if not x | y else len(x & y) / len(x | y)


def test_one_of_each(spark, monkeypatch):
    rng = random.Random(12)
    rows = awkward()
    for k in range(8):  # groups of near copies, some of them beyond the similarity
        words = sentence(rng, 150).split()
        for c in range(6):
            copy = list(words)
            for _ in range(c):
                copy[rng.randrange(150)] = f"new{rng.randrange(99)}"
            rows.append((1000 + 10 * k + c, " ".join(copy)))
    docs = clashing(spark.createDataFrame(rows, DOCS), "t", "coarse", "print").repartition(4)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(ids) == len(set(ids))
    text = [t or "" for _, t in rows]
    near = {}

    def linked(a, b):
        near[a, b] = text[a] == text[b] or jaccard(text[a], text[b]) >= 0.8
        return near[a, b]

    root = grouped(len(rows), linked)
    members = {}
    for k, r in enumerate(root):
        members.setdefault(r, []).append(rows[k])
    survivors = {r: [x for x in set(m) if x in ids] for r, m in members.items()}
    # white and empty texts have no shingles and one fingerprint: the empty set is like itself
    for r, m in members.items():
        assert len(survivors[r]) <= 1 or not any((t or "").strip() for _, t in m), m
    # a document only goes if a linked one stays, by the least id
    for r, m in members.items():
        if any((t or "").strip() for _, t in m):
            named = [i for i, _ in m if i is not None]
            assert len(survivors[r]) == 1 and (not named or survivors[r][0][0] == min(named)), (m, survivors[r])
    monkeypatch.setattr(simhash, "CELL", 4)  # groups in several cells
    assert sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=repr) == sorted(ids, key=repr)
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def survivors(rows):
    """Ids of the least members of the groups that links of Jaccard 0.8 reach, by brute force."""
    words = [set(t.split()) for _, t in rows]  # texts without a common word are not compared
    root = grouped(len(rows), lambda a, b: not words[a].isdisjoint(words[b]) and jaccard(rows[a][1], rows[b][1]) >= 0.8)
    return sorted({rows[r][0] for r in root})


def test_one_of_each_with_repeated_lines(spark):
    rng, rows = random.Random(21), []
    for k in range(30):  # a line stands once in one copy and several times in the other
        body, line = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(n)) for c, n in (("b", 200), ("l", 20)))
        rows += [(10 * k, f"{body} {line}"), (10 * k + 1, " ".join([body] + [line] * rng.choice([5, 10, 30])))]
    got = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS).repartition(3)).collect())
    assert got == survivors(rows) == [10 * k for k in range(30)]


def test_one_of_each_at_the_similarity(spark):
    rng, rows = random.Random(22), []
    for k in range(240):  # pairs at 0.80 to 0.85, some of them short
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([24, 60, 300, 700]))]
        want, copy = rng.uniform(0.8, 0.85), words
        while jaccard(" ".join(words), " ".join(longer := [*copy, f"w{rng.randrange(10**6)}"])) >= want:
            copy = longer
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(copy))]
    got = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS).repartition(3)).collect())
    assert got == survivors(rows) == [10 * k for k in range(240)]


def test_bands_are_shared_by_similarity():
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(200):
        x = rng.integers(0, 2**64, 1000, np.uint64)
        agree.append((simhash.bands(x[:900]) == simhash.bands(x[100:])).mean())  # Jaccard 0.8
    assert np.mean(agree) == pytest.approx(0.8 ** simhash.ROWS, abs=0.02) and min(agree) > 0
    none = np.empty(0, np.uint64)
    assert (simhash.bands(none) == simhash.bands(none)).all() and len(set(simhash.bands(none).tolist())) == simhash.BANDS


def test_one_of_each_along_a_chain(spark):
    words = [f"w{k}" for k in range(8 * 2000 + 100)]  # only neighbours reach the similarity
    rows = [(k, " ".join(words[8 * k:8 * k + 100])) for k in range(2000)]
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8 > jaccard(rows[0][1], rows[2][1])
    kept = simhash.one_of_each(spark.createDataFrame([*rows, (5000, "quite another text")], DOCS).repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5000]


def test_wide_prints_differ_by_the_angle():
    rng, apart = np.random.default_rng(5), []
    for _ in range(200):
        x = rng.integers(0, 2**64, 600, np.uint64)
        a, b = simhash.wide_print(x[:540]), simhash.wide_print(x[60:])  # Jaccard 0.8
        assert int(a[0]) == simhash.simhash(x[:540])
        apart.append(int(np.bitwise_count(a ^ b).sum()))
    assert np.mean(apart) / 256 == pytest.approx(np.arccos(0.8 * 2 / 1.8) / np.pi, abs=0.01) and max(apart) <= 76
    assert simhash.wide_print(np.empty(0, np.uint64)).tolist() == [0] * simhash.WIDE


def test_candidates_of_near_copies_come_from_their_fingerprints(spark):
    rng = np.random.default_rng(6)
    f = rng.integers(0, 2**64, (300, 4), np.uint64)
    flip = np.packbits(rng.random((300, 256)) < 0.15, axis=1).view(np.uint64)  # as at a Jaccard of 0.8
    rows = [(k, None, *x) for k, x in enumerate(np.concatenate([f, f ^ flip]).view(np.int64).tolist())]
    prints = spark.createDataFrame(rows, "id long, node long, f0 long, f1 long, f2 long, f3 long")
    tables = simhash.sampled_bits(len(rows))
    assert len(tables) == 64 and all(m.bit_count() == 8 for _, m in tables)
    assert len(big := simhash.sampled_bits(10**7)) == 112 and all(m.bit_count() == 11 for _, m in big)
    for bucket_rows in (3, 4096):  # also with buckets that are split
        found = {}
        for r in simhash.near_clusters(prints, simhash.table_keys(tables), 76, 44, bucket_rows).collect():
            found.setdefault(r.cluster, set()).add(r.id)
        assert sorted(map(sorted, found.values())) == [[k, k + 300] for k in range(300)]


def test_candidates_of_a_large_group_are_told_once(spark):
    rng = np.random.default_rng(8)
    flips = lambda share: np.packbits(rng.random(256) < share).view(np.uint64)
    f = rng.integers(0, 2**64, 4, np.uint64)
    rows = [(k, 0 if k < 300 else None, *(f ^ flips(0.02 if k < 300 else 0.15)).view(np.int64).tolist()) for k in range(304)]  # a group, and four near it
    prints = spark.createDataFrame(rows, "id long, node long, f0 long, f1 long, f2 long, f3 long")
    keys = simhash.table_keys(simhash.sampled_bits(len(rows)))
    for bucket_rows in (100, 4096):
        found = [(r.cluster, r.id) for r in simhash.near_clusters(prints, keys, 76, 44, bucket_rows).collect()]
        assert sorted(i for _, i in found) == list(range(304)) and len({c for c, _ in found}) == 1  # once, not once a table
