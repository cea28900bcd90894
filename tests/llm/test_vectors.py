import numpy as np
import pytest

from riskframe.llm import itq, permutation_index, queries
from tests.llm.helpers import VECTORS, clashing, grouped

BAD = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [float("nan")]), (903, [1.0] * 7 + [None]), (904, [float("inf")] * 8), (905, []), (906, [1.0, 2.0])]


def points(n=300, width=8, seed=1, copies=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    if copies:  # equal ones, scaled ones, and near ones
        rows += [(n + k, rows[5][1]) for k in range(30)] + [(n + 40, (x[6] * 3).tolist())]
        rows += [(n + 50 + k, (x[7] / np.linalg.norm(x[7]) + rng.normal(size=width) * 0.04).tolist()) for k in range(40)]
    return rows


def unit(rows):
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("block, query_block", [(16_384, 2048), (64, 3)])
def test_search_is_brute_force_when_all_is_compared(spark, block, query_block):
    rows = points()
    df = clashing(spark.createDataFrame(rows + BAD + [(None, rows[0][1]), rows[9], rows[9]], VECTORS), "rank", "score", "v").repartition(3)
    got = permutation_index.search(df, every=10, share=1.0, pivots=32, prefix=8, block=block, query_block=query_block).collect()
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    x, ids = unit(rows), np.array([i for i, _ in rows])
    raw = np.array([v for _, v in rows], np.float32).astype(np.float64)
    for q in ids[ids % 10 == 0]:
        k = int(np.flatnonzero(ids == q)[0])
        cos = (raw * raw[k]).sum(axis=1) / (np.sqrt((raw * raw).sum(axis=1)) * np.sqrt((raw[k] * raw[k]).sum()))
        cos[k] = -9
        best = np.lexsort((ids, -cos))[:5]
        for rank, b in enumerate(best, 1):
            assert found[q, rank] == (ids[b], pytest.approx(cos[b], abs=1e-12)), (q, rank)
    assert len(got) == 5 * (ids % 10 == 0).sum()
    assert np.allclose(x[0], unit(rows[:1])[0])


def test_search_recall_and_small_tables(spark):
    rows = points(3000, 16, copies=False)
    df = spark.createDataFrame(rows, VECTORS)
    got = permutation_index.search(df, every=50, pivots=128, prefix=48, least=64, block=1500)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    x = unit(rows)
    hits = 0
    for q in range(0, 3000, 50):
        cos = x @ x[q]
        cos[q] = -9
        hits += len(found[q] & set(np.argsort(-cos)[:5].tolist()))
    assert hits / 300 >= 0.9
    three = permutation_index.search(spark.createDataFrame(points(3, copies=False), VECTORS)).collect()
    assert [(r.query_id, r.rank) for r in three] == [(0, 1), (0, 2)]
    assert permutation_index.search(df.limit(0)).collect() == []
    assert permutation_index.search(spark.createDataFrame(BAD, VECTORS)).where("query_id = 0").collect() == []


def test_footrule_is_the_plain_distance():
    rng = np.random.default_rng(3)
    x, pivots = rng.normal(size=(50, 6)), rng.normal(size=(20, 6))
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]
    near = permutation_index.nearest_pivots(x, pivots, 7)
    block = permutation_index.Block(np.arange(50), x, pivots, 7)
    saved = block.footrule(near[4])
    place = np.full((50, 20), 7)
    for k in range(50):
        place[k, near[k]] = np.arange(7)
    plain = np.abs(place - place[4]).sum(axis=1)
    assert np.array_equal(plain, 7 * 8 - saved)


def test_codes_meet_once():
    """Whatever two codes are, at most one bucket counts their pair, and one does if they differ in 11 bits at most."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        a = rng.integers(0, 2**64, dtype=np.uint64)
        flips = rng.choice(64, rng.integers(0, 15), replace=False)
        b = a ^ np.uint64(sum(1 << int(k) for k in flips))
        posts = []
        for code in (a, b):
            keys = set()
            for t in range(4):
                own = (int(code) >> (16 * t)) & 0xFFFF
                keys |= {t << 16 | own} | {t << 16 | (own ^ 1 << k) for k in range(16)}
            posts.append(keys)
        both = np.array(sorted(posts[0] & posts[1]), np.uint64)
        met = itq.met_here(np.full(len(both), a), np.full(len(both), b), both, 16).sum() if len(both) else 0
        assert met <= 1
        if len(flips) <= 11:
            assert met == 1


def test_rotation_is_balanced_and_orthogonal():
    x = unit(points(2000, 16, copies=False))
    mean, turn = itq.learn_rotation(x)
    assert np.allclose(turn.T @ turn, np.eye(16), atol=1e-8)
    assert abs(((x - mean) @ turn >= 0).mean() - 0.5) < 0.05


@pytest.mark.parametrize("small, sub", [(256, 2048), (4, 8)])
def test_groups_are_brute_force(spark, monkeypatch, small, sub):
    monkeypatch.setattr(itq, "SMALL", small)
    monkeypatch.setattr(itq, "SUB_BLOCK", sub)
    rows = points(250, 24)
    extra = [(None, rows[5][1]), (None, None), rows[3], rows[3], (906, [1.0, 2.0])]
    bad = [(i, v if v is None or len(v) < 8 else v * 3) for i, v in BAD if i != 906]
    df = clashing(spark.createDataFrame(rows + bad + extra, VECTORS), "k", "c", "n", "v").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.groups(df).collect()), key=repr)
    alive = rows + [extra[0], extra[2], extra[3]]
    x = unit(alive)
    cos = x @ x.T
    root = grouped(len(alive), lambda a, b: cos[a, b] >= 0.95)
    least = {}
    for (i, _), r in zip(alive, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, int((cos[k] >= 0.95).sum()) - 1, least.get(root[k]), i == least.get(root[k])) for k, (i, _) in enumerate(alive)]
    want += [(i, 0, i, True) for i, _ in bad + [extra[1], extra[4]]]
    assert got == sorted(want, key=repr)


def test_empty_tables(spark):
    for rows in ([], BAD):
        out = itq.groups(spark.createDataFrame(rows, VECTORS)).collect()
        assert len(out) == len(rows) and all(r.n_links == 0 or r.vec_id == 906 for r in out)


def test_contracts(spark, tmp_path):
    spark.createDataFrame(points(200, 16), VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op8_permutation_search(spark, str(tmp_path)).dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert queries.op10_itq_groups(spark, str(tmp_path)).dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
