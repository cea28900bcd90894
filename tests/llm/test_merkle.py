import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from riskframe.llm import merkle, oracles, queries
from tests.llm.helpers import clashing

ROWS = "doc_id long, text string, source string, lang string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, source, lang, n_chars):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, pos):
    for level in tree[:-1]:
        first = pos // 16 * 16
        yield level[first:pos], level[pos + 1:first + 16]
        pos //= 16


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = levels([leaf(*r) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for p, (doc_id, text, *more) in enumerate(groups[s]):
            way = [*path(trees[s], p), *path(top, k)]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            up = leaf(doc_id, text, *more)
            for left, right in way:
                up = digest("".join(left) + up + "".join(right))
            proof = digest("".join("".join(left + right) for left, right in way))
            out.append((doc_id, trees[s][0][p], trees[s][-1][0], top[-1][0], proof, up, up == top[-1][0]))
    return sorted(out, key=repr)


def made(n, sources, seed=1):
    rng = random.Random(seed)
    rows = [(i if rng.random() > 0.02 else None, rng.choice([f"Abc Ü {i}", None, "", "zz", "É lower"]),
             None if rng.random() < 0.1 else f"s{int(sources * rng.random() ** 2)}", rng.choice(["en", None]), rng.choice([None, 5])) for i in range(n)]
    return [*rows, *rows[:5]]  # the last ones are repeated


@pytest.mark.parametrize("n, sources", [(0, 1), (1, 1), (16, 1), (600, 3), (300, 40)])
def test_audit(spark, tmp_path, n, sources):
    rows = made(n, sources) if n > 16 else made(n, sources)[:n]
    docs = spark.createDataFrame(rows, ROWS).repartition(3)
    want = plain(rows) if rows else []
    assert sorted(map(tuple, merkle.audit(clashing(docs, "tree", "pos", "leaf", "digest", "path", "root", "at", "part", "n")).collect()), key=repr) == want
    if n == 300:
        docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
        assert sorted(map(tuple, queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr) == want
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(con.execute(oracles.merkle()).fetchall(), key=repr) == want


def test_some_requests_share_their_way(spark):
    rows = made(500, 2, seed=3)
    manifest = merkle.build(spark.createDataFrame(rows, ROWS).repartition(4))
    some = manifest.leaves.where("pos % 7 = 3 AND tree = '.s0'")
    found = merkle.prove(manifest, some).withColumn("up", merkle.fold(F.col("digest"), F.col("path"))).collect()
    assert len(found) == some.count() > 5
    assert all(r.digest == r.leaf and r.up == manifest.root for r in found)
    missing = spark.createDataFrame([(".s0", 10**6), (".none", 0), (".s0", 2)], "tree string, pos long")
    assert [(r.tree, r.pos) for r in merkle.prove(manifest, missing).collect()] == [(".s0", 2)]


def test_records_are_addressed_by_content(spark):
    rows = [(1, "same", "s", "en", 4)] * 70  # repeated rows give equal nodes, which are one record
    manifest = merkle.build(spark.createDataFrame(rows, ROWS))
    records = manifest.records.collect()
    assert sorted((r.times, len(r.children)) for r in records) == [(1, 5), (1, 6), (4, 16)]
    assert all(r.digest == digest("".join(r.children)) for r in records)
    assert {(r.digest, r.verified) for r in merkle.prove(manifest).withColumn("verified", merkle.fold(F.col("digest"), F.col("path")) == manifest.root).collect()} == {
        (leaf(*rows[0]), True)}
