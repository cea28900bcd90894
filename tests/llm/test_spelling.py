import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from riskframe.llm import oracles, queries, spelling
from tests.llm.helpers import DOCS, awkward, clashing


def runs_of(text):
    run = ""
    for c in text + " ":
        if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
            run += c.lower() if c <= "Z" else c
        elif run:
            yield run
            run = ""


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(rows):
    count = Counter()
    for i, text in rows:
        for run in runs_of(text or ""):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    forms, out = {}, []
    close = {w: [v for v in count if near(w, v)] for w in count}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        forms[w] = best if best is not None and count[best] >= 10 * count[w] else None
    for w in count:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, count[w], len(close[w]), count.get(forms[w])))
    return sorted(out, key=repr)


def made(seed=3, n=150):
    """Few different words, some of them frequent, with all kinds of slips."""
    rng = random.Random(seed)
    alphabet = "abcdeé×ÿ"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 11))) for _ in range(25)] + ["B" * 8, "b" * 9, "ab" * 20, "ab" * 20 + "c"]

    def slip(w):
        k, c = rng.randrange(len(w)), rng.choice(alphabet)
        return rng.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:], w[::-1], w])

    rows = []
    for i in range(n):
        words = [base[int(rng.random() ** 3 * len(base))] for _ in range(30)]
        words += [slip(slip(rng.choice(base))) if rng.random() < 0.2 else slip(rng.choice(base)) for _ in range(14)]
        rows.append((i if i % 40 else None, rng.choice([" ", ", ", "1", "ā"]).join(words)))
    chain = " ".join(["ccdeabca"] * 400 + ["ccdeabcb"] * 30 + ["ccdeabbb"] * 2)  # forms of forms
    return [*rows, (1000, chain), *rows[:3]]


@pytest.mark.parametrize("small", [False, True])
def test_variants(spark, tmp_path, monkeypatch, small):
    if small:  # many cells, split ones, and deep trees
        for name, value in (("CELL", 8), ("BLOCK", 3), ("PER_CELL", 2), ("LEAF", 2), ("CHUNK", 7)):
            monkeypatch.setattr(spelling, name, value)
    rows = made() + awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS), "word", "n", "id", "run", "h", "cell", "form").repartition(4)
    want = plain(rows)
    assert len(want) > 150 and sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert sorted(map(tuple, spelling.variants(docs).collect()), key=repr) == want
    if small:
        return
    docs.select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_spelling_variants(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(oracles.spelling())
    assert [d[0] for d in cur.description] == got.columns
    assert sorted(cur.fetchall(), key=repr) == want
    assert spelling.variants(docs.limit(0)).collect() == []


def test_trees_lose_nothing():
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice(list(b"abcdefg"), 7).tolist()) for _ in range(700)]
    short = [bytes(rng.choice(list(b"abcdefg"), 6).tolist()) for _ in range(300)]
    x, y = spelling.vectors(spelling.letters(words, 7)), spelling.vectors(spelling.letters(short, 6))
    tree = spelling.cells(x[:200], 4)
    home = np.full(len(x), -1)
    for leaf, at in spelling.visit(tree, x, 0, 0):
        assert (home[at] == -1).all()
        home[at] = leaf
    assert (home >= 0).all() and len(set(home)) > 20
    for q, more, less in ((x, 1, 1), (y, 1, 0)):
        wanted = {(i, j) for i in range(len(q)) for j in range(len(x)) if np.maximum(x[j] - q[i], 0).sum() == more and np.maximum(q[i] - x[j], 0).sum() == less}
        found = [(i, j) for a, b in spelling.Leaves(x).within(q, more, less) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == wanted
        visits = {(i, leaf) for leaf, at in spelling.visit(tree, q, more, less) for i in at.tolist()}
        assert {(i, home[j]) for i, j in wanted} <= visits
        assert len(visits) < 0.7 * len(q) * len(set(home))
