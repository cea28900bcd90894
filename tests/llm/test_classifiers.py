import random
import zlib

import numpy as np
import pytest

from riskframe.llm import labelled, masked_lm, quality, queries, toxicity
from tests.llm.helpers import DOCS, awkward, clashing, sentence

LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def corpus():
    """Documents of several sites; toxic ones hold inflected insults, some of them disguised, poor ones repeat and shout."""
    rng, docs, labels = random.Random(3), [], []
    for i in range(900):
        text = sentence(rng, rng.randint(20, 120), 3000)
        toxic, poor = i % 9 == 0, i % 7 == 0
        words = text.split()
        if toxic:
            for _ in range(3):
                root = rng.choice(["zargol", "blimfut"])
                word = root + rng.choice(["", "en", "ing", "ish"])
                if i % 2:
                    word = word.replace("o", "0").replace("l", "ⅼ").replace("i", "1")
                words.insert(rng.randrange(len(words)), word)
        if poor:
            words = [w.upper() + "!!" for w in words[:10]] * 5
        docs.append((i, " ".join(words), rng.choice(["en", "fr"]), f"site{i % 4}"))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, corpus):
    docs, labels = corpus
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4).cache(),
            spark.createDataFrame(labels, LABELS).cache())


def test_held_out_and_sample(spark, tables):
    rows = spark.createDataFrame([(i,) for i in range(300)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in rows.select("doc_id", labelled.held_out(rows.doc_id).alias("h")).collect()}
    assert got == {**{i: held(i) for i in range(300)}, None: False}
    learn = labelled.labels_to_learn(tables[1], "toxic")
    assert {r.doc_id for r in learn.collect()} == {i for i in range(900) if not held(i)}
    few = labelled.sample(learn, 20, 60).groupBy("label").count().collect()
    assert all(abs(r["count"] - {1: 20, 0: 60}[r.label]) < 30 for r in few)
    a, b, c = [i for i in range(20) if not held(i)][:3]
    odd = spark.createDataFrame([(None, 1, 1), (a, None, None), (b, 1, 0), (b, 1, 1), (c, 1, 7)], LABELS)
    assert [(r.doc_id, r.label) for r in labelled.labels_to_learn(odd, "toxic").collect()] == [(b, 1)]


def test_logistic_is_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=500) > 0.3).astype(float)
    beta = labelled.logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ beta[:3] + beta[3])))
    assert np.abs(x.T @ (p - y) + beta[:3]).max() < 1e-6 and abs((p - y).sum()) < 1e-4


def test_folding():
    table = toxicity.Folding()
    assert toxicity.fold("L0ser, Ⅼ０ser!\nраth3tic ＩＤiot don't", table) == " loser loser pathetic idiot don t "
    assert toxicity.fold("", table) == "  "


def test_weigh_longest_match_and_exceptions():
    lexicon = toxicity.Lexicon({"zarg": 1.0, "zargol": 2.5, "blim": 4.0}, ["blimp"], [1, 1, 0])
    found = lexicon.automaton()
    table = toxicity.Folding()
    for text, want in (("zarg", 1.0), ("zargolen", 2.5), ("xzarg", 0.0), ("blimp blimfut", 4.0), ("blimp", 0.0), ("blimps", 4.0), ("zarg zarg", 2.0), ("", 0.0)):
        folded = toxicity.fold(text, table)
        assert toxicity.weigh(folded, found) == pytest.approx(want), text
        # the same by looking at every word
        plain = 0.0
        for w in folded.split():
            stems = [s for s in lexicon.weights if w.startswith(s)]
            plain += 0 if w in lexicon.exceptions or not stems else lexicon.weights[max(stems, key=len)]
        assert plain == pytest.approx(want)
    short, long = toxicity.measures(2.5, "x" * 300), toxicity.measures(2.5, "x" * 3000)
    assert short[0] == long[0] and short[1] > long[1]


def test_chance_support():
    assert toxicity._least_documents({3: 10}, 0.1) == 3
    assert toxicity._least_documents({3: 10**6, 9: 1}, 0.5) == 4
    assert toxicity._least_documents({9: 10**6}, 0.5) == 10


def test_toxicity_on_held_out_rows(spark, tables, corpus):
    docs, labels = tables
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    truth = {i: t for i, _, t in corpus[1]}
    assert set(got) == set(truth) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == held(i) for i, r in got.items())
    for mine in (True, False):
        right = [got[i].predicted == truth[i] for i in truth if held(i) == mine]
        assert np.mean(right) > 0.97
    # labels of held-out rows do not matter
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.judge(docs, turned).collect()} == {i: r.score for i, r in got.items()}


def test_awkward_documents_are_judged(spark, tables):
    odd = clashing(spark.createDataFrame([(i, t, "en", None) for i, t in awkward()], "doc_id long, text string, lang string, source string"),
                   "score", "label", "site", "toxic")
    labels = tables[1]
    assert toxicity.judge(odd, labels).count() == len(awkward())
    assert quality.judge(odd, labels).count() == len(awkward())
    none = labels.limit(0)
    assert {r.score for r in toxicity.judge(odd, none).collect()} == {0.0}
    assert {r.evidence for r in quality.judge(odd, none).collect()} == {0.0}
    assert toxicity.judge(odd.limit(0), labels).collect() == [] and quality.judge(odd.limit(0), labels).collect() == []


# ---- quality ----------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark, tables, corpus):
    got = {r.doc_id: r for r in quality.judge(*tables).collect()}
    truth = {i: q for i, q, _ in corpus[1]}
    assert np.mean([got[i].kept == truth[i] for i in truth if held(i)]) > 0.97
    assert np.mean([got[i].kept for i in truth if truth[i]]) > 0.99
    for r in got.values():
        assert r.score == pytest.approx(1 / (1 + np.exp(-(r.evidence + r.site_lift)))) and r.kept == (r.score >= 0.5)


def test_posteriors_by_hand(spark):
    """Shrinkage against the same estimate in plain Python."""
    rng = random.Random(5)
    rows = []
    for h in range(6):
        rate = 0.2 + 0.12 * h
        for p in range(4):
            rows += [(f"h{h}" if h else None, f"h{h}/p{p}", float(rng.random() < min(1, rate + 0.05 * p))) for _ in range(rng.randint(1, 60))]
    got, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, good double"))
    total = len(rows)
    m = sum(g for *_, g in rows) / total
    assert mean == pytest.approx(m)

    def strength(groups):  # (n, good, prior)
        noise = [p * (1 - p) for _, _, p in groups]
        n = sum(g[0] for g in groups)
        spread = sum(k * (s / k - p) ** 2 for k, s, p in groups) / n - sum(noise) / n
        return max(1.0, min(1e6, np.mean(noise) / max(spread, 1e-9)))

    def sums(key):
        out = {}
        for r in rows:
            a = out.setdefault(key(r), [0, 0.0])
            a[0] += 1
            a[1] += r[2]
        return out

    hosts, paths = sums(lambda r: r[0]), sums(lambda r: r[:2])
    k = strength([(n, s, m) for n, s in hosts.values()])
    prior = {h: (s + k * m) / (n + k) for h, (n, s) in hosts.items()}
    k2 = strength([(n, s, prior[h]) for (h, _), (n, s) in paths.items()])
    want = {p: (n, (s + k2 * prior[h]) / (n + k2)) for (h, p), (n, s) in paths.items()}
    assert {r.path: (r.n, pytest.approx(r.posterior)) for r in got.collect()} == {p: (n, v) for p, (n, v) in want.items()}


def test_scored_keeps_all_columns(spark, tables, monkeypatch):
    docs, labels = tables
    model = quality.fit(docs, labels)
    few = {r.doc_id: r.quality_score for r in quality.scored(docs, model).collect()}
    assert model.few and set(few) == set(range(900))
    monkeypatch.setattr(quality, "HOT_SHARE", 3)
    many = quality.fit(docs, labels)
    assert not many.few
    out = quality.scored(docs, many)
    assert out.columns == [*docs.columns, "quality_score"] or set(out.columns) == {*docs.columns, "quality_score"}
    assert {r.doc_id: pytest.approx(r.quality_score) for r in out.collect()} == few


# ---- language model ---------------------------------------------------------------------------

def test_probabilities_add_up():
    net = masked_lm.Network.start(1)
    around = np.array([[1], [2], [3], [4]])
    total = sum(np.exp(net.log_probability(around, np.array([k]))[0]) for k in range(masked_lm.EDGE))
    assert total == pytest.approx(1, abs=1e-4)


def test_contexts():
    around, token = masked_lm.contexts([np.array([7, 8, 9]), np.empty(0, np.int64), np.array([5])])
    e = masked_lm.EDGE
    assert token.tolist() == [7, 8, 9, 5]
    assert around.T.tolist() == [[e, e, 8, 9], [e, 7, 9, e], [7, 8, e, e], [e, e, e, e]]
    assert masked_lm.contexts([])[1].tolist() == []


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(2)
    net, token = masked_lm.Network.start(), rng.integers(0, 40, 4000)
    around = np.stack([token + 1, token, token, token + 2]) % masked_lm.EDGE
    before = net.log_probability(around, token).mean()
    for _ in range(60):
        net.learn(around, token, masked_lm.RATE)
    assert net.log_probability(around, token).mean() > before + 1


def test_scores_against_token_by_token(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the cat sat", "a dog ran", "on the mat"]) for _ in range(rng.randint(1, 30)))) for i in range(150)] + awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS), "n_words", "part", "w").repartition(3)
    model = masked_lm.train(docs)
    got = sorted(((r.doc_id, r.n_words, round(r.log_likelihood, 2)) for r in masked_lm.score(docs, model).collect()), key=repr)
    net, ids = masked_lm.Network.start().filled(model.weights.value), masked_lm.Vocabulary(model.vocabulary.value)
    want = []
    for i, t in rows:
        mine = ids.ids(t or "")
        line = [masked_lm.EDGE] * 2 + mine.tolist() + [masked_lm.EDGE] * 2
        around = np.array([[line[k], line[k + 1], line[k + 3], line[k + 4]] for k in range(len(mine))]).reshape(-1, 4).T
        want.append((i, len(mine), round(float(net.log_probability(around, mine).sum()) if len(mine) else 0.0, 2)))
    want.sort(key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) <= 0.02 + 1e-4 * abs(w[2]) for g, w in zip(got, want, strict=True))
    # text like the corpus is likelier than the same words in disorder
    pair = spark.createDataFrame([(1, "the cat sat on the mat a dog ran on the mat the cat sat"), (2, "mat the on ran cat dog the sat a the on cat mat the sat")], DOCS)
    a, b = (r.mean_log_probability for r in masked_lm.score(pair, model).orderBy("doc_id").collect())
    assert a > b
    empty = masked_lm.score(spark.createDataFrame([(1, None), (2, "")], DOCS), model).collect()
    assert [(r.n_words, r.log_likelihood, r.mean_log_probability) for r in empty] == [(0, 0.0, None)] * 2
    assert masked_lm.score(docs.limit(0), masked_lm.train(docs.limit(0))).collect() == []


@pytest.mark.parametrize("known", [0, 700, 131_072])
def test_words_that_share_an_id_are_told_apart(spark, monkeypatch, known):
    monkeypatch.setattr(masked_lm, "KNOWN", known)
    line = " ".join([f"c{k}" for k in range(masked_lm.OWN)] * 20)
    docs = spark.createDataFrame([(1, line), (2, "oneing " * 8 + "twoing " * 2 + "junking")], DOCS)
    model = masked_lm.train(docs)
    rows = [(k, f"c1 {w} c2") for k, w in enumerate(["oneing", "twoing", "junking", "unseening"])] + [(0, "c1 oneing c2"), (None, "c1 c2")]
    got = masked_lm.score(spark.createDataFrame(rows, DOCS), model).collect()
    assert sorted(((r.doc_id, r.n_words) for r in got), key=repr) == sorted(((i, len(t.split())) for i, t in rows), key=repr)
    of = {r.doc_id: r.log_likelihood for r in got}
    net, ids = masked_lm.Network.start().filled(model.weights.value), masked_lm.Vocabulary(model.vocabulary.value).ids("c1 oneing c2").tolist()
    line = [masked_lm.EDGE] * 2 + ids + [masked_lm.EDGE] * 2
    plain = net.log_probability(np.array([[line[k], line[k + 1], line[k + 3], line[k + 4]] for k in range(3)]).T, np.array(ids)).sum()
    for k, n in enumerate([8, 2, 1, 1]):
        assert of[k] == pytest.approx(plain + np.log(n / 12), abs=1e-3)


def test_queries(spark, tables, tmp_path):
    for name, df in zip(("documents", "labels"), tables, strict=True):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    sf = str(tmp_path)
    assert queries.op6_toxicity_lexicon(spark, sf).dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert queries.op9_site_quality(spark, sf).count() == 900
    assert queries.op7_masked_likelihood(spark, sf).count() == 900


def test_ids_take_small_tables():
    ids_of = masked_lm.Vocabulary([f"c{k}" for k in range(masked_lm.OWN)])
    line = [f"c{k}" for k in range(0, 600, 7)] + [f"{a}ing" for a in range(5000)] + ["", "é中文"]
    own = {f"c{k}": k for k in range(masked_lm.OWN)}
    want = [own.get(w, masked_lm.OWN + zlib.crc32(w[-3:].encode()) % masked_lm.SHARED) for w in line]
    assert ids_of.of(line).tolist() == want == [ids_of[w] for w in line]
    assert len(ids_of) == masked_lm.OWN and len(ids_of.endings) < 100  # rare words are not kept one by one


def test_scores_of_all_classes_at_once():
    rng = np.random.default_rng(3)
    net, token, around = masked_lm.Network.start(), rng.integers(0, masked_lm.EDGE, 900), rng.integers(0, masked_lm.EDGE + 1, (4, 900))
    net.token_bias += rng.normal(size=net.token_bias.shape).astype(np.float32)
    order, parts = net.by_class(token)
    h = net.hidden(around.take(order, axis=1))
    per = masked_lm.EDGE // masked_lm.CLASSES
    want = [h[k] @ net.to_token[c] + net.token_bias[c] for k, c in enumerate(token[order] // per)]
    assert np.allclose(net.within(h.T, parts), np.stack(want, axis=1), atol=1e-5)
