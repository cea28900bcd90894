"""Encoding, packing and materialisation against the tokenizers library and plain re-assembly."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskframe.llm import byte_tokens, lexicon, materialise, packing, queries
from tests.llm.helpers import DOCS, awkward, clashing, sentence

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
ODD = ["'", "'s", "t", "'ll", "d", " ", "  ", "\n", "\t", "A", "é", "É", "ñ", "1", "23", "٣", "!", "...", "<|endoftext|>", "<|end", " ", "\x1c",
       "\x85", "中文", "😀", "'ve", "m", "İ", "Σ", "ΑΣ", "é", "ﬁ", "²", "​", "_", "\r\n", "don't", "ß", "word"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_tokens.tokenizer_file(name))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(2)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [t or "" for _, t in awkward()]


def test_byte_encoder_is_the_library(odd_texts):
    name = "byte_bpe_50k.json"
    with open(byte_tokens.tokenizer_file(name), "rb") as f:
        ours, theirs = byte_tokens.ByteEncoder(f.read()), library(name)
    for t in odd_texts:
        assert ours.encode(t).tolist() == theirs.encode(t, add_special_tokens=False).ids, t


def test_words_and_merges_are_the_library(odd_texts):
    name = "word_bpe_49k.json"
    with open(byte_tokens.tokenizer_file(name), "rb") as f:
        ours, theirs = lexicon.WordBpe(f.read()), library(name)
    for t in [*odd_texts, "x" * 300 + "ab" * 400]:
        ids = [i for w in ours.words(t) for i in ([w] if isinstance(w, int) else ours.merge(w))]
        want = theirs.encode(t, add_special_tokens=False).ids
        assert ids == want, t
        assert ours.decode(np.asarray(want, "<u4")).decode() == theirs.decode(want, skip_special_tokens=False)


def test_long_merges_equal_short_ones():
    with open(byte_tokens.tokenizer_file("word_bpe_49k.json"), "rb") as f:
        bpe = lexicon.WordBpe(f.read())
    rng = random.Random(4)
    for _ in range(200):
        word = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 48)))
        first = [bpe.inner[b] for b in word.encode()[:-1]] + [bpe.last[word.encode()[-1]]]
        assert bpe._merge_long(first) == bpe.merge(word)


def test_lexicon_is_minimal_and_exact(tmp_path):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))).encode() for _ in range(600)} | {"é中".encode()})
    data = lexicon.compile_lexicon((w, [k, k + 1][: 1 + k % 2]) for k, w in enumerate(words))
    path = tmp_path / "lexicon"
    path.write_bytes(data)
    found = lexicon.Lexicon(str(path))
    asked = [*words, b"", b"zz", b"abcabcabcabc", words[0] + b"!"]
    ranks = found.ranks(asked).tolist()
    assert ranks[:len(words)] == list(range(len(words)))
    assert ranks[len(words):] == [-1] * 4
    assert [np.frombuffer(found.ids_of(k), "<u4").tolist() for k in (0, 1)] == [[0], [1, 2]]
    # as many states as there are different sets of endings
    endings = {frozenset(w[len(p):] for w in words if w.startswith(p)) for p in {w[:k] for w in words for k in range(len(w) + 1)}}
    assert len(found.final) == len(endings)
    assert lexicon.compile_lexicon([])[:8] == lexicon.MAGIC
    (tmp_path / "none").write_bytes(lexicon.compile_lexicon([]))
    assert lexicon.Lexicon(str(tmp_path / "none")).ranks([b"a"]).tolist() == [-1]


@pytest.mark.parametrize("frequent", [0, 50, 100_000])
def test_encode_and_decode_tables(spark, frequent):
    rows = awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS), "ids", "n_tokens", "word")
    theirs = library("word_bpe_49k.json")
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in lexicon.decode(lexicon.encode(docs, frequent=frequent)).collect()]
    want = []
    for i, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.asarray(ids, "<u4").tobytes(), theirs.decode(ids, skip_special_tokens=False)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lexicon.encode(docs.limit(0)).collect() == []


def write_tables(spark, path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_op1_contract(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is not None]
    theirs = library("word_bpe_49k.json")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_lexicon_bpe(spark, write_tables(spark, tmp_path, rows)).collect()}
    want = set()
    for i, t in rows:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False).encode()
        want.add((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert got == want


# ---- packing ----------------------------------------------------------------------------------

def test_segment_tree_finds_the_tightest_window():
    rng = random.Random(5)
    tree, plain = packing.Capacities(64), []
    for k in range(2000):
        if rng.random() < 0.5:
            room = rng.randint(1, 64)
            tree.put(room, k)
            plain.append(room)
        else:
            need = rng.randint(1, 64)
            found, best = tree.take(need), min((x for x in plain if x >= need), default=None)
            assert (found and found[1]) == best
            if best is not None:
                plain.remove(best)


def test_best_fit_decreasing_is_the_plain_algorithm():
    rng = random.Random(6)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    where, full = packing.best_fit_decreasing(lengths, 100)
    rooms = []
    for k in sorted(range(500), key=lambda k: (-lengths[k], k)):
        fit = min((r for r in rooms if r >= lengths[k]), default=None)
        if fit is None:
            rooms.append(100 - lengths[k])
        else:
            rooms[rooms.index(fit)] -= lengths[k]
    assert sorted(100 - f for f in full) == sorted(rooms)
    assert Counter({w: f for w, f in enumerate(full)}) == Counter({w: sum(lengths[k] for k in range(500) if where[k] == w) for w in range(len(full))})


@pytest.mark.parametrize("group", [3, 65_536])
def test_pack(spark, group):
    rows = awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS), "ids", "start", "sequence_id").repartition(3)
    window, theirs = 64, library("byte_bpe_50k.json")
    pieces = packing.pack(docs, window=window, group=group).collect()
    tiles = defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        tiles[p.sequence_id].append((p.offset, p.length))
    for t in tiles.values():
        at = 0
        for offset, n in sorted(t):
            assert offset == at
            at += n
        assert at <= window
    want = Counter((i, tuple(theirs.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in rows)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    # documents that are there once are rebuilt from their pieces; of all, the ids are counted
    for (i, ids), n in want.items():
        if n == 1 and i is not None:
            mine = sorted(by_doc[i], key=lambda p: p.start)
            assert np.frombuffer(b"".join(p.ids for p in mine), "<u4").tolist() == list(ids)
            assert {p.doc_tokens for p in mine} == {len(ids)}
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    if group > 3:
        assert sum(p.length for p in pieces) / window / len(tiles) > 0.97
    assert packing.pack(docs.limit(0)).collect() == []


# ---- materialisation --------------------------------------------------------------------------

@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_feistel_walk_is_a_permutation(size):
    for key in (0, 20, 2**63):
        image = materialise.permuted(np.arange(size), size, key)
        assert sorted(image.tolist()) == list(range(size))
    if size > 100:
        assert (materialise.permuted(np.arange(size), size, 1) != materialise.permuted(np.arange(size), size, 2)).mean() > 0.9


def test_materialise_round_trip(spark, tmp_path):
    rows = awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS), "slot", "ids").repartition(3)
    m = materialise.write(docs, path=str(tmp_path / "shards"), length=32, slots=16)
    index = {r.slot: r for r in m.index.collect()}
    assert sorted(index) == list(range(m.sequences)) and len({r.sequence_id for r in index.values()}) == m.sequences
    read = dict(materialise.read(m))
    assert sorted(read) == list(range(m.sequences))
    assert [k for k, _ in materialise.read(m, 37)] == list(range(37, m.sequences))  # a reader goes on where it stopped
    for slot, ids in read.items():
        r = index[slot]
        assert (r.shard, r.place) == (slot // 16, slot % 16 * 64)
        assert zlib.crc32(ids[:r.n_tokens].tobytes()) == r.ids_crc32 and not ids[r.n_tokens:].any()
        assert slot == materialise.permuted(np.array([r.sequence_id]), m.sequences, 20)[0]
    # the stream, put back in order, is every document with its separator
    stream = np.concatenate([read[s][:index[s].n_tokens] for s in sorted(index, key=lambda s: index[s].sequence_id)]).tolist()
    theirs, want = library("byte_bpe_50k.json"), Counter()
    for _, t in rows:
        want.update([*theirs.encode(t or "", add_special_tokens=False).ids, 0])
    assert Counter(stream) == want
    assert {d for r in index.values() for d in r.doc_ids} == {i for i, _ in rows}
    assert {r.slot: bytes(r.ids) for r in materialise.scan(spark, m).collect()} == {s: x.tobytes() for s, x in read.items()}
    empty = materialise.write(docs.limit(0), path=str(tmp_path / "none"))
    assert empty.sequences == 0 and empty.index.collect() == [] and list(materialise.read(empty)) == []


def test_op2_and_op3_cover_the_table(spark, tmp_path):
    rng = random.Random(8)
    sf = write_tables(spark, tmp_path, [(i, sentence(rng, rng.randint(1, 900))) for i in range(60)])
    index = queries.op2_training_order(spark, sf).collect()
    pieces = queries.op3_pack_best_fit(spark, sf).collect()
    assert sum(r.n_tokens for r in index) == sum(p.length for p in pieces)
    assert {p.doc_id for p in pieces} == set(range(60)) == {d for r in index for d in r.doc_ids}
