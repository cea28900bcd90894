"""BPE encoding by a minimal acyclic transducer of frequent words, with exact merges for all others, and decoding.

The words of the whole corpus are counted, the most frequent are encoded once, and compiled into a transducer: an acyclic
automaton in which equal suffixes share their states. Each arc carries the number of words that sort before it at its
state, so the sum along a word's path is its rank, which finds its ids in a flat table. The arrays lie in one file in
the shared folder; tasks map it into memory and look up all new words of a batch at once, one byte position a step.
A word that it does not hold is merged by rank, as the tokenizer file says. The lexicon only saves time: ids never depend
on which words it holds.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.byte_tokens import shared_file, tokenizer_file
from riskframe.llm.common import checkpointed, slices, texts, worker_cache
from riskframe.llm.segment import byte_alphabet, cut, kinds
from riskframe.llm.stored import shared_folder

FREQUENT = 131_072  # words in the lexicon
REMEMBERED = 300_000  # words whose ids a worker keeps; then it starts anew
MAGIC = b"RFLEX001"


# ---- the tokenizer file: words of a text, merges, decoding -----------------------------------

class WordBpe:
    """A word-end BPE file: lower case, white space dropped, ``</w>`` after the last symbol of a word."""

    def __init__(self, spec: bytes):
        data = json.loads(spec)
        model = data["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.kinds = kinds(worker_cache())
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.end] for c in alphabet]
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.specials = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]

    def words(self, text: str) -> list:
        """The words of a text in order; special tokens as their ids."""
        out: list = []
        for part in self.split.split(text) if "<|" in text else [text]:
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                # letters are lowered one by one: no final sigma
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                starts, ends = cut(part, self.kinds, "word")
                out += [part[a:b] for a, b in zip(starts, ends, strict=True)]
        return out

    def merge(self, word: str) -> list[int]:
        """The ids of one word: adjacent symbols are merged by least rank, leftmost first."""
        data = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        if len(ids) > 48:
            return self._merge_long(ids)
        merges = self.merges
        keys = [merges.get(a << 20 | b) for a, b in zip(ids, ids[1:], strict=False)]
        while True:
            best, at = None, -1
            for k, m in enumerate(keys):
                if m is not None and (best is None or m < best):
                    best, at = m, k
            if best is None:
                return ids
            ids[at:at + 2] = [best & 0xFFFFF]
            del keys[at]
            if at:
                keys[at - 1] = merges.get(ids[at - 1] << 20 | ids[at])
            if at < len(keys):
                keys[at] = merges.get(ids[at] << 20 | ids[at + 1])

    def _merge_long(self, ids: list[int]) -> list[int]:
        merges, n = self.merges, len(ids)
        left, right, ids = list(range(-1, n - 1)), list(range(1, n + 1)), list(ids)
        heap = [(m, k) for k in range(n - 1) if (m := merges.get(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, k = heapq.heappop(heap)
            r = right[k]
            if ids[k] < 0 or r >= n or merges.get(ids[k] << 20 | ids[r]) != m:
                continue
            ids[k], ids[r] = m & 0xFFFFF, -1
            right[k] = right[r]
            if right[k] < n:
                left[right[k]] = k
            for a in (left[k], k):
                b = right[a] if a >= 0 else n
                if b < n and (x := merges.get(ids[a] << 20 | ids[b])) is not None:
                    heapq.heappush(heap, (x, a))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens joined by a space, special tokens included, in UTF-8: the file names no decoder."""
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


def word_bpe(spec: bytes) -> WordBpe:
    cache, key = worker_cache(), hashlib.md5(spec).hexdigest()
    if key not in cache:
        cache[key] = WordBpe(spec)
    return cache[key]


# ---- the transducer ---------------------------------------------------------------------------

def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The file of a minimal acyclic transducer for words with id sequences; words sorted, without repeats."""
    states: dict[tuple, int] = {}  # a finished state by its content: final, arcs
    content: list[tuple] = []
    below: list[int] = []  # words accepted from a state

    def finish(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in states:
            states[key] = len(content)
            content.append(key)
            below.append(final + sum(below[t] for _, t in arcs))
        return states[key]

    path: list[list] = [[False, []]]  # states of the last word that are still open: final, arcs
    last, ids, ends = b"", [], [0]

    def close(to: int) -> None:
        while len(path) > to + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], finish(final, arcs)))

    for word, out in entries:
        if word <= last and ids:
            raise ValueError("words must be sorted and distinct")
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
        ids.extend(out)
        ends.append(len(ids))
    close(0)
    root = finish(*path[0])
    key, target, output = [], [], []
    for s, (final, arcs) in enumerate(content):
        before = int(final)
        for byte, t in arcs:
            key.append(s << 8 | byte)
            target.append(t)
            output.append(before)
            before += below[t]
    arrays = [np.asarray(key, "<u8"), np.asarray(target, "<u4"), np.asarray(output, "<u4"),
              np.asarray([f for f, _ in content], "u1"), np.asarray(ends, "<u4"), np.asarray(ids, "<u4")]
    head = np.asarray([root, *map(len, arrays)], "<u8").tobytes()
    return MAGIC + head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        if bytes(data[:8]) != MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        self.root, *sizes = data[8:64].view("<u8").tolist()
        at, arrays = 64, []
        for n, kind in zip(sizes, ("<u8", "<u4", "<u4", "u1", "<u4", "<u4"), strict=True):
            nbytes = n * np.dtype(kind).itemsize
            arrays.append(data[at:at + nbytes].view(kind))
            at += nbytes + -nbytes % 8
        self.key, self.target, self.output, self.final, self.ends, self.ids = arrays

    def ranks(self, words: Sequence[bytes]) -> np.ndarray:
        """The rank of each word, -1 if it is not in the lexicon; all words take a step at a time."""
        n = len(words)
        found, total = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        if not n or not len(self.key):
            return found
        size = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        live, state, step = np.arange(n), np.full(n, self.root, np.uint64), 0
        while len(live):
            done = size[live] == step
            ended = live[done]
            found[ended] = np.where(self.final[state[done].astype(np.int64)] == 1, total[ended], -1)
            live, state = live[~done], state[~done]
            want = state << np.uint64(8) | data[start[live] + step]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            live, at = live[hit], at[hit]
            total[live] += self.output[at]
            state, step = self.target[at].astype(np.uint64), step + 1
        return found

    def ids_of(self, rank: int) -> bytes:
        return self.ids[self.ends[rank]:self.ends[rank + 1]].tobytes()


# ---- over tables ------------------------------------------------------------------------------

def word_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", kept: int = 100_000) -> DataFrame:
    """(word, n) over all texts; special tokens are not counted. A task counts up to ``kept`` words before it hands them on."""
    spec = shared_file(docs.sparkSession, tokenizer)

    def work(batches):
        bpe, counts = word_bpe(spec.value), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(w for w in bpe.words(text) if w.__class__ is str)
                if len(counts) > kept:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return texts(docs, id_col, text_col).select("text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The compiled lexicon of the most frequent words, about ``frequent`` and never more (that many rows reach the driver).

    Words enter by the logarithm of their count, so that a small histogram tells from which count on they fit.
    """
    level = F.floor(F.log2("n") * 64).cast("int")
    counted = checkpointed(word_counts(docs, tokenizer, id_col, text_col).where("n > 1").withColumn("level", level))
    least, room = None, frequent
    for r in counted.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # 64 levels a doubling
        room -= r.words
        if room < 0:
            break
        least = r.level
    top = [] if least is None else counted.where(F.col("level") >= least).select("word").collect()
    with open(tokenizer, "rb") as f:
        bpe = word_bpe(f.read())
    words = sorted((x.word.encode(), x.word) for x in top)
    return compile_lexicon((data, bpe.merge(word)) for data, word in words)


def share(spark: SparkSession, data: bytes) -> str:
    """Put the file into the shared folder and announce it to all executors; the name to ask SparkFiles for."""
    path = shared_folder(spark, "lexicon")
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(jsc.hadoopConfiguration()).create(at)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


class WordIds(dict):
    """Ids by word, for the words that a worker met."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update({i: np.asarray([i], "<u4").tobytes() for i in self.bpe.specials.values()})

    def learn(self, words: set) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.forget()
            new = [w for w in words if w not in self]
        for word, rank in zip(new, self.lexicon.ranks([w.encode("utf-8", "replace") for w in new]).tolist(), strict=True):
            self[word] = self.lexicon.ids_of(rank) if rank >= 0 else np.asarray(self.bpe.merge(word), "<u4").tobytes()


def encode(docs: DataFrame, tokenizer: str | None = None, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) for every row: ids as little-endian unsigned 32-bit integers, without added special tokens.

    Whole texts; a null or empty text has no ids; null doc_ids and repeated rows are kept; an empty table gives no rows.
    Tokenizer: path of a word-end BPE file on the driver.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_file("word_bpe_49k.json")
    name = share(spark, build_lexicon(docs, tokenizer, frequent, id_col, text_col))
    spec = shared_file(spark, tokenizer)

    def work(batches):
        cache, bpe = worker_cache(), word_bpe(spec.value)
        if cache.get("lexicon", ("",))[0] != name:  # a worker keeps the last one only
            cache["lexicon"] = (name, WordIds(bpe, Lexicon(SparkFiles.get(name))))
        ids = cache["lexicon"][1]
        for whole in batches:
            for batch in slices(whole, 1):
                lists = [bpe.words(t) for t in batch.column(1).to_pylist()]
                ids.learn(set().union(*lists))
                out = [b"".join(map(ids.__getitem__, words)) for words in lists]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())],
                                                 names=["doc_id", "n_tokens", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows (doc_id, n_tokens, ids) with the decoded ``text``; null ids give an empty text."""
    spec = shared_file(encoded.sparkSession, tokenizer or tokenizer_file("word_bpe_49k.json"))

    def work(batches):
        bpe = word_bpe(spec.value)
        for whole in batches:
            for batch in slices(whole, 2, 4_000_000):
                text = [bpe.decode(np.frombuffer(x or b"", "<u4")).decode() for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(work, "doc_id long, n_tokens long, ids binary, text string")
