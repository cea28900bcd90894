"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from both sides.

The vocabulary comes from word counts over the whole corpus: the most frequent words have ids of their own, all others share ids
by their last letters, and such a word's share of its id comes from the counts of all words. The network adds up an embedding for each of the positions around the masked one, and predicts first
the token's class (ids are classed by frequency), then the token within its class. It is trained data-parallel: in each
round every task goes once over the tokens of its share of the documents from common weights, and the weights of all tasks are averaged
by tokens seen, on the cluster. The score of a document is the sum over all its tokens of the log-probability given their neighbours.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import checkpointed, slices, texts

OWN, SHARED, CLASSES = 512, 512, 32
REACH, WIDTH, BATCH, RATE = 2, 16, 8192, 0.4
EDGE = OWN + SHARED  # id of what lies beyond a document's ends
CHUNK = 4096  # weights that travel together
KNOWN = 131_072  # words whose counts every task holds; the counts of all others are joined
BITS = 1 << 25  # of the bitmap that tells words met once, at every size of the corpus


def words(text: str) -> list[str]:
    return text.lower().split()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept: int = 100_000) -> DataFrame:
    """(word, n) over all texts; a task counts up to ``kept`` words before it hands them on."""

    def work(batches):
        counts = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words(text))
                if len(counts) > kept:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return texts(docs, id_col, text_col).select("text").mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Endings(dict):
    """Shared ids by a word's last letters, remembered as they come, up to a bound."""

    def __missing__(self, end: str) -> int:
        if len(self) > 400_000:
            self.clear()
        k = self[end] = OWN + zlib.crc32(end.encode("utf-8", "replace")) % SHARED
        return k


class Vocabulary(dict):
    """Ids of words: of the frequent ones as given, of all others by their last letters. Both tables are small and stay in a processor's cache."""

    def __init__(self, frequent: list[str]):
        super().__init__({w: k for k, w in enumerate(frequent)})
        self.endings = Endings()

    def __missing__(self, word: str) -> int:
        return self.endings[word[-3:]]

    def ids(self, text: str) -> np.ndarray:
        return self.of(words(text))

    def of(self, found: list[str]) -> np.ndarray:
        endings = self.endings
        return np.fromiter([endings[w[-3:]] if k is None else k for w, k in zip(found, map(self.get, found), strict=True)], np.int64, len(found))


@dataclass
class Network:
    """Weights: position embeddings (places, ids, width), class scores, scores within classes, and their offsets."""

    embed: np.ndarray
    bias: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_token: np.ndarray
    token_bias: np.ndarray

    @classmethod
    def start(cls, seed: int = 5) -> Network:
        rng, per = np.random.default_rng(seed), EDGE // CLASSES
        draw = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype(np.float32)
        return cls(draw(2 * REACH, EDGE + 1, WIDTH), np.zeros(WIDTH, np.float32), draw(WIDTH, CLASSES), np.zeros(CLASSES, np.float32),
                   draw(CLASSES, WIDTH, per), np.zeros((CLASSES, per), np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.bias, self.to_class, self.class_bias, self.to_token, self.token_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for a in self.arrays():
            out.append(flat[at:at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return Network(*out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.embed[0].take(around[0], axis=0)  # several times as fast as an index
        for k in range(1, len(around)):
            total += self.embed[k].take(around[k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def by_class(self, token: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order that puts the tokens of a class together, and each class with its stretch of that order."""
        cls = (token // (EDGE // CLASSES)).astype(np.uint8)
        order = np.argsort(cls, kind="stable")  # a radix sort, as the numbers are small
        ends = np.cumsum(np.bincount(cls, minlength=CLASSES)).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]

    def within(self, h: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
        """For each column of the hidden layer, in the order of ``by_class``, the scores of all tokens of its class."""
        out = np.empty((EDGE // CLASSES, h.shape[1]), np.float32)
        for c, a, b in parts:
            np.add(self.to_token[c].T @ h[:, a:b], self.token_bias[c][:, None], out=out[:, a:b])
        return out

    def log_probability(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token given the ids around it."""
        per = EDGE // CLASSES
        order, parts = self.by_class(token)
        h, met = self.hidden(around.take(order, axis=1)).T, token.take(order)
        each = log_share(self.to_class.T @ h + self.class_bias[:, None], met // per).astype(np.float64)
        each += log_share(self.within(h, parts), met % per)
        out = np.empty(len(token))
        out[order] = each
        return out

    def learn(self, around: np.ndarray, token: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean log-loss of a batch."""
        n, per = len(token), EDGE // CLASSES
        order, parts = self.by_class(token)
        around, token, here = around.take(order, axis=1), token.take(order), np.arange(n)
        rows = self.hidden(around)
        h = rows.T
        p = softmax(self.to_class.T @ h + self.class_bias[:, None])
        p[token // per, here] -= 1
        back = p.T @ self.to_class.T  # a row a token, as the hidden layer lies in memory
        scale = np.float32(rate / n)
        self.to_class -= 4 * scale * (h @ p.T)
        self.class_bias -= 4 * scale * p.sum(axis=1)
        q = softmax(self.within(h, parts))
        q[token % per, here] -= 1
        for c, a, b in parts:
            back[a:b] += q[:, a:b].T @ self.to_token[c].T
            self.to_token[c] -= 16 * scale * (h[:, a:b] @ q[:, a:b].T)
        self.token_bias[[c for c, _, _ in parts]] -= 16 * scale * np.add.reduceat(q, [a for _, a, _ in parts], axis=1).T
        np.multiply(rows, rows, out=rows)
        np.subtract(1, rows, out=rows)
        back *= rows
        self.bias -= scale * (np.ones(n, np.float32) @ back)
        back *= 64 * scale  # a row of the embedding is met rarely
        for k, ids in enumerate(around):
            order = np.argsort(ids.astype(np.uint16), kind="stable")
            line = ids.take(order)
            first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            self.embed[k][line[first]] -= np.clip(np.add.reduceat(back.take(order, axis=0), first, axis=0), -0.5, 0.5)


def softmax(x: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def log_share(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The logarithm of one row's share in each column; ``x`` is used up."""
    x -= x.max(axis=0)
    own = x[row, np.arange(len(row))]
    return own - np.log(np.exp(x, out=x).sum(axis=0))


def contexts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of the tokens of several documents one after the other: the ids around each (places, tokens), and the tokens."""
    pad = np.full(REACH, EDGE)
    line = np.concatenate([x for d in ids for x in (d, pad)] + [np.empty(0, np.int64)])
    line = np.concatenate([pad, line])
    inside = np.concatenate([np.arange(len(d)) + at for d, at in zip(ids, np.cumsum([REACH] + [len(d) + REACH for d in ids[:-1]]), strict=True)]) if ids else np.empty(0, np.int64)
    places = [*range(-REACH, 0), *range(1, REACH + 1)]
    return np.stack([line[inside + k] for k in places]), line[inside]


@dataclass
class Model:
    vocabulary: Broadcast
    weights: Broadcast
    counts: DataFrame  # (word, n) of the whole corpus
    known: Broadcast  # the counts of the commonest words
    shared: Broadcast  # of each shared id, the count of all its words
    repeated: Broadcast  # bitmap of words met twice or more


def frequent_counts(counts: DataFrame, most: int) -> dict[str, int]:
    """The counts of the commonest words, ``most`` at most: a histogram by the logarithm tells from which count on they fit."""
    level = F.floor(F.log2("n") * 8)
    least, total = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level):
        total += r.words
        if total > most:
            break
        least = r.level
    return {} if least is None else {r.word: r.n for r in counts.where(level >= least).collect()}


def repeated_bits(counts: DataFrame) -> np.ndarray:
    """A bitmap, by crc32, of the words met twice or more. Other words on a set bit cost a look into the table and change no result."""
    bit = F.crc32(F.col("word").cast("binary")) % F.lit(BITS)
    cells = counts.where("n > 1").select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
    found, out = cells.toArrow(), np.zeros(BITS // 64, np.int64)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy()
    return out


def shared_counts(counts: DataFrame, own: list[str]) -> np.ndarray:
    """The count of all words of each shared id."""

    def work(batches):
        total, ids_of = np.zeros(SHARED, np.int64), Vocabulary(own)
        for batch in batches:
            ids = ids_of.of(batch.column(0).to_pylist())
            np.add.at(total, ids[ids >= OWN] - OWN, batch.column(1).to_numpy()[ids >= OWN])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARED)), pa.array(total)], names=["id", "n"])

    out = np.zeros(SHARED, np.int64)
    for r in counts.select("word", "n").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def train(docs: DataFrame, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Vocabulary and weights from all documents: in round r, those whose id's hash leaves r, so each is seen once."""
    spark = docs.sparkSession
    counts = checkpointed(word_counts(docs, id_col, text_col))
    top = counts.orderBy(F.desc("n"), "word").limit(OWN).select("word").collect()
    own = [r.word for r in top]
    vocabulary = spark.sparkContext.broadcast(own)
    known = spark.sparkContext.broadcast(frequent_counts(counts, KNOWN))
    shared = spark.sparkContext.broadcast(shared_counts(counts, own))
    repeated = spark.sparkContext.broadcast(repeated_bits(counts))
    net = Network.start()
    rows = texts(docs, id_col, text_col).withColumn("_round", F.pmod(F.xxhash64("doc_id"), F.lit(rounds)))
    for r in range(rounds):
        begin = spark.sparkContext.broadcast(net.flat())

        def work(batches, begin=begin, r=r):
            ids_of, mine = Vocabulary(vocabulary.value), Network.start().filled(begin.value)
            seen, rng, part = 0, np.random.default_rng([r, TaskContext.get().partitionId()]), TaskContext.get().partitionId()
            for whole in batches:
                for batch in slices(whole, 0, 1_000_000):
                    around, token = contexts([ids_of.ids(t) for t in batch.column(0).to_pylist()])
                    order = rng.permutation(len(token))
                    for a in range(0, len(order), BATCH):
                        pick = order[a:a + BATCH]
                        mine.learn(around.take(pick, axis=1), token.take(pick), RATE / (1 + r) * min(1.0, len(pick) / BATCH))
                    seen += len(token)
            if seen:
                flat = mine.flat()
                cuts = range(0, len(flat), CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(cuts), pa.int64()), pa.array(list(range(len(cuts))), pa.int64()), pa.array([float(seen)] * len(cuts)),
                                                  pa.array([flat[a:a + CHUNK] * np.float32(1) for a in cuts], pa.list_(pa.float32()))], names=["part", "chunk", "seen", "w"])

        local = rows.where(F.col("_round") == r).select("text").mapInArrow(work, "part long, chunk long, seen double, w array<float>")
        by_few = local.groupBy("chunk", F.pmod("part", F.lit(64)).alias("salt")).applyInPandas(_mean, "part long, chunk long, seen double, w array<float>")
        means = by_few.groupBy("chunk").applyInPandas(_mean, "part long, chunk long, seen double, w array<float>")
        got = checkpointed(means).orderBy("chunk").collect()  # the size of the network
        if got:
            net = net.filled(np.concatenate([np.asarray(x.w, np.float32) for x in got]))
    return Model(vocabulary, spark.sparkContext.broadcast(net.flat()), counts, known, shared, repeated)


def _mean(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    w = np.average(np.stack(rows["w"].to_numpy()).astype(np.float64), axis=0, weights=rows["seen"])
    return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "chunk": [int(rows["chunk"].iloc[0])], "seen": [float(rows["seen"].sum())], "w": [w.astype(np.float32)]})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_probability) for every row.

    A word with a shared id has the probability of the id times n / (1 + the count of all words of the id), where n is the
    word's count in the corpus; the 1 is left for all words that the corpus does not hold. Whole texts. A null or empty text has no words, likelihood 0 and a null mean; null ids and repeated rows are kept; an
    empty table gives no rows (and trains nothing).
    """

    vocabulary, weights, common, shared, repeated = model.vocabulary, model.weights, model.known, model.shared, model.repeated

    def work(batches):
        ids_of, net = Vocabulary(vocabulary.value), Network.start().filled(weights.value)
        known, all_of, often = common.value, np.log1p(shared.value), repeated.value
        for whole in batches:
            for batch in slices(whole, 2, 500_000):
                found = [words(t) for t in batch.column(2).to_pylist()]
                ids = [ids_of.of(x) for x in found]
                around, token = contexts(ids)
                each = np.concatenate([net.log_probability(around[:, a:a + 8192], token[a:a + 8192]) for a in range(0, len(token), 8192)] + [np.empty(0)])
                line = [w for x in found for w in x]
                at = np.flatnonzero(token >= OWN)
                n = np.fromiter(map(known.get, [line[k] for k in at.tolist()], repeat(0)), np.int64, len(at))
                each[at] += np.log(np.maximum(n, 1)) - all_of[token[at] - OWN]
                size = np.array([len(x) for x in ids])
                total = np.concatenate([[0.0], np.cumsum(each)])
                ends = np.cumsum(size)
                summed = total[ends] - total[ends - size]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(np.where(size > 0, summed, 0.0)),
                                                  pa.nulls(len(size), pa.string())], names=["row", *names, "word"])
                at = at[n == 0]
                bit = np.fromiter((zlib.crc32(line[k].encode()) for k in at.tolist()), np.int64, len(at)) % BITS
                at = at[(often[bit >> 6] >> (bit & 63)) & 1 == 1]  # a word met once, or never, adds log 1
                if len(at):
                    row = np.repeat(batch.column(0).to_numpy(), size)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.float64()),
                                                      pa.array([line[k] for k in at.tolist()], pa.string())], names=["row", *names, "word"])

    names = ["doc_id", "n_words", "log_likelihood"]
    rows = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = rows.mapInArrow(work, "row long, doc_id long, n_words long, log_likelihood double, word string")
    rows = rows.withColumn("word", F.coalesce("word", F.concat(F.lit(" "), "row")))  # no word has a space: documents find nothing, and are spread out
    counted = rows.join(model.counts.where("n > 1").select("word", "n"), "word", "left")
    more = F.coalesce(F.sum(F.log("n")), F.lit(0.0))
    out = counted.groupBy("row").agg(*[F.max(x).alias(x) for x in names], more.alias("more"))
    likelihood = F.col("log_likelihood") + F.col("more")
    return out.select("doc_id", "n_words", likelihood.alias("log_likelihood"), F.when(F.col("n_words") > 0, likelihood / F.col("n_words")).alias("mean_log_probability"))
