"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lowers letters, turns look-alike letters of other alphabets and digits or signs that stand for letters into Latin
letters, and makes everything else a space. The lexicon holds word beginnings that mark toxic documents in a bounded
sample of labelled rows, with their log-odds; words that a beginning also matches in clean documents are exception
phrases, and matches within them do not count. The summed weight, as it is and by length, gives the score through a
logistic curve fitted to the same sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import checkpointed, texts
from riskframe.llm.labelled import held_out, labels_to_learn, logistic, sample
from riskframe.llm.simhash import shingle_hashes
from riskframe.llm.stored import stored

REJECT = 0.7
# fixed values: letters of other alphabets that look like Latin ones, and signs used in place of letters
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d",
              "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ρ": "p", "ε": "e", "ι": "i", "κ": "k",
              "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


class Folding(dict):
    """Translation table of single characters, filled as they are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:  # full-width forms
            c = chr(code - 0xFEE0)
        c = c.lower()
        c = HOMOGLYPHS.get(c, SIGNS.get(c, c))
        self[code] = c = c if c.isalpha() or all(x.isalpha() or "̀" <= x <= "ͯ" for x in c) else " "
        return c


def fold(text: str, table: Folding) -> str:
    """Words of folded letters, one space between them and at both ends."""
    return " " + " ".join(text.translate(table).split()) + " "


@dataclass
class Lexicon:
    """Word beginnings with weights, exception words, and the curve (for the weight, the weight by length, and 1)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] | None = None

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem, weight in self.weights.items():
            found.add_word(" " + stem, (len(stem), weight))
        for word in self.exceptions:
            found.add_word(" " + word + " ", (len(word) + 2, None))
        found.make_automaton()
        return found


def weigh(folded: str, automaton) -> float:
    """The summed weight of what matches; of matches at one place the longest counts, none within an exception."""
    best: dict[int, tuple[int, float]] = {}
    spared = set()
    for end, (size, weight) in automaton.iter(folded):
        if weight is None:
            spared.add(end - size + 1)
        else:
            start = end - size
            if start not in best or best[start][0] < size:
                best[start] = (size, weight)
    return sum(w for start, (_, w) in best.items() if start not in spared)


def measures(weight: float, folded: str) -> tuple[float, float]:
    """The weight on a log scale, and the same by length (per thousand letters, with a floor for short texts)."""
    return math.log1p(weight), math.log1p(1000 * weight / max(len(folded), 200))


def _counted(rows: DataFrame, terms) -> DataFrame:
    """(term, toxic, clean): in how many documents of each label a term occurs; terms(folded) gives a set."""

    def work(batches):
        table, counts = Folding(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((t, label) for t in terms(fold(text, table)))
            if counts:
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys]), pa.array([n if y else 0 for (_, y), n in counts.items()], pa.int64()),
                                                  pa.array([0 if y else n for (_, y), n in counts.items()], pa.int64())], names=["term", "toxic", "clean"])
                counts.clear()

    return (rows.select("text", "label").mapInArrow(work, "term string, toxic long, clean long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _without_copies(rows: DataFrame) -> DataFrame:
    """The bounded sample with near copies told apart by few: of rows with one label and one least shingle (by either of two
    hashes) one stays. Words of a text that was copied often would otherwise look like words of many documents."""

    def work(batches):
        for batch in batches:
            least = [[int(shingle_hashes(t, 5, seed).min(initial=2**64 - 1)) >> 1 for t in batch.column(0).to_pylist()] for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in least]], names=["text", "label", "k1", "k2"])

    out = rows.mapInArrow(work, "text string, label int, k1 long, k2 long")
    for key in ("k1", "k2"):
        out = out.groupBy("label", F.col(key).alias("k")).agg(F.min(F.struct("text", "k1", "k2")).alias("m")).select("label", "m.*")
    return out.select("text", "label")


def _least_documents(terms: dict[int, int], share: float) -> int:
    """The least number of documents, 3 or more, at which not one of the terms that so many hold would be all toxic by chance.

    terms: how many terms a number of documents hold; share: of toxic documents.
    """
    n = 3
    while sum(k for held, k in terms.items() if held >= n) * share ** n > 0.5:
        n += 1
    return n


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 4000, clean: int = 16_000, purity: float = 0.95,
          shortest: int = 4, longest: int = 12, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Fit a lexicon to about ``most`` toxic and ``clean`` other labelled documents, held-out rows left aside.

    A word beginning enters if its share of toxic among the documents that hold it, at equal class sizes, reaches ``purity``, and
    if so many toxic documents hold it that not one beginning is expected to enter by chance; of nested beginnings the
    shortest that does. Without labelled rows of both classes the lexicon is empty and scores are 0.
    """
    chosen = sample(labels_to_learn(labels, label), most, clean)
    rows = stored(_without_copies(texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "label")), "toxicity-sample")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon()

    def beginnings(folded: str) -> set:
        return {w[:k] for w in set(folded.split()) for k in range(shortest, min(longest, len(w)) + 1)}

    rate = F.col("toxic") / sizes[1], F.col("clean") / sizes[0]
    counted = checkpointed(_counted(rows, beginnings).where("toxic + clean > 1"))
    held = counted.groupBy((F.col("toxic") + F.col("clean")).alias("n")).agg(F.count("*").alias("terms")).orderBy("n").collect()  # a row a count
    least = _least_documents({r.n: r.terms for r in held}, sizes[1] / (sizes[0] + sizes[1]))
    pure = counted.where((F.col("toxic") >= least) & (rate[0] >= purity * (rate[0] + rate[1])))
    counts = {r.term: (r.toxic, r.clean) for r in pure.collect()}  # of the bounded sample
    stems = [t for t in counts if not any(t[:k] in counts for k in range(shortest, len(t)))]
    weights = {t: math.log((counts[t][0] + 0.5) / (sizes[1] + 1)) - math.log((counts[t][1] + 0.5) / (sizes[0] + 1)) for t in stems}

    def matched(folded: str) -> set:
        return {w for w in set(folded.split()) if any(w[:k] in weights for k in range(shortest, min(longest, len(w)) + 1))}

    seen = _counted(rows, matched).where((F.col("clean") >= 2) & (rate[1] > rate[0]))
    lexicon = Lexicon(weights, sorted(r.term for r in seen.collect()))

    def features(batches):
        table, automaton = Folding(), lexicon.automaton()
        for batch in batches:
            out = [measures(weigh(f, automaton), f) for f in (fold(t, table) for t in batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64()), batch.column(1)],
                                             names=["a", "b", "label"])

    if weights:
        fit = np.array(sorted(tuple(r) for r in rows.select("text", "label").mapInArrow(features, "a double, b double, label int").collect()))
        y = fit[:, 2]
        equal = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        lexicon.curve = logistic(fit[:, :2], y, equal).tolist()
    return lexicon


def score(lexicon: Lexicon, text: Column) -> Column:
    """The score of a text, 0 to 1; 0 for a null text and for an empty lexicon. The whole text is read."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, automaton = Folding(), lexicon.automaton() if lexicon.curve else None
        for batch in batches:
            out = np.zeros(len(batch))
            for k, t in enumerate(batch if automaton is not None else ()):
                folded = fold(t or "", table)
                a, b = measures(weigh(folded, automaton), folded)
                z = a * lexicon.curve[0] + b * lexicon.curve[1] + lexicon.curve[2]
                out[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            yield pd.Series(out)

    return F.pandas_udf(work, "double")(text)


def judge(docs: DataFrame, labels: DataFrame, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; predicted is 1 from ``reject`` on.

    Null and empty texts are scored as empty; null ids are kept and count as not held out; repeated rows are kept.
    """
    lexicon = learn(docs, labels, id_col=id_col, text_col=text_col, **fit)
    rows = texts(docs, id_col, text_col)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(lexicon, F.col("text")).alias("score")).select(
        "*", (F.col("score") >= reject).cast("int").alias("predicted"))
