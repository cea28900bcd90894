"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

One inserted, deleted or replaced letter moves a word's vector of letter counts by at most two in L1: a replacement adds one letter and takes
one away, an insertion only adds one. So all words near a given one lie in a small box around its vector. For each word length a k-d tree,
cut from a bounded sample, deals the words into cells; a word visits the cells of its own length that come later and those of the next length that
the box reaches. Within a cell a second tree with tight boxes prunes again, equal vector distances are found by one matrix
product a leaf, and the order of the letters is verified for what is left. Cells with too many words are split into blocks that visit each other.

All letters lie below U+0100, so a word is a row of Latin-1 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import checkpointed, runs, whole_runs

LETTERS = "A-Za-zÀ-ÿ"
CELL = 8_192  # words of a cell, about
BLOCK = 16_384  # larger cells are split
SAMPLE = 262_144  # words that the cells are cut from, at most
PER_CELL = 16  # of them for each cell
LEAF = 32
CHUNK = 16_384
PLACE = np.zeros(256, np.int64)  # the coordinate of each letter
PLACE[ord("a"):ord("z") + 1] = np.arange(26)
PLACE[0xC0:] = 26 + np.arange(64)
DIMS = 26 + 64


def words(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): what whole texts are made of, counted, with A-Z lowered.

    Words are maximal runs of letters. Where ``noise`` divides the crc32 of ``<id>:<run>``, the run loses the letter that the crc points at;
    of what results, words of ``least_length`` letters and ``least_count`` occurrences stay. Null texts have none; a null id is written as nothing.
    """
    capitals = "".join(map(chr, range(65, 91)))
    run = F.explode(F.regexp_extract_all(docs[text_col].cast("string"), F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0)))
    rows = docs.select(F.coalesce(docs[id_col].cast("long").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    rows = rows.select(F.translate("run", capitals, capitals.lower()).alias("run"), "id")
    rows = rows.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    rows = rows.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return rows.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letters(of: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(of), np.uint8).reshape(len(of), length)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words of one length, one row a word."""
    n, length = codes.shape
    flat = (np.arange(n)[:, None] * DIMS + PLACE[codes]).ravel()
    return np.bincount(flat, minlength=n * DIMS).reshape(n, DIMS).astype(np.int16 if length < 2**14 else np.int64)


def plane(x: np.ndarray) -> tuple[int, int] | None:
    """Where to cut: the coordinate that spreads most, at its median; None if all rows are equal."""
    spread = x.var(axis=0)
    dim = int(spread.argmax())
    if spread[dim] == 0:
        return None
    return dim, int(min(np.median(x[:, dim]), x[:, dim].max() - 1))


def cells(x: np.ndarray, per_leaf: int, next_leaf=None):
    """A tree of (coordinate, cut, up to it, beyond it) whose ends are numbers from 0, from the rows of x."""
    next_leaf = [0] if next_leaf is None else next_leaf
    cut = plane(x) if len(x) > per_leaf else None
    if cut is None:
        next_leaf[0] += 1
        return next_leaf[0] - 1
    low = x[:, cut[0]] <= cut[1]
    return (*cut, cells(x[low], per_leaf, next_leaf), cells(x[~low], per_leaf, next_leaf))


def visit(tree, x: np.ndarray, more: int, less: int) -> list[tuple[int, np.ndarray]]:
    """(cell, rows of x): cells that can hold a vector with at most ``more`` letters above and ``less`` below the row's own."""
    out = []
    zero = np.zeros(len(x), np.int64)
    todo = [(tree, np.arange(len(x)), zero, zero, {})]
    while todo:
        node, at, up, down, box = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            out.append((node, at))
            continue
        dim, cut, low, high = node
        c = x[at, dim].astype(np.int64)
        lo, hi = box.get(dim, (0, None))
        was_up, was_down = np.maximum(lo - c, 0), 0 if hi is None else np.maximum(c - hi, 0)
        d = down - was_down + np.maximum(c - cut, 0)  # the cell's vectors have at most cut
        near = d <= less
        todo.append((low, at[near], up[near], d[near], {**box, dim: (lo, cut)}))
        u = up - was_up + np.maximum(cut + 1 - c, 0)
        near = u <= more
        todo.append((high, at[near], u[near], down[near], {**box, dim: (cut + 1, hi)}))
    return out


class Leaves:
    """A k-d tree over vectors with the tight box of every node."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.wide = x.astype(np.float32 if len(x) == 0 or x.max() < 1000 else np.float64)
        self.square = (self.wide * self.wide).sum(axis=1)
        self.root = self._node(np.arange(len(x)))

    def _node(self, rows: np.ndarray):
        here = self.x[rows]
        box = here.min(axis=0), here.max(axis=0)
        cut = plane(here) if len(rows) > LEAF else None
        if cut is None:
            return (*box, rows, None)
        low = here[:, cut[0]] <= cut[1]
        return (*box, self._node(rows[low]), self._node(rows[~low]))

    def within(self, q: np.ndarray, more: int, less: int):
        """Yields (i, j): row i of q and vector j, which has exactly ``more`` letters above and ``less`` below it."""
        wide = q.astype(self.wide.dtype)
        square = (wide * wide).sum(axis=1)
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            (lo, hi, a, b), at = todo.pop()
            here = q[at]
            near = (np.maximum(lo - here, 0).sum(axis=1) <= more) & (np.maximum(here - hi, 0).sum(axis=1) <= less)
            at = at[near]
            if not len(at):
                continue
            if b is not None:
                todo += [(a, at), (b, at)]
                continue
            for k in range(0, len(a), 4096):  # equal vectors can make a leaf large
                some = a[k:k + 4096]
                # counts are whole: a squared distance of one or two is so many letters that differ by one
                gap = square[at, None] + self.square[some] - 2 * (wide[at] @ self.wide[some].T)
                i, j = np.nonzero(gap == more + less)
                if len(i):
                    yield at[i], some[j]


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows of b are those of a with one letter more."""
    before = np.append(a != b[:, :-1], np.ones((len(a), 1), bool), axis=1).argmax(axis=1)
    after = np.append((a != b[:, 1:])[:, ::-1], np.ones((len(a), 1), bool), axis=1).argmax(axis=1)
    return before + after >= a.shape[1]


class Found:
    """What is known of near words: how many, and which is the most frequent, for every word of a block."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, word: np.ndarray, n: np.ndarray, other: np.ndarray, other_n: np.ndarray) -> None:
        self.parts += [(word, other, other_n), (other, word, n)]
        if sum(len(p[0]) for p in self.parts) > 1_000_000:
            self.parts = [self.best()[:4]]

    def best(self) -> tuple[np.ndarray, ...]:
        word, other, n = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        times = np.concatenate([p[3] if len(p) > 3 else np.ones(len(p[0]), np.int64) for p in self.parts])
        order = np.lexsort((other, -n, word))
        word, other, n, times = word[order], other[order], n[order], times[order]
        head, _ = runs(word)
        return word[head], other[head], n[head], np.add.reduceat(times, head)


def _search(key: str, role: np.ndarray, word: list[bytes], n: np.ndarray):
    """Near words of one block: role 0 are its own words, 1 visitors of their length, 2 visitors one letter shorter."""
    own = np.flatnonzero(role == 0)
    if not len(own):
        return None
    _, rank = np.unique(np.array(word, object), return_inverse=True)  # words as numbers in code point order
    length = len(word[own[0]])
    codes = letters([word[k] for k in own.tolist()], length)
    tree, found = Leaves(vectors(codes)), Found()
    step = max(1, min(CHUNK, 8_000_000 // length))
    for r, more, less, same in ((0, 1, 1, replaced), (1, 1, 1, replaced), (2, 1, 0, inserted)):
        mine = np.flatnonzero(role == r)
        for k in range(0, len(mine), step):
            rows = mine[k:k + step]
            here = letters([word[i] for i in rows.tolist()], length - (r == 2))
            for i, j in tree.within(vectors(here), more, less):
                if r == 0:  # a pair of own words once
                    once = rows[i] < own[j]
                    i, j = i[once], j[once]
                for s in range(0, len(i), step):
                    a, b = i[s:s + step], j[s:s + step]
                    near = same(here[a], codes[b])
                    a, b = rows[a[near]], own[b[near]]
                    found.add(rank[a], n[a], rank[b], n[b])
    if not sum(len(p[0]) for p in found.parts):
        return None
    at, other, other_n, times = found.best()
    names = np.array(word, object)
    by_rank = np.empty(rank.max() + 1, object)
    by_rank[rank] = names
    return by_rank[at], times, other_n, by_rank[other]


def near(counted: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): how many words of (word, n) are one edit away, and the most frequent of them (ties: the first by code points).

    Words without near words give no row. Words must be distinct and made of letters below U+0100.
    """
    spark = counted.sparkSession
    total = counted.count()
    size = min(SAMPLE, max(1, total // CELL) * PER_CELL)
    pick = F.pmod(F.xxhash64(F.lit(11), "word"), F.lit(2**32)) < min(2**32, 2**32 * size // max(total, 1))
    chosen: dict[int, list[bytes]] = {}
    for (w,) in counted.where(pick).select("word").limit(2 * SAMPLE).collect():  # a bounded sample, which only balances the cells
        chosen.setdefault(len(w), []).append(w.encode("latin-1"))
    trees = spark.sparkContext.broadcast({k: cells(vectors(letters(v, k)), PER_CELL) for k, v in chosen.items()})

    def place(batches):
        for batch in batches:
            word = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            length = np.fromiter(map(len, word), np.int64, len(word))
            cell = np.zeros(len(word), np.int64)
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                cell[rows] = size << 32
                for leaf, at in visit(trees.value.get(size, 0), vectors(letters([word[k] for k in rows.tolist()], size)), 0, 0):
                    cell[rows[at]] += leaf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["word", "n", "cell"])

    placed = checkpointed(counted.select("word", "n").mapInArrow(place, "word string, n long, cell long"))
    large = checkpointed(placed.groupBy("cell").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK))

    def visits(batches):
        for batch in batches:
            word = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            home, length = batch.column(2).to_numpy(), np.fromiter(map(len, word), np.int64, len(word))
            out = [(np.arange(len(word)), home, 0)]
            for size in np.unique(length).tolist():
                rows = np.flatnonzero(length == size)
                x = vectors(letters([word[k] for k in rows.tolist()], size))
                for role, of, less in ((1, size, 1), (2, size + 1, 0)):
                    for leaf, at in visit(trees.value.get(of, 0), x, 1, less):
                        cell = (of << 32) + leaf
                        at = rows[at]
                        at = at[home[at] < cell]
                        out.append((at, np.full(len(at), cell), role))
            row = np.concatenate([o[0] for o in out])
            cell = np.concatenate([o[1] for o in out])
            role = np.concatenate([np.full(len(o[0]), o[2], np.int8) for o in out])
            for k in range(0, len(row), 100_000):
                some = pa.array(row[k:k + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(cell[k:k + 100_000]), pa.array(role[k:k + 100_000]), batch.column(0).take(some), batch.column(1).take(some)],
                                                 names=["cell", "role", "word", "n"])

    rows = placed.mapInArrow(visits, "cell long, role byte, word string, n long")
    if large.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:
        rows = rows.join(large, "cell", "left")
        parts = F.coalesce(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("word"), parts).cast("int")
        rows = rows.withColumn("own", own).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        # a word of a split cell is at home in one part and visits the later ones
        rows = rows.where("role > 0 OR part >= own").withColumn("role", F.when(F.col("role") > 0, F.col("role")).otherwise((F.col("part") > F.col("own")).cast("byte")))
    rows = rows.select(F.concat_ws("/", "cell", "part").alias("key"), "role", "word", "n")

    def search(batches):
        for group in whole_runs(batches, 0):
            key = group.column(0).to_numpy(zero_copy_only=False)
            for a, b in zip(*(r.tolist() for r in runs(key)), strict=True):
                here = group.slice(a, b - a)
                word = [w.encode("latin-1") for w in here.column(2).to_pylist()]
                got = _search(key[a], here.column(1).to_numpy(), word, here.column(3).to_numpy())
                if got:
                    text = [pa.array([w.decode("latin-1") for w in got[k]], pa.string()) for k in (0, 3)]
                    yield pa.RecordBatch.from_arrays([text[0], pa.array(got[1]), pa.array(got[2]), text[1]], names=["word", "n_near", "form_n", "form"])

    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(search, "word string, n_near long, form_n long, form string")
    first = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("m")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("m.less")).alias("form_n"), F.col("m.form").alias("form"))


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int = 31, times: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts, see ``words``.

    A word's form is its near word with the largest n, if that is at least ``times`` the word's own; else null. The root is where forms
    lead in the end, the word itself without any. Null and empty texts and tables have no words; repeated rows count again.
    """
    counted = checkpointed(words(docs, least_length, least_count, noise, id_col, text_col))
    known = counted.join(near(counted), "word", "left").withColumn("is_form", F.col("form_n") >= times * F.col("n"))
    known = checkpointed(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("form")).alias("form"),
                                      F.when(F.col("is_form"), F.col("form_n")).alias("form_n")))
    # every step multiplies n, so a way of forms is short; each round doubles what has been followed
    way = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        way = checkpointed(way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if way.where("moved").isEmpty():
            break
        way = way.drop("moved")
    return known.join(way.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
