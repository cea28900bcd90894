"""Packing token sequences into windows: best-fit decreasing over a segment tree of remaining capacities.

A document's ids end with a separator. Documents longer than a window are first cut into full windows; what remains of
them and shorter documents are packed in descending length, each into the open window with the least room that still
holds it. The segment tree is indexed by remaining capacity, so the tightest window is found in log2(window) steps. At
last the emptiest windows are cut up to fill the gaps of the others.

Every task packs the rows of its partition, at most ``group`` remainders at a time, so memory is bounded, nothing is
shuffled, and one window of a group at most stays partly empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from riskframe.llm.byte_tokens import byte_encoder, shared_file, tokenizer_file
from riskframe.llm.common import slices, texts

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Capacities:
    """How many open windows have each remaining capacity, in a segment tree over the capacities."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.tree[k] += by
            k >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of ``need`` or more, taken out, with its room."""
        tree, k = self.tree, need + self.size
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k ^ 1]):  # up, until a right sibling holds something
                k >>= 1
            if k <= 1:
                return None
            k ^= 1
            while k < self.size:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        room = k - self.size
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number of every item (lengths of 1 to ``window``), and how full each window is."""
    rooms, where, full = Capacities(window), [0] * len(lengths), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        need = lengths[k]
        found = rooms.take(need)
        if found is None:
            found = (len(full), window)
            full.append(0)
        w, room = found
        where[k], full[w] = w, full[w] + need
        if room > need:
            rooms.put(room - need, w)
    return where, full


def placed(lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, window, offset): best fit, and then the emptiest windows are cut up to fill the gaps of the others.

    So one window of a group at most is not full, and only items of the emptiest windows are cut.
    """
    where, full = best_fit_decreasing(lengths, window)
    order = sorted(range(len(full)), key=lambda w: (-full[w], w))
    keep = -(-sum(lengths) // window)
    number = {w: k for k, w in enumerate(order[:keep])}
    fill, out, loose = [0] * keep, [], []
    for k, w in enumerate(where):
        if w in number:
            out.append((k, 0, lengths[k], number[w], fill[number[w]]))
            fill[number[w]] += lengths[k]
        else:
            loose.append(k)
    at = 0
    for k in loose:
        start = 0
        while start < lengths[k]:
            while fill[at] == window:
                at += 1
            n = min(lengths[k] - start, window - fill[at])
            out.append((k, start, n, at, fill[at]))
            fill[at] += n
            start += n
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 1024, separator: int = 0, group: int = 65_536,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) that tile all sequences of at most ``window`` ids.

    ``ids`` holds the piece as little-endian unsigned 32-bit integers; ``offset`` is its place in the sequence, gapless from 0.
    Sequence numbers are unique and carry the partition in their upper bits. An empty or null text is its separator alone;
    a null doc_id stays null; repeated rows are packed each; an empty table gives no pieces. Tokenizer: path of a byte-level
    BPE file on the driver.
    """
    spec = shared_file(docs.sparkSession, tokenizer or tokenizer_file("byte_bpe_50k.json"))
    stop = np.asarray([separator], "<u4")

    def work(batches):
        encoder = byte_encoder(spec.value)
        base = TaskContext.get().partitionId() << 40
        rest: list[tuple] = []

        def out(rows):
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                              names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def close():
            nonlocal base, rest
            done, last = [], -1
            for k, start, n, w, offset in placed([len(x[3]) for x in rest], window):
                doc, at, tokens, ids = rest[k]
                done.append((doc, at + start, n, tokens, base + w, offset, ids[start:start + n].tobytes()))
                last = max(last, w)
            base, rest = base + last + 1, []
            return done

        for whole in batches:
            for batch in slices(whole, 1):
                full = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.concatenate([encoder.encode(text), stop])
                    cut = len(ids) - len(ids) % window
                    for a in range(0, cut, window):
                        full.append((doc, a, window, len(ids), base, 0, ids[a:a + window].tobytes()))
                        base += 1
                    if cut < len(ids):
                        rest.append((doc, cut, len(ids), ids[cut:]))
                if full:
                    yield out(full)
                if len(rest) >= group:
                    yield out(close())
        if rest:
            yield out(close())

    return texts(docs, id_col, text_col).mapInArrow(work, SCHEMA)
