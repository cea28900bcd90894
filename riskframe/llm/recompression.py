"""Removal of long passages that an earlier document has, found by recompression.

Recompression shortens all texts alike: in every level, runs of one symbol become a symbol, then neighbours a, b whose
coins show left and right. A name is a hash of what the symbol stands for, so it is the same in every document and
task, and a passage that occurs twice is cut into the same symbols but near its ends. How near is known for every symbol: the
words that decide about it, its ``reach``. After LEVELS levels Spark names the symbols globally: those that only one document has cannot lie
in a repeat, so no repeated window holds their reach. What is left between them are the candidate stretches: maximal runs of windows in which
every symbol is shared. Windows too plain for a symbol of their own, such as one word over and over, are always candidates.

The shared stretches are then verified by their words: equal stretches meet as a whole, so a group of copies costs one row each, and only
one document a stretch lays out its windows, which are compared by 128-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import HOT_SHARE, checkpointed, hot_keys, lookup, slices

LEVELS = 7  # symbols of 7 or 8 words on average, decided by about 20
SAMPLE = 64  # one document in SAMPLE tells which symbols are very common; this only balances the work
COMMON = 100  # and so many of the sample's rows at least
LAST = 2**63 - 1  # the place of a document without an id: after all others
FAR = np.int64(2**40)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def named(x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
    """Names for pairs of symbols, or of a symbol and how often it stands."""
    out = mix(x * np.uint64(0x9E3779B97F4A7C15) + mix(y + np.uint64(level)))
    return np.where(out == 0, np.uint64(1), out)


def shorter(name: np.ndarray, lo: np.ndarray, a: np.ndarray, b: np.ndarray, word: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    """One level: runs, then pairs. name 0 stands at both ends and between documents; lo is a symbol's first word, [a, b) its reach.

    That a symbol is not part of a longer run shows by the word next to it, if that differs from the word with which the symbol would go
    on; else by its whole neighbour.
    """
    s, e = np.arange(len(name)), np.arange(1, len(name) + 1)
    again = (name[1:] == name[:-1]) & (name[1:] != 0)
    if again.any():
        s = np.flatnonzero(np.append(True, ~again))
        e = np.append(s[1:], len(name))
    real = np.flatnonzero(name[s])
    x, y = lo[s[real]], np.append(lo, lo[-1] + 1)[e[real]]  # the words of the symbol or run are x .. y - 1
    z = np.append(lo, 0)[s[real] + 1]  # the end of its first symbol
    na, nb = (np.minimum.reduceat(a, s), np.maximum.reduceat(b, s)) if len(s) < len(name) else (a.copy(), b.copy())
    na[real] = np.minimum(na[real], np.where(word[x - 1] != word[z - 1], x - 1, a[s[real] - 1]))
    nb[real] = np.maximum(nb[real], np.where(word[y] != word[x], y + 1, b[np.minimum(e[real], len(b) - 1)]))
    run = np.flatnonzero(e - s > 1)
    new = name[s]
    new[run] = named(name[s[run]], (e - s)[run].astype(np.uint64), level)
    name, lo, a, b = new, lo[s], na, nb
    right = (mix(name ^ np.uint64(0x5851F42D4C957F2D * (2 * level + 1) % 2**64)) >> np.uint64(17)) & np.uint64(1) == 1
    real = name != 0
    left = real & ~right
    right &= real
    p = np.flatnonzero(left[:-1] & right[1:])
    alone = real.copy()
    alone[p] = alone[p + 1] = False
    # a left symbol stays alone for what follows it, a right one for what stands before
    alone = np.flatnonzero(alone)
    other = alone + np.where(left[alone], 1, -1)
    na, nb = a.copy(), b.copy()
    na[alone], nb[alone] = np.minimum(a[alone], a[other]), np.maximum(b[alone], b[other])
    na[p], nb[p] = np.minimum(a[p], a[p + 1]), np.maximum(b[p], b[p + 1])
    new = name.copy()
    new[p] = named(name[p], name[p + 1], level)
    keep = np.ones(len(name), bool)
    keep[p + 1] = False
    return new[keep], lo[keep], na[keep], nb[keep]


def marks(docs: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, name, place) of the symbols that cut windows, and of the stretches without any (name 0).

    For a symbol with reach [a, b), ``place`` packs the reach's start of the symbol before it, how far its own start is from there, and how far the
    end of the symbol after it: windows that start after the first and end before the last hold no other symbol's reach.
    Stretches are the windows that hold no reach at all. Documents shorter than a window have no windows and no rows.
    """
    size = np.array([len(d) for d in docs], np.int64)
    base = np.cumsum(np.append(1, size[:-1] + 1))  # where a document starts; a zero stands before it
    name = np.zeros(size.sum() + len(docs) + 1, np.uint64)
    for at, words in zip(base.tolist(), docs, strict=True):
        name[at:at + len(words)] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) | np.uint64(1)
    word, lo = name, np.arange(len(name))
    a, b = np.where(name == 0, -FAR, lo), np.where(name == 0, FAR, lo + 1)
    for level in range(LEVELS):
        name, lo, a, b = shorter(name, lo, a, b, word, level)
    of = np.cumsum(name == 0) - 1  # the zero before a document has its number
    out = []
    real = np.flatnonzero(name)
    of, name, a, b = of[real], name[real], a[real], b[real]
    begin, end = base[of], (base + size)[of]
    inside = (a >= begin) & (b <= end)
    of, name, a, b = of[inside], name[inside], a[inside] - begin[inside], b[inside] - begin[inside]
    first = np.searchsorted(of, np.arange(len(docs)))
    last = np.searchsorted(of, np.arange(len(docs)), side="right")
    for k in np.flatnonzero(size >= window).tolist():
        i, j, n = first[k], last[k], int(size[k])
        A = np.minimum.accumulate(a[i:j][::-1])[::-1]  # widened so that both ends ascend
        B = np.maximum.accumulate(b[i:j])
        use = np.flatnonzero(B - A <= window)
        use = use[np.append(True, np.diff(A[use]) > 0)] if len(use) else use
        A, B, own = A[use], B[use], name[i:j][use]
        begins, ends = np.append(-1, A), np.append(B, n + 1)  # of the symbol before and of the one after each gap
        gap = np.flatnonzero(ends - begins > window + 1)
        before = np.where(ends[:-1] - begins[:-1] > window + 1, ends[:-1] - window - 1, begins[:-1])
        after = np.where(ends[1:] - begins[1:] > window + 1, begins[1:] + window + 1, ends[1:])
        out.append((np.full(len(use), k), own, (before + 1) << 20 | (A - before) << 10 | (after - before)))
        for g in gap.tolist():  # windows from begins + 1 to ends - window - 1, in pieces that fit the packing
            x, y = int(begins[g]), int(ends[g])
            starts = np.arange(x, y - window - 1, 512)
            stops = np.minimum(starts + 512 + window + 1, y)
            out.append((np.full(len(starts), k), np.zeros(len(starts), np.uint64), (starts + 1) << 20 | 1023 << 10 | (stops - starts)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def stretches(places: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(first window, last window + 1) of the maximal runs of candidate windows, from the places of shared symbols."""
    if not len(places):
        return []
    before, own, after = (places >> 20) - 1, places >> 10 & 1023, places & 1023
    first, end = before + 1, before + after - window  # windows first .. end - 1
    plain = own == 1023
    order = np.lexsort((first, plain))
    before, own, first, end, plain = before[order], (before + own)[order], first[order], end[order], plain[order]
    # symbols next to each other: their windows hold both
    go_on = np.append(False, (before[1:] == own[:-1]) & ~plain[1:])
    head = np.flatnonzero(~go_on)
    first, end = first[head], np.maximum.reduceat(end, head)
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    use = end > first
    first, end = first[use], end[use]
    if not len(first):
        return []
    head = np.append(0, np.flatnonzero(first[1:] > end[:-1]) + 1)
    return list(zip(first[head].tolist(), np.maximum.reduceat(end, head).tolist(), strict=True))


def _window_hashes(words: list[bytes], first: int, end: int, window: int) -> np.ndarray:
    """Two 64-bit halves of the hash of every window from first on, before end."""
    here = words[first:end + window - 1]
    joined = b" ".join(here)
    stop = np.cumsum(np.fromiter(map(len, here), np.int64, len(here)) + 1) - 1
    start = np.append(0, stop[:-1] + 1)
    h = xxhash.xxh3_128_digest
    raw = b"".join([h(joined[i:j]) for i, j in zip(start[:end - first].tolist(), stop[window - 1:].tolist(), strict=True)])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _windows_of(batches, window: int):
    """(k1, k2, doc, h, s1, w): the hash of every window of the packed stretches (doc, h, s1, z); stretches are short, many of them make a batch."""

    def out():
        keys, n = np.concatenate([x[0] for x in held]), [len(x[0]) for x in held]
        of = [np.repeat(np.array([x[k] for x in held], np.int64), n) for k in (1, 2, 3)]
        w = np.concatenate([np.arange(x[4], x[4] + len(x[0])) for x in held])
        columns = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]), *of, w
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["k1", "k2", "doc", "h", "s1", "w"])

    unpack, held, rows = zstandard.ZstdDecompressor().decompress, [], 0
    for batch in batches:
        for doc, h, s1, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = unpack(z).split()
            total = len(words) - window + 1
            for first in range(0, total, 32_768):
                held.append((_window_hashes(words, first, min(first + 32_768, total), window), doc, h, s1, first))
                rows += len(held[-1][0])
                if rows >= 32_768:
                    yield out()
                    held, rows = [], 0
    if held:
        yield out()


def _spread(rows: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Adds ``common`` and ``slot``: rows of common keys are dealt by their document, all others by the key."""
    tagged = rows.withColumn("common", F.lit(False)) if hot is None else rows.join(
        F.broadcast(hot.withColumn("common", F.lit(True))), keys, "left").withColumn("common", F.coalesce("common", F.lit(False)))
    return tagged.withColumn("slot", F.when(F.col("common"), F.xxhash64("doc", "h")).otherwise(F.col(keys[0])))


def removed(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, ranges) per row: the text without every word that a repeated window covers.

    Words are what ASCII white space separates, unchanged. A window is ``window`` words in a row; it is repeated if the same
    words also start in a document with a smaller id. Windows are judged on the texts as given. ``ranges`` are the
    removed [from, to) of word numbers, ascending; ``kept_sha256`` is the digest of the other words, joined by spaces, in UTF-8. Null texts have no words. A row without an
    id comes after all others: it loses what it shares with them and takes nothing. Rows of one id do not take
    from each other; repeated rows give equal rows. An empty table gives no rows.
    """
    if not 1 < window <= 400:
        raise ValueError("windows have 2 to 400 words")
    given = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    given = given.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("h"), "text")

    def name_symbols(batches):
        for whole in batches:
            for batch in slices(whole, 2, 4_000_000):
                doc, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                first = np.unique(np.stack([doc, h]), axis=1, return_index=True)[1]  # repeated rows say the same
                texts = batch.column(2).take(pa.array(first)).to_pylist()
                of, name, place = marks([x.encode("utf-8", "replace").split() for x in texts], window)
                row = first[of]
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(doc[row]), pa.array(h[row]), pa.array(place)],
                                                 names=["name", "doc", "h", "place"])

    def symbols(of: DataFrame) -> DataFrame:
        return of.select("doc", "h", "text").mapInArrow(name_symbols, "name long, doc long, h long, place long")

    # symbols that a sample already proves to be shared, and very common
    some = checkpointed(symbols(given.where(F.pmod(F.col("h"), F.lit(SAMPLE)) == 0)).where("name != 0").groupBy("name").agg(
        F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")))
    total = some.agg(F.sum("n")).first()[0] or 0
    hot = some.where((F.col("n") > max(total / HOT_SHARE, COMMON)) & (F.col("lo") < F.col("hi"))).select("name")
    rows = _spread(symbols(given), ["name"], None if hot.isEmpty() else hot)
    rows = rows.withColumn("common", F.col("common") | (F.col("name") == 0)).withColumn("slot", F.when(F.col("common"), F.xxhash64("doc", "h")).otherwise(F.col("slot")))
    group = Window.partitionBy("slot", "name")
    shared = (rows.repartition("slot").withColumns({"lo": F.min("doc").over(group), "hi": F.max("doc").over(group)})
              .where("common OR lo < hi").groupBy("doc", "h").agg(F.collect_set("place").alias("places")))

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in slices(whole, 3):
                n, sha, z = [], [], []
                for x in batch.column(3).to_pylist():
                    words = x.encode("utf-8", "replace").split()
                    kept = b" ".join(words)
                    n.append(len(words))
                    sha.append(hashlib.sha256(kept).digest())
                    z.append(squeeze(kept) if len(words) >= window else None)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(z, pa.binary())],
                                                 names=["doc_id", "doc", "h", "n_words", "sha", "z"])

    def find(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for batch in slices(whole, 5, 500_000):
                out, texts = [], batch.column(5).to_pylist()
                for z, places in zip(texts, batch.column(6).to_pylist(), strict=True):
                    spans = stretches(np.array(places, np.int64), window) if places else []
                    words = unpack(z).split() if spans else []
                    keys = [np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words[first:end + window - 1])), np.int64).tolist() for first, end in spans]
                    out.append([[*k, *span] for k, span in zip(keys, spans, strict=True)])
                z = pa.array([z if x else None for z, x in zip(texts, out, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], z, pa.array(out, pa.list_(pa.list_(pa.int64())))],
                                                 names=["doc_id", "doc", "h", "n_words", "sha", "z", "spans"])

    # from here on only documents with a candidate stretch carry their text
    packed = given.mapInArrow(pack, "doc_id long, doc long, h long, n_words long, sha binary, z binary").join(shared, ["doc", "h"], "left")
    base = checkpointed(packed.select("doc_id", "doc", "h", "n_words", "sha", "z", "places").mapInArrow(
        find, "doc_id long, doc long, h long, n_words long, sha binary, z binary, spans array<array<long>>"))
    span = lambda k, name: F.col("span")[k].alias(name)
    found = checkpointed(base.select("doc", "h", F.explode("spans").alias("span")).select(
        span(0, "s1"), span(1, "s2"), "doc", "h", span(2, "first"), span(3, "end")).distinct())
    found = found.withColumn("s", F.struct("s1", "s2"))
    classes = checkpointed(found.groupBy("s").agg(F.min(F.struct("doc", "h", "first")).alias("lead"), F.count("*").alias("n")))
    placed = lookup(found, classes, "s", hot_keys(classes, "s", "n", found.count()))
    # a stretch that an earlier document has as a whole goes as a whole; of the others one a class lays out its windows
    gone = placed.where("doc > lead.doc").select("doc", "h", F.array(F.struct("first", (F.col("end") + window - 1).alias("to"))).alias("r"))
    own = placed.where("doc = lead.doc")
    leads = own.where("h = lead.h AND first = lead.first").groupBy("doc", "h").agg(F.collect_set(F.struct("first", "end", "s1")).alias("spans"))

    def trim(batches):
        unpack, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in slices(whole, 2, 500_000):
                out = []
                for doc, h, z, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words = unpack(z).split()
                    out += [(doc, h, x["s1"], squeeze(b" ".join(words[x["first"]:x["end"] + window - 1]))) for x in spans]
                names, kinds = ["doc", "h", "s1", "z"], [pa.int64()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=names)

    def lay_out(batches):
        return _windows_of(batches, window)

    lead_texts = checkpointed(base.where("z IS NOT NULL").select("doc", "h", "z").join(leads, ["doc", "h"]).mapInArrow(
        trim, "doc long, h long, s1 long, z binary"))
    windows = lambda of: of.mapInArrow(lay_out, "k1 long, k2 long, doc long, h long, s1 long, w long")
    some = checkpointed(windows(lead_texts.where(F.pmod(F.col("h"), F.lit(SAMPLE)) == 0)).groupBy("k1").agg(F.count("*").alias("n")))
    total = some.agg(F.sum("n")).first()[0] or 0
    hot = some.where(F.col("n") > max(total / HOT_SHARE, COMMON)).select("k1")
    rows = windows(lead_texts)
    if hot.isEmpty():
        group = Window.partitionBy("k1", "k2")
        late = rows.repartition("k1").withColumn("lo", F.min("doc").over(group)).where("doc > lo")
    else:  # the least documents of the common windows are found beforehand; a task tells one for each window and batch
        common = np.array(sorted(r[0] for r in hot.collect()), np.int64)  # HOT_SHARE at most

        def least_of(batches):
            hint = np.zeros(65_536, bool)  # by the last bits of the common ones
            hint[common & 65_535] = True
            for batch in lay_out(batches):
                key = batch.column(0).to_numpy()
                at = np.flatnonzero(hint[key & 65_535])
                at = at[np.isin(key[at], common)]
                if not len(at):
                    continue
                few = batch.take(pa.array(at)).select(["k1", "k2", "doc"])
                yield from pa.Table.from_batches([few]).group_by(["k1", "k2"]).aggregate([("doc", "min")]).rename_columns(["k1", "k2", "doc"]).to_batches()

        least = checkpointed(lead_texts.mapInArrow(least_of, "k1 long, k2 long, doc long").groupBy("k1", "k2").agg(F.min("doc").alias("known")))
        rows = _spread(rows, ["k1"], hot).join(F.broadcast(least), ["k1", "k2"], "left")  # 128-bit hashes for HOT_SHARE 64-bit ones
        group = Window.partitionBy("slot", "k1", "k2")
        late = rows.repartition("slot").withColumn("lo", F.coalesce("known", F.min("doc").over(group))).where("doc > lo")
    late = late.groupBy("doc", "s1").agg(F.collect_list("w").alias("ws"))
    partly = own.select("doc", "h", "first", "s1").join(late, ["doc", "s1"]).select(
        "doc", "h", F.transform("ws", lambda w: F.struct((F.col("first") + w).alias("first"), (F.col("first") + w + window).alias("to"))).alias("r"))
    ranges = gone.unionByName(partly).groupBy("doc", "h").agg(F.flatten(F.collect_list("r")).alias("ranges"))

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for batch in slices(whole, 2, 500_000):
                out = []
                for z, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    out.append(None if ranges is None else _without(unpack(z).split(), [(r["first"], r["to"]) for r in ranges]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([o and o[0] for o in out], pa.int64()), batch.column(4),
                     pa.array([o and bytes.fromhex(o[1]) for o in out], pa.binary()), pa.array([o and o[2] for o in out], pa.list_(pa.list_(pa.int64())))],
                    names=["doc_id", "n_words", "n_removed", "sha", "cut_sha", "ranges"])

    joined = base.join(ranges, ["doc", "h"], "left").select("doc_id", "n_words", "z", "ranges", "sha")
    done = joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, sha binary, cut_sha binary, ranges array<array<long>>")
    return done.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.lower(F.hex(F.coalesce("cut_sha", "sha"))).alias("kept_sha256"),
                       F.coalesce("ranges", F.array().cast("array<array<long>>")).alias("ranges"))


def _without(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, str, list[list[int]]]:
    """How many words go, the digest of the others, and the merged ranges."""
    ranges: list[list[int]] = []
    for a, b in sorted(spans):
        if ranges and a <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], b)
        else:
            ranges.append([a, b])
    kept, at = [], 0
    for a, b in ranges:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), ranges
