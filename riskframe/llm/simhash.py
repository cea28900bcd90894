"""SimHash fingerprints and near-duplicate groups by exact tiled comparison of the fingerprints.

A fingerprint is one 64-bit word, or two (the second with another hash seed). Pairs within the radius are found by
pigeonhole: the first word is cut into ``blocks``; a pair that differs in at most ``blocks - 2`` bits of it agrees on two
blocks at least, so every pair of blocks gives a table of buckets, and within a bucket all fingerprints are compared: short
buckets by shifting the sorted rows against each other, long ones tile by tile with exclusive-or and bit counts, where
tiles are sorted by population count and pairs of tiles that cannot come within the radius are left out. Very large buckets are
split into pairs of sub-blocks that different tasks compare. A task reports a spanning forest of what it found, never all pairs.

No pigeonhole reaches the wide radius that near copies at a Jaccard of 0.8 need, so their 256-bit fingerprints are looked up in tables that
each name a bucket by a few of the bits (see ``sampled_bits``); what shares a bucket is compared bit by bit, and what is near then by its shingles.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import (
    checkpointed,
    components,
    hot_keys,
    least_member,
    local_components,
    lookup,
    runs,
    slices,
    texts,
    whole_runs,
)

SEEDS = (42, 43)  # seeds of the first and the second word
TILE = 256
SHORT = 48  # runs up to this length are compared by shifting
WIDE = 4  # words of the fingerprints that near copies are found by
SHIFTS = np.array([w * 0x9E3779B97F4A7C15 % 2**64 for w in range(WIDE)], np.uint64)
BITS = 8  # bits that name a bucket, of tables with up to 2**BITS * FULL rows
FULL = 8192  # rows of an average bucket at most; a table of more rows takes more bits, and then there are more tables
FIRST = 4  # tables whose links are merged before the others are looked at
BANDS, ROWS = 32, 4  # keys by least hashes: a set has BANDS of them, each made of ROWS least hashes


def shingle_spans(text: str, words: int) -> tuple[bytes, list[int], list[int]]:
    """The words (A-Z lowered, split at ASCII white space) joined by spaces, and where each shingle starts and ends."""
    parts = text.encode("utf-8", "replace").lower().split()
    joined = b" ".join(parts)
    if not parts:
        return b"", [], []
    if len(parts) <= words:
        return joined, [0], [len(joined)]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    return joined, starts[:len(parts) - words + 1].tolist(), ends[words - 1:].tolist()


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    joined, starts, ends = shingle_spans(text, words)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k:k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint of WIDE words: the first from the hashes, the others from hashes of these."""
    counts = np.zeros(64 * WIDE, np.int64)
    for k in range(0, len(hashes), 255):  # counts of a part fit in a byte
        part = hashes[k:k + 255, None] + SHIFTS
        x = part[:, 1:]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        np.bitwise_xor(x, x >> np.uint64(31), out=part[:, 1:])
        counts += np.unpackbits(part.view(np.uint8).ravel()).reshape(-1, 64 * WIDE).sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes)).view(np.uint64)


def sampled_bits(rows: int, seed: int = 7) -> list[tuple[int, int]]:
    """(word, mask) for each table: its buckets are named by the bits of the mask in that word of the fingerprint.

    The bits of a word are dealt to tables at random, again and again, so tables of one deal share no bit. Two sets of Jaccard similarity 0.8
    differ in 15 % of the bits; with 8 bits a bucket and 64 tables they share none with probability 1.3 in a million.
    """
    bits = max(BITS, math.ceil(math.log2(max(rows, 1) / FULL)))
    rng, out = np.random.default_rng(seed), []
    while len(out) < 16 * (bits - 4):
        deal = [rng.permutation(64) for _ in range(WIDE)]
        for k in range(0, 64 - bits + 1, bits):
            out += [(w, sum(1 << b for b in deal[w][k:k + bits].tolist())) for w in range(WIDE)]
    return out[:16 * (bits - 4)]


def table_keys(tables: list[tuple[int, int]], start: int = 0) -> Column:
    """The buckets of a fingerprint, one for each table; 32 bits of a hash, as a chance meeting only costs a comparison."""
    signed = [(w, int(np.uint64(m).view(np.int64))) for w, m in tables]
    return F.array(*[F.shiftrightunsigned(F.xxhash64(F.lit(k), F.col(f"f{w}").bitwiseAND(F.lit(m))), 32) for k, (w, m) in enumerate(signed, start)])


def _orders(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets that order 32-bit hashes anew, once for each least hash."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, BANDS * ROWS, np.uint32)


FACTORS, OFFSETS = _orders()


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: sets of Jaccard similarity s have equal keys of a band with probability s ** ROWS. The operators do not use them."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 512):
        np.minimum(least, (short[k:k + 512, None] * FACTORS + OFFSETS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f0 long, f1 long) for every row; f1 is 0 with one word. Texts are read whole; null and empty texts give 0."""
    seeds = SEEDS[:words]

    def work(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                out = np.zeros((2, batch.num_rows), np.uint64)
                for k, text in enumerate(batch.column(1).to_pylist()):
                    for w, seed in enumerate(seeds):
                        out[w, k] = simhash(shingle_hashes(text, shingle, seed))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64))],
                                                 names=["doc_id", "f0", "f1"])

    return texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, f0 long, f1 long")


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits of the first two words (the last axis) differ."""
    gap = np.bitwise_count(x[..., 0] ^ y[..., 0])
    if x.shape[-1] > 1:
        gap += np.bitwise_count(x[..., 1] ^ y[..., 1])
    return gap


def _near(f: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of rows that all words leave within the radius."""
    if f.shape[1] > 2 and len(i):
        near = np.bitwise_count(f[i] ^ f[j]).sum(axis=1) <= radius
        i, j = i[near], j[near]
    return i, j


def _close_in_tiles(f: np.ndarray, radius: int, begin: int) -> np.ndarray:
    """Least connected index of the rows of f (n, words) within a total radius; see close_rows."""
    pop = np.bitwise_count(f[:, 0])
    order = np.argsort(pop, kind="stable")
    f, pop, n = np.asfortranarray(f[order]), pop[order].astype(np.int64), len(f)
    lab = np.arange(n)
    for a in range(0, n, TILE):
        for b in range(a, n, TILE):
            if pop[b] - pop[min(a + TILE, n) - 1] > radius:
                break
            i, j = np.nonzero(_differing(f[a:a + TILE, None], f[None, b:b + TILE]) <= begin)
            lab = local_components(n, *_near(f, a + i, b + j, radius), lab)
    out = np.empty(n, np.int64)
    out[order] = order[lab]
    return out


def close_rows(key: np.ndarray, f: np.ndarray, radius: int, begin: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect, within each run of equal keys, all rows within the radius of each other.

    ``begin``: with more than two words, how many bits of the first two may differ, the radius by default; the others are only compared then.
    """
    begin = radius if begin is None else begin
    starts, ends = runs(key)
    size = ends - starts
    found_i, found_j = [], []
    for a, b in zip(starts[size > SHORT].tolist(), ends[size > SHORT].tolist(), strict=True):
        lab = _close_in_tiles(f[a:b], radius, begin)
        member = np.flatnonzero(lab != np.arange(b - a))
        found_i.append(a + lab[member])
        found_j.append(a + member)
    left = np.repeat(np.where(size > SHORT, 0, ends), size) - np.arange(len(key))  # rows of the run from here on
    at = np.flatnonzero(left > 1)
    d = 1
    while len(at):
        near = at[_differing(f[at], f[at + d]) <= begin]
        near, other = _near(f, near, near + d, radius)
        found_i.append(near)
        found_j.append(other)
        d += 1
        at = at[left[at] > d]
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def block_masks(blocks: int) -> tuple[list[int], list[int]]:
    """Masks of the first word for every pair of blocks: of pairs that share no block, and of all others."""
    cut = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:], strict=False)]
    apart = [(k, k + 1) for k in range(0, blocks - 1, 2)]
    mask = lambda pair: int(np.uint64(block[pair[0]] | block[pair[1]]).view(np.int64))
    return [mask(x) for x in apart], [mask(x) for x in combinations(range(blocks), 2) if x not in apart]


def mask_keys(masks: list[int]) -> Column:
    return F.array(*[F.xxhash64(F.lit(m), F.col("f0").bitwiseAND(F.lit(m))) for m in masks])


def _buckets(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows with ``bucket``, of which the large ones are split into pairs of sub-blocks."""
    large = checkpointed(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows))
    if large.isEmpty():
        return rows
    names = [c for c in rows.columns if c != "bucket"]
    parts = F.ceil(F.col("n") / bucket_rows).cast("int")
    own = F.pmod(F.xxhash64("f1", "f0"), parts).cast("int")
    split = (rows.join(large, "bucket").select("bucket", *names, own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
             .select(*names, F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket")))
    return rows.join(large, "bucket", "left_anti").select(*names, "bucket").unionAll(split)


def hamming_links(prints: DataFrame, keys: Column, radius: int, words: int = 1, bucket_rows: int = 4096) -> DataFrame:
    """(a, b): nodes that connect all fingerprints (f0, f1, node) within the radius that share one of the keys, an array of prints.

    Fingerprints of one node are connected already, and nothing is said of them.
    """
    rows = _buckets(prints.select("f0", "f1", "node", F.explode(keys).alias("bucket")), bucket_rows)

    def work(batches):
        for group in whole_runs(batches, 3):
            key, node = group.column(3).to_numpy(), group.column(2).to_numpy()
            f = np.stack([group.column(w).to_numpy().view(np.uint64) for w in range(words)], axis=1)
            i, j = close_rows(key, f, radius)
            again = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] == node[:-1]))
            lab = local_components(len(key), np.concatenate([i, again]), np.concatenate([j, again + 1]))
            first = np.ones(len(key), bool)
            first[again + 1] = False
            member = np.flatnonzero(first & (node[lab] != node))
            if len(member):
                yield pa.RecordBatch.from_arrays([pa.array(node[lab[member]]), pa.array(node[member])], names=["a", "b"])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(work, "a long, b long")


def linked(prints: DataFrame, radius: int, blocks: int, words: int = 1, bucket_rows: int = 4096) -> DataFrame:
    """(node, root) for the ids of distinct fingerprints (id, f0, f1) that are linked to others, directly or not.

    Exact if ``blocks - 2 >= radius``; with a larger radius (two words) pairs are missed that agree on fewer than two
    blocks of the first word. The few tables of disjoint pairs of blocks come first.
    """
    some, others = block_masks(blocks)
    return _linked_by(prints, mask_keys(some), mask_keys(others), radius, words, bucket_rows)


def _linked_by(prints: DataFrame, some: Column, others: Column, radius: int, words: int, bucket_rows: int) -> DataFrame:
    """The links of the keys ``some`` come first; the others only have to tell of links between what those left apart, so a
    large group of near copies is not reported once a table.
    """
    prints = prints.withColumnRenamed("id", "node")
    first = components(hamming_links(prints, some, radius, words, bucket_rows))
    merged = prints.join(first, "node", "left").withColumn("node", F.coalesce("root", "node")).drop("root")
    second = components(hamming_links(merged, others, radius, words, bucket_rows)).select(F.col("node").alias("root"), F.col("root").alias("to"))
    everyone = first.unionAll(second.select(F.col("root").alias("node"), F.col("root").alias("root")).join(first.select("node"), "node", "left_anti"))
    sizes = everyone.groupBy("root").agg(F.count("*").alias("n"))
    return checkpointed(lookup(everyone, second, "root", hot_keys(sizes, "root", "n", everyone.count())).select("node", F.coalesce("to", "root").alias("root")))


def hex_print(word: str = "f0") -> Column:
    return F.lower(F.lpad(F.hex(word), 16, "0"))


def groups(docs: DataFrame, shingle: int = 4, radius: int = 4, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs: the class of every document by 64-bit fingerprints.

    Documents link if their fingerprints differ in at most ``radius`` bits (``blocks`` must exceed it by two); a component is what
    links reach, named by its least doc_id. Null and empty texts have fingerprint zero and link like any other. Rows with
    a null doc_id take part and never name a component unless it has no other id; repeated rows are kept.
    """
    if blocks - 2 < radius:
        raise ValueError("blocks must be radius + 2 at least, or pairs would be missed")
    prints = checkpointed(fingerprints(docs, shingle, 1, id_col, text_col))
    classes = checkpointed(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
                           .withColumn("id", F.monotonically_increasing_id()))
    members = classes.select(F.col("id").alias("node"), "least_id")
    far = least_member(linked(classes, radius, blocks), members, "least_id").select(F.col("node").alias("id"), F.col("least").alias("_linked"))
    names = classes.join(far, "id", "left").select("f0", F.coalesce("_linked", "least_id").alias("component_id"))
    hot = hot_keys(classes, "f0", "n", prints.count())
    return lookup(prints.select("doc_id", "f0", hex_print().alias("fingerprint")), names, "f0", hot).select(
        "doc_id", "fingerprint", "component_id")


# ---- near copies with a check of the shingles --------------------------------------------------

CELL = 512  # texts of a side that are compared with each other in one go


def similar_sets(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, similarity: float,
                 labels: np.ndarray | None = None) -> np.ndarray:
    """Least connected index of each set, by links of Jaccard similarity; pairs that are connected already are not compared.

    ``left`` and ``right`` index the sets of two sides; without right, pairs within left. labels: what earlier links gave.
    """
    n, size = len(sets), np.array([len(s) for s in sets])
    lab = np.arange(n) if labels is None else labels
    own = right is None
    others = left if own else right
    others = others[np.argsort(size[others], kind="stable")]
    todo = others if own else left[np.argsort(size[left], kind="stable")]
    for i in todo.tolist():
        a = np.searchsorted(size[others], np.ceil(similarity * size[i])) if not own else np.searchsorted(size[others], size[i])
        b = np.searchsorted(size[others], np.floor(size[i] / similarity), side="right")
        near = others[a:b]
        near = near[(lab[near] != lab[i]) & (near != i)]
        if not len(near):
            continue
        mine, flat = sets[i], np.concatenate([sets[j] for j in near.tolist()])
        hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        ends = np.cumsum(size[near])
        total = np.concatenate([[0], np.cumsum(hit)])
        common = total[ends] - total[ends - size[near]]
        near = near[common >= similarity * (size[i] + size[near] - common) - 1e-9]
        lab = local_components(n, np.full(len(near), i), near, lab)
    return lab


def near_clusters(prints: DataFrame, keys: Column, radius: int, begin: int, bucket_rows: int = 2 * FULL) -> DataFrame:
    """(cluster, id): the rows (id, node, f0, f1 ..) of the nodes that fingerprints within the radius connect inside buckets, over all tables.

    At most ``begin`` bits of the first two words may differ. A null node is the row's id. Buckets only tell which nodes meet, so an id is in one
    cluster, however many buckets find it; nodes that meet no other are in none.
    """
    words = [f"f{w}" for w in range(WIDE)]
    rows = _buckets(prints.select(*words, F.coalesce("node", "id").alias("node"), F.explode(keys).alias("bucket")), bucket_rows)

    def work(batches):
        for group in whole_runs(batches, WIDE + 1):
            key, node = group.column(WIDE + 1).to_numpy(), group.column(WIDE).to_numpy()
            f = np.stack([group.column(w).to_numpy().view(np.uint64) for w in range(WIDE)], axis=1)
            lab = local_components(len(key), *close_rows(key, f, radius, begin))
            met = np.unique(np.stack([lab, node], axis=1), axis=0)
            starts, ends = runs(met[:, 0])
            lead = np.repeat(met[starts, 1], ends - starts)
            other = met[:, 1] != lead
            if other.any():
                edges = np.unique(np.stack([lead[other], met[other, 1]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    met = components(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, "a long, b long"))
    met = met.select("node", F.col("root").alias("cluster"))
    alone = prints.where("node IS NULL").select("id", F.col("id").alias("node")).join(met, "node")
    merged = prints.where("node IS NOT NULL").select("id", "node")
    sizes = checkpointed(merged.groupBy("node").agg(F.count("*").alias("n")))
    hot = hot_keys(sizes, "node", "n", sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return alone.unionByName(lookup(merged, met, "node", hot).where("cluster IS NOT NULL")).select("cluster", "id")


def _linked_texts(suspects: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): nodes that connect all similar texts within a cluster of n. suspects: (id, cluster, n, text, node).

    Texts of one node are connected already, and are not compared.
    """
    parts = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")

    def shingles(batches):
        for whole in batches:
            for batch in slices(whole, 3):
                sets = [np.unique(shingle_hashes(x, shingle, SEEDS[0])).tobytes() for x in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary()), batch.column(4)], names=["id", "cluster", "n", "set", "node"])

    rows = suspects.select("id", "cluster", "n", "text", "node").mapInArrow(shingles, "id long, cluster long, n long, set binary, node long")
    rows = (rows.select("id", "set", "node", "cluster", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
            .select(F.concat_ws("/", "cluster", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "id", "set",
                    (F.col("own") > F.col("other")).alias("second"), (F.col("own") == F.col("other")).alias("inner"), "node"))

    def work(batches):
        for group in whole_runs(batches, 0):
            for cell in pa.compute.unique(group.column(0)).to_pylist():
                here = group.filter(pa.compute.equal(group.column(0), cell)) if group.num_rows > 1 else group
                names, first = np.unique(here.column(1).to_numpy(), return_index=True)
                sets = [np.frombuffer(x, np.uint64) for x in here.column(2).take(pa.array(first)).to_pylist()]
                second = here.column(3).to_numpy(zero_copy_only=False)[first]
                inner = here.column(4).to_numpy(zero_copy_only=False)[first]
                node = here.column(5).to_numpy()[first]
                left, right = (np.arange(len(names)), None) if inner.all() else (np.flatnonzero(~second), np.flatnonzero(second))
                lead, of = np.unique(node, return_index=True, return_inverse=True)[1:]
                lab = similar_sets(sets, left, right, similarity, lead[of])
                edges = np.unique(np.stack([node[lab], node], axis=1), axis=0)
                edges = edges[edges[:, 0] != edges[:, 1]]
                if len(edges):
                    yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(work, "a long, b long")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 76, begin: int = 44,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, with one document of each group of near copies: the one with the least id.

    Candidates are found by 256-bit SimHash fingerprints of their different word shingles: they share a bucket of one of the tables (see
    ``sampled_bits``) and differ in ``radius`` bits at most, ``begin`` of them in the first half. At a Jaccard of 0.8 about 1 in a million
    pairs do not (1 in 100,000 for sets of 4 and 5 shingles). The candidates that fingerprints connect, over all tables, are a cluster and are compared
    shingle by shingle: two texts link if their sets reach the Jaccard ``similarity``, and a group is what links reach. The first tables come first; the others only look at what these left apart.
    Equal sets of shingles always group, hence equal texts. Only (id, text) decides: of rows that are equal in both, one stays. Null texts are empty texts,
    which group with texts of white space; a null id is the last choice. An empty table gives no rows.
    """
    taken = {c.lower() for c in docs.columns}
    key, text = (next(n for k in range(len(taken) + 1) if (n := f"_near_{base}{k}") not in taken) for base in ("id", "text"))
    named = docs.withColumns({key: docs[id_col].cast("long"), text: F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)})
    rows = texts(docs, id_col, text_col).withColumn("t", F.sha2("text", 256))

    def work(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                out, size, sets = np.zeros((WIDE, batch.num_rows), np.uint64), [], []
                for k, x in enumerate(batch.column(1).to_pylist()):
                    hashes = np.unique(shingle_hashes(x, shingle, SEEDS[0]))
                    out[:, k] = wide_print(hashes)
                    size.append(len(hashes))
                    sets.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.view(np.int64)) for x in out], pa.array(size, pa.int32()), batch.column(2),
                                                  pa.array(sets, pa.binary())], names=["doc_id", *words, "size", "t", "shingles"])

    words = [f"f{w}" for w in range(WIDE)]
    prints = checkpointed(rows.mapInArrow(work, f"doc_id long, {', '.join(f'{w} long' for w in words)}, size int, t string, shingles binary"))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("lead")
    ids = prints.groupBy("shingles").agg(*[F.first(c).alias(c) for c in (*words, "size")], lead)
    ids = checkpointed(ids.select(*words, "size", "lead").withColumn("id", F.monotonically_increasing_id()))
    tables = sampled_bits(ids.count())
    can_differ = F.col("size") * (1 - similarity) >= similarity - 1e-9  # smaller sets reach the similarity only if they are equal

    def links(nodes: DataFrame, keys: Column) -> DataFrame:
        found = checkpointed(near_clusters(nodes.where(can_differ), keys, radius, begin))  # an id once
        sizes = checkpointed(found.groupBy("cluster").agg(F.count("*").alias("n")))
        sized = lookup(found, sizes, "cluster", hot_keys(sizes, "cluster", "n", found.count()))
        named = sized.join(nodes.select("id", "lead", F.coalesce("node", "id").alias("node")), "id").alias("s")
        match = (F.col("x.t") == F.col("s.lead.t")) & F.col("x.doc_id").eqNullSafe(F.col("s.lead.doc_id"))
        # texts that are equal in both come several times and say the same
        return _linked_texts(rows.alias("x").join(named, match).select("s.id", "s.cluster", "s.n", "x.text", "s.node"), shingle, similarity)

    first = components(links(ids.withColumn("node", F.lit(None).cast("long")), table_keys(tables[:FIRST])))
    merged = checkpointed(ids.join(first.select(F.col("node").alias("id"), F.col("root").alias("node")), "id", "left"))
    second = links(merged, table_keys(tables[FIRST:], FIRST))
    same = components(first.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(second))
    kept = ids.join(same.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("root", "id")).agg(F.min("lead").alias("m"))
    kept = checkpointed(kept.select(F.col("m.doc_id").alias("doc_id"), F.col("m.t").alias("t")))
    match = (named[text] == kept["t"]) & named[key].eqNullSafe(kept["doc_id"])
    out = named.join(kept, match, "left_semi")
    if not prints.groupBy("doc_id", "t").count().where("count > 1").isEmpty():  # rows repeated in id and text
        out = out.dropDuplicates([key, text])
    return out.drop(key, text)
