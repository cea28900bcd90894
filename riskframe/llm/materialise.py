"""Training-order materialisation: token sequences at keyed random slots, in shards of fixed stride.

The corpus is one stream of token ids, document after document with a separator, cut into sequences of equal length. A keyed
Feistel network with cycle-walking permutes the sequence numbers, and a sequence's image is its global slot. Each
shard holds a range of slots, each slot in a fixed number of bytes, so a reader can start at any slot and read on in
training order. Tasks write a shard under a name of their own and rename it, so a repeated task does no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.byte_tokens import byte_encoder, shared_file, tokenizer_file
from riskframe.llm.common import checkpointed, slices, texts, whole_runs
from riskframe.llm.stored import shared_folder

HELD = 32 << 20  # bytes of ids that a task holds before it hands them on
ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixing function."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def round_keys(key: int) -> list[int]:
    return [int(_mix(np.array([key & (2**64 - 1)], np.uint64), 0x5851F42D + r)[0]) for r in range(ROUNDS)]


def permuted(x: np.ndarray, size: int, key: int) -> np.ndarray:
    """The images of numbers below ``size`` under a keyed permutation of them.

    A balanced Feistel network permutes the least power of four that is not below ``size``; what falls outside walks on.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low, keys = np.uint64((1 << half) - 1), round_keys(key)
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & low)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, as tasks open it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


@dataclass
class Materialised:
    """Where the shards are, how they are laid out, and the index: one row a sequence."""

    path: str
    sequences: int
    length: int
    slots: int
    kind: str
    index: DataFrame

    @property
    def stride(self) -> int:
        return self.length * np.dtype(self.kind).itemsize


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _tokens(docs: DataFrame, tokenizer: str, separator: int, kind: str, id_col: str, text_col: str) -> DataFrame:
    """(part, start, doc_id, n, ids): compressed ids of groups of documents, with their place in the stream of their partition."""
    spec = shared_file(docs.sparkSession, tokenizer)

    def work(batches):
        encoder, part, start = byte_encoder(spec.value), TaskContext.get().partitionId(), 0
        pack, stop = zstandard.ZstdCompressor(level=8), np.asarray([separator], kind)
        for whole in batches:
            for batch in slices(whole, 1, 4_000_000):
                parts = [np.concatenate([encoder.encode(t).astype(kind), stop]) for t in batch.column(1).to_pylist()]
                sizes = [len(x) for x in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                     pa.array([sizes], pa.list_(pa.int64())), pa.array([pack.compress(np.concatenate(parts).tobytes())], pa.binary())],
                    names=["part", "start", "doc_ids", "sizes", "ids"])
                start += sum(sizes)

    return texts(docs, id_col, text_col).mapInArrow(work, "part int, start long, doc_ids array<long>, sizes array<long>, ids binary")


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, length: int = 1024, separator: int = 0, slots: int = 8192,
          key: int = 20, kind: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> Materialised:
    """Write all of docs as shards of ``slots`` sequences below ``path`` (default: a new folder in the shared one).

    Index: (slot, sequence_id, shard, place, n_tokens, ids_crc32, doc_ids); place is the byte offset in the shard, the checksum is of the
    sequence's real ids as stored, and doc_ids lists the documents in the sequence, in order, null ids included. Only the stream's last sequence is
    shorter, and padded with zeros. Null and empty texts are their separator alone; repeated rows are written each; an empty table
    gives no shards. ``kind`` must hold the tokenizer's ids.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark, "training-order")
    at = shared_folder(spark, "tokens")
    _tokens(docs, tokenizer or tokenizer_file("byte_bpe_50k.json"), separator, kind, id_col, text_col).write.option("compression", "none").parquet(at)
    tokens = spark.read.parquet(at)
    ends = {r.part: r.n for r in tokens.select("part", (F.col("start") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
            .groupBy("part").agg(F.max("n").alias("n")).collect()}  # one row a partition
    first, total = {}, 0
    for part in sorted(ends):
        first[part], total = total, total + ends[part]
    count = -(-total // length)
    shared = spark.sparkContext.broadcast(first)
    item = np.dtype(kind).itemsize

    def deal(batches):
        pack, open_ = zstandard.ZstdCompressor(level=6), zstandard.ZstdDecompressor()
        held, held_bytes = [], 0

        def out():
            meta = np.concatenate([m for m, _ in held])
            ids = np.concatenate([x for _, x in held])
            begin = np.cumsum(meta[:, 5]) - meta[:, 5]
            shard = meta[:, 0] // slots
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            rows = []
            for group in np.split(order, cuts):
                data = b"".join(ids[b:b + n].tobytes() for b, n in zip(begin[group].tolist(), meta[group, 5].tolist(), strict=True))
                rows.append((int(shard[group[0]]), pack.compress(meta[group].tobytes()), pack.compress(data)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                                               pa.array([r[2] for r in rows], pa.binary())], names=["shard", "meta", "ids"])

        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(open_.decompress(row["ids"]), kind)
                size = np.asarray(row["sizes"], np.int64)
                doc_end = np.cumsum(size) + first_of(row)
                begin = doc_end - size
                # cut at the documents' and at the sequences' borders
                marks = np.union1d(np.append(begin, doc_end[-1:]), np.arange(-(-int(begin[0]) // length) * length, int(doc_end[-1]), length))
                start, n = marks[:-1], np.diff(marks)
                doc = np.searchsorted(begin, start, side="right") - 1
                seq = start // length
                names = np.asarray([0 if d is None else d for d in row["doc_ids"]], np.int64)
                known = np.asarray([d is not None for d in row["doc_ids"]], np.int64)
                meta = np.stack([permuted(seq, count, key), seq, start % length, names[doc], known[doc], n], axis=1)
                held.append((meta, ids))
                held_bytes += ids.nbytes
                if held_bytes >= HELD:
                    yield out()
                    held_bytes = 0
        if held:
            yield out()

    def first_of(row):
        return shared.value[row["part"]] + row["start"]

    def put(batches):
        store, folder = store_of(path)
        open_ = zstandard.ZstdDecompressor()
        for group in whole_runs(batches, 0):
            for shard in sorted(set(group.column(0).to_pylist())):
                rows = group.filter(pa.compute.equal(group.column(0), shard)).to_pylist()
                base = shard * slots
                here = min(slots, count - base)
                data, filled = np.zeros((here, length), kind), np.zeros(here, np.int64)
                metas = []
                for row in rows:
                    meta = np.frombuffer(open_.decompress(row["meta"]), np.int64).reshape(-1, 6)
                    ids, b = np.frombuffer(open_.decompress(row["ids"]), kind), 0
                    for slot, _, offset, _, _, n in meta.tolist():
                        data[slot - base, offset:offset + n] = ids[b:b + n]
                        b += n
                    metas.append(meta)
                meta = np.concatenate(metas)
                np.add.at(filled, meta[:, 0] - base, meta[:, 5])
                name = f"{folder}/{shard_name(shard)}"
                own = f"{name}.attempt-{TaskContext.get().taskAttemptId()}"
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(own) as f:
                    f.write(data.tobytes())
                store.move(own, name)
                meta = meta[np.lexsort((meta[:, 2], meta[:, 0]))]
                cuts = np.flatnonzero(np.diff(meta[:, 0])) + 1
                out = []
                for part in np.split(meta, cuts):
                    s, n = int(part[0, 0]), int(filled[part[0, 0] - base])
                    docs_here = [d if k else None for d, k in part[:, 3:5].tolist()]
                    out.append((s, int(part[0, 1]), shard, (s - base) * length * item, n, zlib.crc32(data[s - base, :n].tobytes()), docs_here))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64()] * 6 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                 names=["slot", "sequence_id", "shard", "place", "n_tokens", "ids_crc32", "doc_ids"])

    dealt = tokens.mapInArrow(deal, "shard long, meta binary, ids binary").repartition("shard").sortWithinPartitions("shard")
    index = dealt.mapInArrow(put, "slot long, sequence_id long, shard long, place long, n_tokens long, ids_crc32 long, doc_ids array<long>")
    return Materialised(path, count, length, slots, kind, checkpointed(index))


def read(m: Materialised, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from slot ``start`` on, in training order: a reader that stopped goes on from the slot it had reached."""
    store, folder = store_of(m.path)
    stop = m.sequences if stop is None else min(stop, m.sequences)
    while start < stop:
        shard, upto = start // m.slots, min(stop, (start // m.slots + 1) * m.slots)
        with store.open_input_file(f"{folder}/{shard_name(shard)}") as f:
            f.seek((start % m.slots) * m.stride)
            while start < upto:
                yield start, np.frombuffer(f.read(m.stride), m.kind)
                start += 1


def scan(spark: SparkSession, m: Materialised) -> DataFrame:
    """(slot, ids binary) of all shards, a task reading whole shards."""
    shards = -(-m.sequences // m.slots)

    def work(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                for slot, ids in read(m_plain, shard * m_plain.slots, (shard + 1) * m_plain.slots):
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([ids.tobytes()], pa.binary())], names=["slot", "ids"])

    m_plain = Materialised(m.path, m.sequences, m.length, m.slots, m.kind, None)
    return spark.range(shards).mapInArrow(work, "slot long, ids binary")
