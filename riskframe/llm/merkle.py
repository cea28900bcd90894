"""A Merkle manifest of a table: digests of all rows, hashed up into one root, and proofs found by descent from that root.

Rows are leaves, ordered within their group (a source); every FANOUT consecutive nodes become the digest of their children until
one is left, the group's subroot, and the subroots become the root in the same way. Every inner node is stored once under
its digest, with its children: a content-addressed graph. A proof needs nothing but these records and a position: its digits to the
base FANOUT say which child to follow from the root, and the children left aside at each step, read back from the leaf, are the proof.
Requests that share the upper part of their way go it together, so no record is read once a leaf.

Digests are lowercase hex of SHA-256; a node is the digest of its children's hex text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import checkpointed, hot_keys, lookup
from riskframe.llm.stored import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")  # what a leaf is made of, in this order
BITS = 4
FANOUT = 1 << BITS
PATH = "array<struct<digit:int,others:array<string>>>"


@dataclass
class Manifest:
    root: str | None  # None for an empty table
    leaves: DataFrame  # (tree, pos, leaf, and what was carried)
    groups: DataFrame  # (tree, pos, digest, height): every group's place, subroot and levels
    height: int  # levels above the subroots
    tallest: int  # levels of the tallest group
    records: DataFrame  # (digest, children, times): each inner node once
    hot: DataFrame | None  # digests that occur very often, as repeated rows give


def leaf_digest(*fields: Column) -> Column:
    """H of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with ``pos``, the place of each within its group from 0, and ``n``, the rows of the group.

    Rows are sorted over ranges of (group, order), so a group of any size is spread over tasks; what a task needs to know of the
    earlier ones is a count for each range that the group touches.
    """
    placed = checkpointed(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)  # the id is the partition's number, shifted by 33 bits, plus the row's place in it
    marks = placed.groupBy(group, part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.select(group, "part", "first", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(whole).alias("n"))
    return placed.withColumn("part", part).join(marks, [group, "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop(
        "at", "part", "first", "before")


def grow(nodes: DataFrame, most: int) -> tuple[list[DataFrame], int]:
    """The levels above nodes (tree, pos, digest, n), as tables (tree, pos, digest, children, n); most: the largest n."""
    levels: list[DataFrame] = []
    now = nodes.select("tree", "pos", "digest", "n")
    while most > 1:
        kids = F.sort_array(F.collect_list(F.struct("pos", "digest")))
        up = (now.where("n > 1").groupBy("tree", F.shiftright("pos", BITS).alias("pos")).agg(kids.alias("kids"), F.first("n").alias("n"))
              .select("tree", "pos", F.col("kids.digest").alias("children"), F.ceil(F.col("n") / FANOUT).cast("long").alias("n"))
              .withColumn("digest", F.sha2(F.array_join("children", ""), 256)))
        now = stored(up.select("tree", "pos", "digest", "children", "n"), "merkle")
        levels.append(now)
        most = -(-most // FANOUT)
    return levels, len(levels)


def _tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, digest, height) of the one node that is left of every tree."""
    out = nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("height"))
    for k, level in enumerate(levels):
        out = out.unionAll(level.where("n = 1").select("tree", "digest", F.lit(k + 1).alias("height")))
    return out


def build(docs: DataFrame, fields=FIELDS, group: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of every row of docs.

    Nulls are ``-`` in a leaf, come first in both orders, and rows with a null group are a group. Equal orders follow the
    leaf's digest, so repeated rows are leaves of their own, next to each other. An empty table has no root. Other columns have no say;
    ``carry`` adds columns (named apart from tree, pos, n, leaf, digest) to the leaves.
    """
    key = docs[group].cast("string")
    tree = F.coalesce(F.concat(F.lit("."), key), F.lit("-"))  # the null group sorts before all others
    leaves = docs.select(tree.alias("tree"), docs[order].alias("_order"), leaf_digest(*[docs[f] for f in fields]).alias("leaf"),
                         F.monotonically_increasing_id().alias("_copy"), *[c.alias(k) for k, c in (carry or {}).items()])
    leaves = checkpointed(positions(leaves, "tree", ["_order", "leaf", "_copy"]).drop("_order", "_copy"))
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.withColumnRenamed("leaf", "digest")
    levels, tallest = grow(nodes, most)
    tops = checkpointed(positions(_tops(nodes, levels).withColumnRenamed("tree", "group").withColumn("tree", F.lit("")), "tree", ["group"]))
    above, height = grow(tops, tops.count())
    top = (above[-1] if above else tops).select("digest").first()
    every = [x.select("digest", "children") for x in [*levels, *above]]
    if not every:  # no node but the leaves
        records = docs.sparkSession.createDataFrame([], "digest string, children array<string>, times long")
        hot = None
    else:
        records = every[0]
        for more in every[1:]:
            records = records.unionAll(more)
        records = stored(records.groupBy("digest").agg(F.first("children").alias("children"), F.count("*").alias("times")), "merkle-records")
        hot = hot_keys(records, "digest", "times", records.agg(F.sum("times")).first()[0])
    groups = tops.select(F.col("group").alias("tree"), "pos", "digest", "height")
    return Manifest(top and top[0], leaves.drop("n"), groups, height, tallest, records, hot)


def descend(starts: DataFrame, tallest: int, requests: DataFrame, records: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Follow the digits of every request (tree, pos, ...) from its tree's start (tree, digest, height, path, ...) down to height 0.

    Returns the requests with ``digest``, what is found there, the start's further columns, and ``path``, to which each step has added
    the digit that it took and the children that it left aside.
    """
    plus = [c for c in starts.columns if c not in ("tree", "digest", "height", "path")]
    wanted = {0: requests}
    if tallest > 1:
        wanted[1] = checkpointed(requests.select("tree", F.shiftright("pos", BITS).alias("pos")).distinct())
    for level in range(2, tallest):
        wanted[level] = wanted[1].select("tree", F.shiftright("pos", BITS * (level - 1)).alias("pos")).distinct()
    start = lambda level: starts.where(F.col("height") == level).select("tree", F.lit(0).cast("long").alias("node"), "digest", "path", *plus)
    front = start(tallest)
    for level in reversed(range(tallest)):
        opened = lookup(front, records.select("digest", "children"), "digest", hot).drop("digest")
        digit = F.col("pos").bitwiseAND(FANOUT - 1).cast("int")
        step = (wanted[level].withColumn("node", F.shiftright("pos", BITS)).join(opened, ["tree", "node"])
                .withColumn("digest", F.element_at("children", digit + 1))
                .withColumn("path", F.array_append("path", F.struct(digit.alias("digit"), F.concat(
                    F.slice("children", F.lit(1), digit), F.slice("children", digit + 2, F.lit(FANOUT))).alias("others")))))
        if level:
            front = step.select("tree", F.col("pos").alias("node"), "digest", "path", *plus).unionByName(start(level))
        else:
            low = start(0).withColumnRenamed("node", "pos").join(requests, ["tree", "pos"])
            front = step.drop("node", "children").unionByName(low.select(*[c for c in step.columns if c not in ("node", "children")]))
    return front if tallest else front.withColumnRenamed("node", "pos").join(requests, ["tree", "pos"])


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Requests (tree, pos, ...), by default all leaves, with ``digest`` of the leaf there, ``subroot`` and ``path``, from the leaf up to the root.

    Positions that the manifest does not have give no row.
    """
    requests = manifest.leaves if requests is None else requests
    if manifest.root is None:
        return requests.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (("digest", "string"), ("subroot", "string"), ("path", PATH))])
    spark = manifest.records.sparkSession
    top = spark.createDataFrame([("", manifest.root, manifest.height, [])], f"tree string, digest string, height int, path {PATH}")
    of = manifest.groups.select(F.lit("").alias("tree"), "pos", F.col("tree").alias("group"), "height")
    of = of.join(requests.select(F.col("tree").alias("group")).distinct(), "group", "left_semi")
    groups = descend(top, manifest.height, of.select("tree", "pos", "group", F.col("height").alias("levels")), manifest.records, manifest.hot)
    starts = checkpointed(groups.select(F.col("group").alias("tree"), "digest", F.col("levels").alias("height"), "path", F.col("digest").alias("subroot")))
    found = descend(starts, manifest.tallest, requests, manifest.records, manifest.hot)
    return found.withColumn("path", F.reverse("path"))


def siblings(path: Column) -> Column:
    """The proof as text: the digests left aside, level by level from the leaf up, left to right."""
    return F.array_join(F.flatten(F.transform(path, lambda s: s["others"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to with the digests of a proof."""
    def up(now, s):
        left = F.array_join(F.slice(s["others"], F.lit(1), s["digit"]), "")
        return F.sha2(F.concat(left, now, F.array_join(F.slice(s["others"], s["digit"] + 1, F.lit(FANOUT)), "")), 256)

    return F.aggregate(path, leaf, up)


def audit(docs: DataFrame, every: int = 5) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, after a tampering that only proofs can show.

    Of rows whose crc32(doc_id as text) ``every`` divides, the text has its A-Z lowered; a null doc_id is never tampered with.
    """
    capitals = "".join(map(chr, range(65, 91)))
    touched = F.pmod(F.crc32(F.encode(docs["doc_id"].cast("string"), "utf-8")), F.lit(every)) == 0
    lowered = leaf_digest(*[F.translate(docs[f], capitals, capitals.lower()) if f == "text" else docs[f] for f in FIELDS])
    manifest = build(docs, carry={"doc_id": docs["doc_id"], "tampered": F.when(touched, lowered)})
    proofs = prove(manifest)
    root = F.lit(manifest.root).cast("string")
    out = proofs.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
                        fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
