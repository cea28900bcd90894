"""Splits and samples by a repeatable hash order of the row key.

A sample of exactly n rows is "the n smallest hashes". The n-th smallest hash is found by
counting hash prefixes, so the sample itself is a plain filter: the table is neither
sorted nor shuffled. The key columns must identify a row.

Rows without a label are a stratum of their own in splits and folds; over- and under-sampling
keep them as they are; samples of positive and other rows refuse them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import key_hash

PREFIX = 3  # hex digits per counting round: 4096 counters per class
FEW_CLASSES = 32


def class_counts(df: DataFrame, label: str, missing: bool = False) -> dict:
    """Rows per class, one entry a class; with ``missing`` also those of the rows without a label, as None."""
    rows = df if missing else df.where(F.col(label).isNotNull())
    return {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def hash_cutoffs(df: DataFrame, keys: Sequence[str], seed: int, takes: dict, label: str | None = None) -> dict:
    """Per class the hash h such that exactly ``takes[class]`` rows have a hash <= h.

    A list of numbers gives a list of hashes. Without a label the only class is None. Two
    counting rounds narrow every place down to one 24-bit prefix; only rows with such a prefix (a
    16-millionth part each) are ever ranked. The counters are summed up on the cluster: a round
    brings back one row for each wanted hash.
    """
    cls = F.col(label) if label else F.lit(None).cast("int")
    kind = df.schema[label].dataType.simpleString() if label else "int"
    # a struct of NULL equals itself
    rows = df.select(F.struct(cls.alias("c")).alias("_c"), key_hash(seed, keys).alias("_h"))
    cut: dict = {}
    todo = []
    for c, wanted in takes.items():
        for i, n in enumerate(wanted if isinstance(wanted, list) else [wanted]):
            if n <= 0:
                cut[c, i] = ""
            else:
                todo.append((c, i, "", n))
    schema = f"c {kind}, i int, p string, need long"
    spark = df.sparkSession

    def places(open_):
        return spark.createDataFrame(open_, schema).select(F.struct("c").alias("_c"), "i", F.col("p").alias("_in"), "need")

    for depth in (PREFIX, 2 * PREFIX):
        if not todo:
            break
        inside = F.broadcast(places(todo))  # a row for each wanted hash
        before = depth - PREFIX
        counted = rows.withColumn("_in", F.substring("_h", 1, before) if before else F.lit(""))
        counted = (counted.join(F.broadcast(inside.select("_c", "_in").distinct()), ["_c", "_in"], "left_semi")
                   .groupBy("_c", "_in", F.substring("_h", 1, depth).alias("_p")).agg(F.count(F.lit(1)).alias("_n")))
        up_to = Window.partitionBy("_c", "_in").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
        found = (counted.withColumn("_end", F.sum("_n").over(up_to)).join(inside, ["_c", "_in"])
                 .where((F.col("need") <= F.col("_end")) & (F.col("need") > F.col("_end") - F.col("_n")))
                 .select("_c.c", "i", "_p", (F.col("need") - F.col("_end") + F.col("_n")).alias("need"), "_n").collect())
        if len(found) < len(todo):
            lost = {(c, i) for c, i, _, _ in todo} - {(r["c"], r["i"]) for r in found}
            raise ValueError(f"class {next(iter(lost))[0]!r} has fewer rows than asked for")
        todo = []
        for r in found:
            if r["need"] == r["_n"]:
                cut[r["c"], r["i"]] = r["_p"] + "g"  # sorts after every hash with this prefix
            else:
                todo.append((r["c"], r["i"], r["_p"], r["need"]))
    if todo:
        inside = F.broadcast(places(todo))
        rank = F.row_number().over(Window.partitionBy("_c", "_in").orderBy("_h"))
        last = (rows.withColumn("_in", F.substring("_h", 1, 2 * PREFIX))
                .join(F.broadcast(inside.select("_c", "_in").distinct()), ["_c", "_in"], "left_semi").withColumn("_r", rank)
                .join(inside, ["_c", "_in"]).where(F.col("_r") == F.col("need")))
        cut.update({(r["c"], r["i"]): r["_h"] for r in last.select("_c.c", "i", "_h").collect()})
    return {c: [cut[c, i] for i in range(len(w))] if isinstance(w, list) else cut[c, 0] for c, w in takes.items()}


def _by_class(label: str | None, values: dict, default: str) -> Column:
    """The text that belongs to the row's class: a constant map, if there are many classes."""
    if label is None:
        return F.lit(values[None])
    c = F.col(label)
    named = {k: v for k, v in values.items() if k is not None}
    plain = all(isinstance(k, (str, int)) and not isinstance(k, bool) for k in named)
    if plain and len(named) > FEW_CLASSES:
        table = F.from_json(F.lit(json.dumps({str(k): v for k, v in named.items()})), "map<string,string>")
        out = F.coalesce(F.try_element_at(table, c.cast("string")), F.lit(default))
    else:
        out = F.lit(default)
        for k, v in named.items():
            out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return F.when(c.isNull(), F.lit(values.get(None, default))).otherwise(out)


def chosen(keys: Sequence[str], seed: int, cut: dict, label: str | None = None) -> Column:
    """Condition: the row is among the taken ones of its class; never NULL."""
    return key_hash(seed, keys) <= _by_class(label, cut, "")


def _check_size(size: float) -> None:
    if not 0.0 < size < 1.0:
        raise ValueError("size must lie between 0 and 1")


def _test_rows(df: DataFrame, keys, size, seed, label) -> Column:
    _check_size(size)
    if label is None:
        takes = {None: math.ceil(round(df.count() * size, 9))}
    else:
        counts = class_counts(df, label, missing=True)
        lonely = [c for c, n in counts.items() if n < 2 and c is not None]
        if lonely:
            raise ValueError(f"classes with a single row cannot be split: {lonely}")
        takes = {c: math.floor(n * size + 0.5) for c, n in counts.items()}
    return chosen(keys, seed, hash_cutoffs(df, keys, seed, takes, label), label)


def with_split(df: DataFrame, keys: Sequence[str], size: float = 0.3, seed: int = 42,
               label: str | None = None, out: str = "split") -> DataFrame:
    """Add 'train' / 'test'; stratified when a label is given."""
    return df.withColumn(out, F.when(_test_rows(df, keys, size, seed, label), "test").otherwise("train"))


def train_test(df: DataFrame, keys: Sequence[str], size: float = 0.3, seed: int = 42,
               label: str | None = None) -> tuple[DataFrame, DataFrame]:
    test = _test_rows(df, keys, size, seed, label)
    return df.where(~test), df.where(test)


def with_validation(df: DataFrame, keys: Sequence[str], label: str | None, size: float = 0.1,
                    seed: int = 42, out: str = "is_validation") -> DataFrame:
    """Add the boolean column that boosters watch for early stopping."""
    return df.withColumn(out, _test_rows(df, keys, size, seed, label))


def with_folds(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42,
               label: str | None = None, out: str = "fold") -> DataFrame:
    """Add the fold number 0..k-1 of shuffled (stratified) k-fold; fold sizes differ by at most one.

    Folds are consecutive parts of the hash order, so a row's fold follows from k - 1 cut-offs
    (of its class), without any shuffle; larger folds come first.
    """
    if label is None:
        counts = {None: df.count()}
    else:
        counts = class_counts(df, label, missing=True)
        few = {c: n for c, n in counts.items() if n < k and c is not None}
        if few:
            raise ValueError(f"classes with fewer than {k} rows: {few}")
    ends = {c: [n // k * f + min(f, n % k) for f in range(1, k)] for c, n in counts.items()}
    cuts = hash_cutoffs(df, keys, seed, ends, label)
    h, fold = key_hash(seed, keys), F.lit(0)
    for f in range(k - 1):
        fold = fold + (h > _by_class(label, {c: v[f] for c, v in cuts.items()}, "")).cast("int")
    return df.withColumn(out, fold)


def _checked_counts(df: DataFrame, label: str) -> dict:
    counts = class_counts(df, label, missing=True)
    if None in counts:
        raise ValueError(f"{counts[None]} rows have no {label!r}: neither positive nor one of the others")
    return counts


def ratio_samples(df: DataFrame, keys: Sequence[str], label: str, ratios: Sequence[int] = (1, 2, 3, 4, 5), seed: int = 42,
                  positive=1, out: str = "k") -> DataFrame:
    """All positive rows plus exactly k times as many of the others, for every ratio k in one scan; ``out`` tells the sample."""
    counts = _checked_counts(df, label)
    wanted = [k * counts.get(positive, 0) for k in ratios]
    cuts = _others_cut(df, keys, label, positive, wanted, counts, seed)
    is_positive, h = F.col(label) == F.lit(positive), key_hash(seed, keys)
    taken = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in zip(ratios, cuts, strict=True)]),
                     lambda s: is_positive | (h <= s["c"]))
    return df.withColumn(out, F.explode(F.transform(taken, lambda s: s["k"])))


def ratio_sample(df: DataFrame, keys: Sequence[str], label: str, k: int = 1, seed: int = 42,
                 positive=1) -> DataFrame:
    """All positive rows plus exactly k times as many of the others."""
    counts = _checked_counts(df, label)
    return _with_others(df, keys, label, positive, k * counts.get(positive, 0), counts, seed)


def fixed_sample(df: DataFrame, keys: Sequence[str], label: str, n: int = 10_000, seed: int = 42,
                 positive=1) -> DataFrame:
    """All positive rows plus exactly n of the others."""
    return _with_others(df, keys, label, positive, n, _checked_counts(df, label), seed)


def _others_cut(df, keys, label, positive, wanted: list[int], counts, seed) -> list[str]:
    have = sum(v for c, v in counts.items() if c != positive)
    if wanted and have < max(wanted):
        raise ValueError(f"{max(wanted)} negative rows wanted, {have} present")
    return hash_cutoffs(df.where(F.col(label) != F.lit(positive)), keys, seed, {None: list(wanted)})[None]


def _with_others(df, keys, label, positive, n, counts, seed) -> DataFrame:
    cut = {None: _others_cut(df, keys, label, positive, [n], counts, seed)[0]}
    return df.where((F.col(label) == F.lit(positive)) | chosen(keys, seed, cut))


def over_sample(df: DataFrame, keys: Sequence[str], label: str, seed: int = 42,
                copy: str = "copy") -> DataFrame:
    """Repeat rows until every class has the size of the largest; ``copy`` numbers the repeats. No label: one copy."""
    counts = class_counts(df, label)
    top = max(counts.values(), default=1)
    cut = hash_cutoffs(df, keys, seed, {c: top % n for c, n in counts.items()}, label)
    extra = chosen(keys, seed, cut, label).cast("int")
    base = F.lit(1)
    for c, n in counts.items():
        base = F.when(F.col(label) == F.lit(c), F.lit(top // n)).otherwise(base)
    return df.withColumn(copy, F.explode(F.sequence(F.lit(1), base + extra)))


def under_sample(df: DataFrame, keys: Sequence[str], label: str, seed: int = 42) -> DataFrame:
    """Cut every class to the size of the smallest; rows without a label stay."""
    counts = class_counts(df, label)
    low = min(counts.values(), default=0)
    cut = hash_cutoffs(df, keys, seed, {c: low for c in counts}, label)
    return df.where(chosen(keys, seed, cut, label) | F.col(label).isNull())


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all, if there are fewer), the same ones on every run."""
    total = df.count()
    if total <= n:
        return df
    return df.where(chosen(keys, seed, hash_cutoffs(df, keys, seed, {None: n})))
