"""Exact order statistics that never put a whole column into one task.

Sorting work is cut into value ranges. The cut points come from a bounded sample of
the distinct values; they only balance the work and do not influence any result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import long_form

MAX_RANGES = 4096
OVERSAMPLE = 4
ROWS_PER_RANGE = 100_000
ROWS_PER_NARROW_RANGE = 2_000  # for percentiles, which look into a few ranges only


def cut_points(df: DataFrame, by: Sequence[str], value: str, per_range: int | None = None) -> list:
    """Sorted values that cut the distinct (group, value) pairs into ranges of about ``per_range``.

    Every pair falls into one of a fixed number of hash classes and each class keeps the value
    with the smallest hash: a uniform sample of distinct pairs, found with map-side combining;
    copies of a pair share their hash and count once. The smallest hashes also tell how many
    pairs there are, so a small table is not cut at all. One list serves all groups: a group
    with many values also has many of the cut points.
    """
    slots = MAX_RANGES * OVERSAMPLE
    pair = [F.col(b) for b in by] + [F.col(value)]
    order = F.xxhash64(F.lit(7), *pair)
    picked = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.pmod(F.xxhash64(*pair), F.lit(slots)).alias("_slot"))
        .agg(F.min_by(value, order).alias("_v"), F.min(order).alias("_h"))
    )
    found = picked.select("_v", "_h").collect()  # at most `slots` rows
    if len(found) < slots // 2:
        pairs = len(found)
    else:
        # the smallest of n uniform numbers is 1 / (n + 1) on average
        mean = sum((r["_h"] + 2.0 ** 63) / 2.0 ** 64 for r in found) / len(found)
        pairs = int(slots * (1.0 / mean - 1.0))
    ranges = min(MAX_RANGES, len(found), -(-pairs // (per_range or ROWS_PER_RANGE)))
    values = sorted(r["_v"] for r in found)
    return sorted({values[i * len(values) // ranges] for i in range(1, ranges)})


def constant_array(values: Sequence, kind: str) -> Column:
    """A long list as one constant; an array of literals would weigh down every planning step."""
    text = json.dumps([v if isinstance(v, str) else str(v) for v in values])
    return F.from_json(F.lit(text), "array<string>").cast(f"array<{kind}>")


def with_position(df: DataFrame, x: Column, values: Sequence, out: str) -> DataFrame:
    """Add how many of the sorted values lie strictly below x (0 for NULL), by binary search.

    One projection per halving step keeps every step in generated code.
    """
    if not values:
        return df.withColumn(out, F.lit(0))
    df = df.withColumns({"_x": x, out: F.lit(0)})
    table = constant_array(values, df.schema["_x"].dataType.simpleString())
    for step in (1 << i for i in reversed(range(len(values).bit_length()))):
        below = F.coalesce(F.try_element_at(table, F.col(out) + step) < F.col("_x"), F.lit(False))
        df = df.withColumn(out, F.col(out) + F.when(below, step).otherwise(0))
    return df.drop("_x")


def with_range(df: DataFrame, value: str, points: Sequence, out: str = "_range") -> DataFrame:
    """Tag each row with the number of the value range it lies in."""
    return with_position(df, F.col(value), points, out)


def running_totals(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, Column],
                   per_range: int | None = None) -> DataFrame:
    """Per group and distinct value, in ascending order: each sum, ``<sum>_cum`` up to and
    including the value, and ``<sum>_all`` of the group.

    Rows collapse to distinct values first (with map-side combining, so a hot value is
    harmless); then ranges are summed locally and shifted by the totals of earlier ranges.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    points = cut_points(rows, by, value, per_range)
    # a struct of NULLs equals itself, so the group of NULLs keeps its rows in joins
    per_value = (rows.groupBy(*by, value).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
                 .withColumn("_g", F.struct(F.lit(0).alias("_"), *by)))
    whole = Window.partitionBy("_g")
    if not points:  # few distinct values in all: one sort per group will do
        up_to = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return per_value.select(*by, value, *sums, *[F.sum(n).over(up_to).alias(f"{n}_cum") for n in sums],
                                *[F.sum(n).over(whole).alias(f"{n}_all") for n in sums])
    tagged = with_range(per_value, value, points)
    per_range = tagged.groupBy("_g", "_range").agg(*[F.sum(n).alias(n) for n in sums])
    # at most MAX_RANGES rows per group from here on
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    marks = per_range.select(
        "_g", "_range",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_off") for n in sums],
        *[F.sum(n).over(whole).alias(f"{n}_all") for n in sums],
    )
    local = Window.partitionBy("_g", "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    # the join needs the rows placed exactly as the window does, so it adds no shuffle
    return tagged.join(marks, ["_g", "_range"]).select(
        *by, value, *sums,
        *[(F.sum(n).over(local) + F.col(f"_{n}_off")).alias(f"{n}_cum") for n in sums],
        *[f"{n}_all" for n in sums],
    )


def exact_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                      small: int = 50_000, per_range: int | None = None) -> dict[str, list[float | None]]:
    """Interpolated percentiles of many columns; the answer is a few numbers per column.

    A column with at most about ``small`` distinct values uses the built-in aggregate, whose
    state is one entry per distinct value. Any other column is cut into ranges, range counts
    tell where the wanted ranks lie, and only those ranges are ranked.
    """
    cols = list(cols)
    if not cols:
        return {}
    num = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    first = num.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)],
                    *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    counts = {c: first[f"n{i}"] for i, c in enumerate(cols)}
    ranks = {c: sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
             for c, n in counts.items() if n}
    low = [c for i, c in enumerate(cols) if counts[c] and first[f"d{i}"] <= small]
    high = [c for i, c in enumerate(cols) if counts[c] and first[f"d{i}"] > small]
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    if low:
        want = F.array(*[F.lit(float(p)) for p in probs])
        row = num.agg(*[F.percentile(c, want).alias(f"p{i}") for i, c in enumerate(low)]).first()
        out.update({c: list(row[f"p{i}"]) for i, c in enumerate(low)})
    if high:
        rows = long_form(num, high).where(F.col("x").isNotNull())
        tagged = with_range(rows, "x", cut_points(rows, ["feature"], "x", per_range or ROWS_PER_NARROW_RANGE))
        want = df.sparkSession.createDataFrame([(c, ranks[c]) for c in high], "feature string, _want array<long>")
        by_range = Window.partitionBy("feature").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        # at most MAX_RANGES counts per feature; only the ranges that hold a wanted rank are kept
        holders = (
            tagged.groupBy("feature", "_range").agg(F.count(F.lit(1)).alias("_size"))
            .withColumn("_seen", F.coalesce(F.sum("_size").over(by_range), F.lit(0)))
            .join(F.broadcast(want), "feature")
            .withColumn("_ranks", F.filter("_want", lambda r: (r >= F.col("_seen"))
                                           & (r < F.col("_seen") + F.col("_size"))))
            .where(F.size("_ranks") > 0)
        )
        wanted = [(r["feature"], r["_range"], r["_seen"], list(r["_ranks"])) for r in
                  holders.select("feature", "_range", "_seen", "_ranks").collect()]
        at = _values_at(tagged, wanted)
        out.update({c: [_interpolate(at, c, p * (counts[c] - 1)) for p in probs] for c in high})
    return out


def _interpolate(at: dict[tuple[str, int], float], name: str, pos: float) -> float:
    lo, hi = math.floor(pos), math.ceil(pos)
    a, b = at[name, lo], at[name, hi]
    return a if a == b else (hi - pos) * a + (pos - lo) * b


def _values_at(tagged: DataFrame, wanted: list[tuple[str, int, int, list[int]]]) -> dict[tuple[str, int], float]:
    """The values at given ranks: ``wanted`` lists (feature, range, rows before it, ranks inside it)."""
    targets = tagged.sparkSession.createDataFrame(wanted, "feature string, _range int, _seen long, _ranks array<long>")
    local = Window.partitionBy("feature", "_range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        tagged.join(F.broadcast(targets.select("feature", "_range")), ["feature", "_range"], "left_semi")
        .groupBy("feature", "_range", "x").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(local))
        .join(F.broadcast(targets), ["feature", "_range"])
        .withColumn("_hit", F.filter(
            F.col("_ranks"),
            lambda r: (r >= F.col("_seen") + F.col("_end") - F.col("_n")) & (r < F.col("_seen") + F.col("_end"))))
        .where(F.size("_hit") > 0)
        .select("feature", "x", "_hit")
    )
    return {(row["feature"], r): row["x"] for row in hits.collect() for r in row["_hit"]}  # two per percentile
