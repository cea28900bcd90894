"""Permutation importance: how much a score falls when one feature's values change places."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.sources.lineage import checkpointed

PREFIX = 4  # hexadecimal digits of the hash by which rows are counted
BLOCK = 100_000  # rows sorted together
METRICS = ("accuracy", "r2", "neg_mean_squared_error", "neg_log_loss")


def with_place(df: DataFrame, key: Sequence[str], out: str) -> DataFrame:
    """Number the rows from 0 in the order of the md5 of their key, without sorting the whole table in one task.

    Rows are counted by the first digits of the hash, at most 16 ** PREFIX counts, and numbered inside each of these groups. The key must tell
    rows apart, or the numbers of rows that share one may change places.
    """
    hashed = df.withColumn("_md5", F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])))
    hashed = hashed.withColumn("_group", F.substring("_md5", 1, PREFIX))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = hashed.groupBy("_group").count().select("_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_group").orderBy("_md5"))
    return hashed.join(F.broadcast(starts), "_group").withColumn(out, F.col("_start") + inside - 1).drop("_md5", "_group", "_start")


def _gain(metric: str, label: Column) -> Column:
    """What a row adds to the score, to be averaged."""
    if metric == "accuracy":
        return (F.col("prediction") == label).cast("double")
    if metric == "neg_log_loss":
        p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("probability")))
        return F.when(label == 1, F.log(p)).otherwise(F.log(1 - p))
    return -F.pow(F.col("prediction") - label, F.lit(2))


def permutation_importance(df: DataFrame, score: Callable[[DataFrame], DataFrame], label: str, features: Sequence[str], key: Sequence[str],
                           metric: str = "accuracy", repeats: int = 5, block: int = BLOCK) -> DataFrame:
    """(feature, importance_mean, importance_std, repeats): by how much the metric falls; the deviation is that of the population of repeats.

    ``score`` adds ``prediction`` (and ``probability`` of class 1 for the log loss) to a table with the features, whatever else it holds. Rows lie in
    the order of the md5 of their key, and in a repeat a feature takes its value from the row some places on, another distance for each feature
    and repeat, from the end on to the start. So one sort by blocks, each with the few rows after it, serves all features and repeats, and one
    scan scores them. Rows without a label are left out. With fewer than two rows nothing changes places and the importance is 0; an empty
    table gives NULL.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose one of {METRICS}")
    features = list(features)
    taken = {label, *features}
    own, place, which, times = (next(n for k in range(len(taken) + 1) if (n := f"_{base}{k}") not in taken) for base in ("own", "place", "which", "repeat"))
    rows = checkpointed(with_place(df.where(F.col(label).isNotNull()).select(*dict.fromkeys([*features, label, *key])), key, place)
                        .select(*features, label, place))
    about = rows.agg(F.count("*").alias("n"), F.var_pop(F.col(label).cast("double")).alias("v")).first()
    n = about["n"]
    tries = len(features) * repeats
    far = max(0, min(n - 1, tries))  # the greatest distance
    shift = [1 + j % (n - 1) if n > 1 else 0 for j in range(tries)]
    block = max(block, far, 1)
    # a place lies in its own block and in those that end less than ``far`` before it; the first rows follow after the last
    laps = F.array(F.col(place), *([F.col(place) + n] if n else []))
    after = rows.withColumn(which, F.explode(laps)).where((F.col(which) < n) | (F.col(place) < far))
    first = F.greatest(F.lit(0), F.floor((F.col(which) - far) / block))
    last = F.least(F.floor(F.col(which) / block), F.lit(max(n - 1, 0) // block))
    spread = after.withColumn(times, F.explode(F.sequence(first, last)))
    order = Window.partitionBy(times).orderBy(which)
    own_row = (F.col(which) < n) & (F.floor(F.col(which) / block) == F.col(times))
    moved = {f"{own}_{i}": F.array(*[F.lead(f, shift[i * repeats + r]).over(order) if shift[i * repeats + r] else F.col(f) for r in range(repeats)])
             for i, f in enumerate(features)}
    wide = spread.select(*features, label, own_row.alias(own), *[e.alias(c) for c, e in moved.items()]).where(own)
    # -1: nothing has changed places
    tried = wide.withColumn(which, F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1)))).withColumn(
        times, F.explode(F.sequence(F.lit(0), F.when(F.col(which) < 0, 0).otherwise(repeats - 1))))
    changed = tried.select(which, times, label, *[F.when(F.col(which) == i, F.get(f"{own}_{i}", F.col(times))).otherwise(F.col(f)).alias(f)
                                                  for i, f in enumerate(features)])
    means = score(changed).groupBy(which, times).agg(F.avg(_gain(metric, F.col(label).cast("double"))).alias("s")).collect()  # features x repeats
    at = {(m[which], m[times]): m["s"] for m in means}
    scale = (about["v"] or None) if metric == "r2" else 1.0
    out = []
    for i, f in enumerate(features):
        falls = [(at[-1, 0] - at[i, r]) / scale for r in range(repeats) if scale and at.get((i, r)) is not None]
        mean = sum(falls) / len(falls) if falls else None
        out.append((f, mean, (sum((x - mean) ** 2 for x in falls) / len(falls)) ** 0.5 if falls else None, repeats))
    return df.sparkSession.createDataFrame(out, "feature string, importance_mean double, importance_std double, repeats int")
