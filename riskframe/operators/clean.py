"""Projection, typing, null tokens and pruning of a raw subscriber table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.expr import NULL_TOKENS, key_hash, known


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in cols])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename many columns, matching case; names the table does not have are ignored."""
    return df.toDF(*[mapping.get(c, c) for c in df.columns])


def cast_columns(df: DataFrame, text: Sequence[str] = (), label: str | None = None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Listed columns become text, the label int, all others double; bad text becomes NULL."""
    text, keep = set(text), set(keep)
    out = {}
    for c in df.columns:
        q = f"`{c}`"
        if c in keep:
            continue
        if c == label:
            out[c] = F.expr(f"try_cast({q} AS INT)")
        elif c in text:
            out[c] = F.col(q).cast("string")
        else:
            out[c] = F.expr(f"try_cast({q} AS DOUBLE)")
    return df.withColumns(out)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """NULL for every missing-value token and every NaN, in all columns."""
    return df.select(*[known(df, c, tokens).alias(c) for c in df.columns])


def any_left(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """One row: does the table still hold a token, does it hold a NULL."""
    has_token, has_null = F.lit(False), F.lit(False)
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        has_null = has_null | c.isNull()
        if isinstance(f.dataType, T.StringType):
            has_token = has_token | F.coalesce(c.isin(list(tokens)), F.lit(False))
    return df.agg(F.coalesce(F.bool_or(has_token), F.lit(False)).alias("any_token"),
                  F.coalesce(F.bool_or(has_null), F.lit(False)).alias("any_null"))


def filter_label(df: DataFrame, label: str, value) -> DataFrame:
    return df.where(F.col(label) == F.lit(value))


def column_rates(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(feature, missing_rate, zero_rate) of every column, in one pass over the table.

    A value is zero when it is the number 0 or the text '0'; NULL is missing, not zero.
    """
    cols = [f for f in df.schema if f.name not in set(exclude)]
    aggs = []
    for i, f in enumerate(cols):
        c = F.col(f"`{f.name}`")
        zero = c == F.lit("0") if isinstance(f.dataType, T.StringType) else (
            c == F.lit(0) if isinstance(f.dataType, T.NumericType) else F.lit(False))
        aggs.append(F.avg(c.isNull().cast("double")).alias(f"m{i}"))
        aggs.append(F.avg(F.coalesce(zero, F.lit(False)).cast("double")).alias(f"z{i}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(f.name).alias("feature"), F.col(f"m{i}").alias("missing_rate"),
                     F.col(f"z{i}").alias("zero_rate")) for i, f in enumerate(cols)]
    return wide.select(F.inline(F.array(*rows)))


def prune_missing(df: DataFrame, limit: float = 0.2, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Drop the columns whose missing rate is above the limit; also return their names."""
    gone = {r["feature"] for r in column_rates(df, keep).where(F.col("missing_rate") > limit).collect()}
    return df.drop(*gone), [c for c in df.columns if c in gone]


def prune_zero(df: DataFrame, limit: float = 0.3, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Drop the columns whose rate of zeros is above the limit; name the label in ``keep``."""
    gone = {r["feature"] for r in column_rates(df, keep).where(F.col("zero_rate") > limit).collect()}
    return df.drop(*gone), [c for c in df.columns if c in gone]


def complete_cases(df: DataFrame) -> DataFrame:
    return df.dropna(how="any")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def hashed_target(df: DataFrame, keys: Sequence[str], upper: int = 300, seed: int = 42,
                  out: str = "label") -> DataFrame:
    """A uniform whole number in [0, upper) that depends on the row key only."""
    digits = F.conv(F.substring(key_hash(seed, keys), 1, 8), 16, 10).cast("long")
    return df.withColumn(out, F.pmod(digits, F.lit(upper)).cast("int"))


def concat_tables(*tables: DataFrame) -> DataFrame:
    """Rows of all tables, columns matched by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def feature_columns(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    skip = {target, *exclude}
    return [c for c in df.columns if c not in skip]


def split_by_type(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) names in schema order; booleans count as categorical."""
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    return numeric, [c for c in cols if c not in set(numeric)]


def detect_categorical(df: DataFrame, cols: Sequence[str], limit: int = 10, count_all: bool = False) -> DataFrame:
    """(feature, n_distinct, is_categorical): text, or at most ``limit`` distinct non-null values.

    ``n_distinct`` is exact up to the limit and NULL above it: a sketch picks out the
    columns that are far above the limit, and only the others are counted exactly. With
    ``count_all`` every column is counted, by grouping its values.
    """
    numeric = set(split_by_type(df, cols)[0])
    if count_all:
        text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
        values = text.unpivot([], list(cols), "feature", "value").where("value is not null").distinct()
        names = df.sparkSession.createDataFrame([(c, c not in numeric) for c in cols], "feature string, is_text boolean")
        n = F.coalesce("n", F.lit(0)).alias("n_distinct")
        return names.join(values.groupBy("feature").agg(F.count("value").alias("n")), "feature", "left").select(
            "feature", n, (F.col("is_text") | (n <= limit)).alias("is_categorical"))
    guess = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}")
                     for i, c in enumerate(cols)]).first()
    near = [i for i in range(len(cols)) if guess[f"d{i}"] <= 5 * limit + 50]
    exact = [F.count_distinct(F.col(f"`{cols[i]}`")).alias(f"d{i}") for i in near]
    wide = df.agg(*exact, F.lit(1).alias("_one"))
    rows = []
    for i, c in enumerate(cols):
        few = F.when(F.col(f"d{i}") <= limit, F.col(f"d{i}")) if i in near else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(c).alias("feature"), few.alias("n_distinct"),
                             (F.lit(c not in numeric) | few.isNotNull()).alias("is_categorical")))
    return wide.select(F.inline(F.array(*rows)))
