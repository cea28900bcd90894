"""Column expressions shared by the operators. Nothing here starts a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text tokens that stand for "missing" in exported tables.
NULL_TOKENS = ["\\N", "\\n", "None", "nan", "NaN", ""]


def known(df: DataFrame, name: str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """The column with every marker of a missing value turned into NULL."""
    dtype = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return F.when(~c.isin(list(tokens)), c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def drop_nan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN becomes NULL in the named columns: percentiles sort NaN as a value."""
    return df.withColumns({c: known(df, c, tokens=()) for c in cols
                           if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))})


def null_safe(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the named columns, where NULL equals NULL; the columns of the left side stay."""
    right = right.withColumnsRenamed({b: f"_r_{b}" for b in by})
    on = F.lit(True)
    for b in by:
        on = on & F.col(f"`{b}`").eqNullSafe(F.col(f"`_r_{b}`"))
    return left.join(right, on, how).drop(*[f"_r_{b}" for b in by])


def key_hash(seed: int, keys: Sequence[str]) -> Column:
    """A repeatable pseudo-random order: md5 of the seed and the row key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_unit(digest: Column, start: int = 1) -> Column:
    """A number in [0, 1) from eight hex digits of a digest."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def interval_bin(x: Column, edges: Sequence[float]) -> Column:
    """Bin number of x for right-closed intervals cut at the interior edges."""
    if not edges:
        return F.when(x.isNotNull(), F.lit(0))
    pos = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        pos = F.when(x <= F.lit(float(edges[i])), F.lit(i)).otherwise(pos)
    return F.when(x.isNotNull(), pos)


def long_form(df: DataFrame, features: Sequence[str], ids: Sequence[str] = (),
              name: str = "feature", value: str = "x", as_type: str = "double") -> DataFrame:
    """One row per (row, feature); all feature values cast to one type."""
    narrow = df.select(*ids, *[F.col(f).cast(as_type).alias(f) for f in features])
    return narrow.unpivot(list(ids), list(features), name, value)
