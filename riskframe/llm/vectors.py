"""Reading vectors: which take part, and their cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vector as doubles, null if it takes no part."""
    v = rows[vector_col].cast("array<double>")
    return rows.select(rows[id_col].cast("long").alias("vec_id"), F.when(usable(v), v).alias("v"))


def commonest_size(rows: DataFrame) -> int:
    """The length that most vectors have (the smaller of equals); 0 without vectors."""
    first = rows.where("v is not null").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return first.d if first else 0


def some(rows: DataFrame, key: str, most: int, n: int, seed: int = 5) -> DataFrame:
    """About ``most`` of n rows (all, if there are fewer), chosen by a hash of the key: no task hands more than its share on."""
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of vectors of one length as an array of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of a with the rows of b (or with one vector), summed alike for equal rows."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=-1)))
