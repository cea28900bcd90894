"""Joins with tables that have one row a key, when some keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in HOT_SHARE, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def hot_keys(counts: DataFrame, key: str, is_hot: Column) -> DataFrame | None:
    """Of one row a key, the keys that are hot; None if there are none. The condition must bound their number."""
    hot = counts.where(is_hot).select(key)
    return None if hot.isEmpty() else hot


def lookup(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Left join on ``key`` with a table that has one row a key; rows of hot keys stay where they are.

    ``hot``: the hot keys, at most HOT_SHARE (see there), hence a broadcast of bounded size. Null keys find nothing.
    """
    if hot is None:
        return left.join(right, key, "left")
    few = hot.join(right, key, "left")  # every hot key, found or not
    mine = left.join(F.broadcast(few), key, "inner")
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right.join(F.broadcast(hot), key, "left_anti"), key, "left")
    return mine.unionByName(rest)
