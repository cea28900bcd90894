"""Supervised bins: the cuts of fine bins that keep the most information value."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.scorecard import WoeModel
from riskframe.operators.screening import MISSING, bin_counts, quantile_edges, woe_from_counts
from riskframe.sources.lineage import checkpointed

TRENDS = ("any", "monotone", "rising", "falling")


def best_cuts(good: np.ndarray, bad: np.ndarray, bins: int, min_share: float = 0.05, trend: str = "monotone") -> list[int]:
    """Where to cut a row of fine bins (a cut k lies before bin k) so that the information value is greatest.

    Every part holds both classes and at least ``min_share`` of the rows; the share of bad rows only rises or only falls from part to part, unless
    the trend is "any". Fewer parts win a tie. Without a valid split, or with one class, there are no cuts.

    Dynamic programme over (start, end) of the last part: what may come before it depends on nothing else.
    """
    if trend not in TRENDS:
        raise ValueError(f"unknown trend {trend!r}; choose one of {TRENDS}")
    n, g, b = len(good), np.append(0, np.cumsum(good)).astype(float), np.append(0, np.cumsum(bad)).astype(float)
    if n == 0 or not g[-1] or not b[-1]:
        return []
    start, end = np.meshgrid(np.arange(n + 1), np.arange(n + 1), indexing="ij")
    in_good, in_bad = g[end] - g[start], b[end] - b[start]
    fits = (end > start) & (in_good > 0) & (in_bad > 0) & (in_good + in_bad >= min_share * (g[-1] + b[-1]))
    with np.errstate(divide="ignore", invalid="ignore"):
        pg, pb = in_good / g[-1], in_bad / b[-1]
        iv, rate = np.where(fits, (pb - pg) * np.log(pb / pg), -np.inf), in_bad / (in_good + in_bad)
    best: tuple[float, list[int]] = (-np.inf, [])
    for way in {"any": (0,), "monotone": (1, -1), "rising": (1,), "falling": (-1,)}[trend]:
        value = np.where(start == 0, iv, -np.inf)  # of the parts up to a last part from start to end
        came: list[np.ndarray] = []
        for k in range(1, bins + 1):
            if k > 1:
                follows = np.full(value.shape, -np.inf)
                where = np.zeros(value.shape, int)
                for s in range(1, n):
                    before = value[:s, s]  # parts that end where this one starts
                    if not np.isfinite(before).any():
                        continue
                    step = (rate[s, s + 1:][None, :] - rate[:s, s][:, None]) * way
                    allowed = np.where((step > 0) | (way == 0), before[:, None], -np.inf)
                    where[s, s + 1:] = allowed.argmax(axis=0)
                    follows[s, s + 1:] = allowed.max(axis=0) + iv[s, s + 1:]
                came.append(where)
                value = follows
            last = int(value[:, n].argmax())
            if value[last, n] > best[0] + 1e-12:
                cuts, s, e = [], last, n
                for where in reversed(came):
                    cuts.append(s)
                    s, e = int(where[s, e]), s
                best = float(value[last, n]), cuts[::-1]
    return best[1]


def fit_woe_supervised(df: DataFrame, label: str, numeric: Sequence[str], text: Sequence[str] = (), fine: int = 50, bins: int = 8,
                       min_share: float = 0.05, trend: str = "monotone") -> WoeModel:
    """Evidence weights over supervised bins of the numeric columns; text columns have a bin a value, and missing values one of their own.

    The rows are counted once, by ``fine`` bins at percentiles; the cuts are chosen on those counts, features x fine of them, and coarse bins are
    sums of fine ones. The information value that chooses is that of the known values.
    """
    edges = quantile_edges(df, numeric, fine)
    counts = checkpointed(bin_counts(df, label, edges, text))
    found: dict[str, np.ndarray] = {f: np.zeros((2, len(edges[f]) + 1)) for f in numeric}
    for row in counts.where(F.col("feature").isin(list(numeric)) & (F.col("bin") != MISSING)).collect():  # at most features x fine
        found[row["feature"]][:, int(row["bin"])] = row["good"], row["bad"]
    coarse, names = {}, [("", "", "")]
    for f in numeric:
        cuts = best_cuts(*found[f], bins, min_share, trend)
        coarse[f] = [edges[f][c - 1] for c in cuts]
        names += [(f, str(k), str(int(np.searchsorted(cuts, k, side="right")))) for k in range(len(edges[f]) + 1)]
    to = counts.sparkSession.createDataFrame(names, "feature string, bin string, part string")
    merged = counts.join(F.broadcast(to), ["feature", "bin"], "left").groupBy("feature", F.coalesce("part", "bin").alias("bin")).agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return WoeModel(coarse, list(text), checkpointed(woe_from_counts(merged)))
