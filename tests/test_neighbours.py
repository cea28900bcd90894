import random

import numpy as np
import pytest

from riskframe.operators import neighbours


def brute(points, k):
    out = {}
    for a, v in points:
        near = sorted((round(float(np.linalg.norm(np.array(v) - np.array(w))), 9), b) for b, w in points if b != a)
        out[a] = near[:k]
    return out


def found(df):
    return {r["key"]: [(e["distance"], e["key"]) for e in r["neighbours"]] for r in df.collect()}


def points_frame(spark, points):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in points], "key long, v array<double>").repartition(3)


@pytest.mark.parametrize("block", [2048, 16])
def test_equal_to_brute_force(spark, block):
    rng = random.Random(1)
    centres = [[rng.uniform(-50, 50) for _ in range(3)] for _ in range(6)]
    points = [(i, [c + rng.gauss(0, 1) for c in centres[i % 6]]) for i in range(400)]
    got = found(neighbours.vector_neighbours(points_frame(spark, points), 5, block))
    assert got == brute(points, 5)


def test_few_cells_are_looked_at_in_few_dimensions():
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (4000, 2))
    pivots = x[:63]
    d = neighbours._distances(x, pivots)
    cell = d.argmin(axis=1)
    counts = np.bincount(cell, minlength=63)
    reach = d[np.arange(4000), cell]
    radius, hole = np.zeros(63), np.zeros(63)
    for c in range(63):
        radius[c], hole[c] = reach[cell == c].max(), reach[cell == c].min()
    share = np.concatenate([neighbours._reachable(x[cell == c], pivots, counts, radius, hole, 5, 1e-8).mean(axis=1) for c in range(63)])
    assert share.mean() < 0.06  # of 63 cells fewer than four


def test_copies_and_ties_are_ordered_by_key(spark):
    # a third of all rows are copies of one vector, the others lie on a grid
    points = [(i, [0.0, 0.0]) for i in range(100, 200)] + [(i, [float(i % 14), float(i // 14)]) for i in range(100)]
    got = found(neighbours.vector_neighbours(points_frame(spark, points), 5, block=16))
    assert got == brute(points, 5)


def test_smote_balances_and_stays_between_neighbours(spark):
    rng = random.Random(2)
    data = [(i, rng.gauss(0, 1), rng.gauss(0, 1), int(i < 23)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, a double, b double, label int")
    out = neighbours.smote(df, "id", "label", ["a", "b"]).collect()
    assert sum(r["label"] for r in out) == 277 and len(out) == 2 * 277
    near = brute([(i, (a, b)) for i, a, b, y in data if y], 5)
    where = {i: (a, b) for i, a, b, _ in data}
    for r in out:
        if r["copy"]:
            boxes = [(where[r["id"]], where[o]) for _, o in near[r["id"]]]
            assert any(all(min(p[i], q[i]) - 1e-9 <= r[c] <= max(p[i], q[i]) + 1e-9 for i, c in enumerate(("a", "b")))
                       for p, q in boxes)
    assert len({(r["id"], r["copy"]) for r in out}) == len(out)


def test_too_few_minority_rows(spark):
    df = spark.createDataFrame([(i, 1.0 * i, int(i < 5)) for i in range(20)], "id long, a double, label int")
    with pytest.raises(ValueError):
        neighbours.smote(df, "id", "label", ["a"])
