import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import permutation


def linear(df):
    return df.withColumn("prediction", 2 * F.col("a") + F.col("b"))


@pytest.mark.parametrize(("n", "block"), [(500, 100_000), (500, 40), (4, 100_000), (37, 10)])
def test_same_as_moving_columns_by_hand(spark, n, block):
    rng = np.random.default_rng(n)
    d = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n), "c": rng.normal(size=n)})
    d["y"] = 2 * d["a"] + d["b"] + rng.normal(size=n) / 10
    got = permutation.permutation_importance(spark.createDataFrame(d).repartition(3), linear, "y", ["a", "b", "c"], ["id"], "r2", 3, block).toPandas()
    d = d.iloc[np.argsort([hashlib.md5(str(i).encode()).hexdigest() for i in d["id"]])].reset_index(drop=True)
    base = ((2 * d["a"] + d["b"] - d["y"]) ** 2).mean()
    for k, f in enumerate("abc"):
        falls = []
        for r in range(3):
            e = d.assign(**{f: np.roll(d[f], -(1 + (k * 3 + r) % (n - 1)))})
            falls.append((((2 * e["a"] + e["b"] - e["y"]) ** 2).mean() - base) / d["y"].var(ddof=0))
        row = got[got["feature"] == f].iloc[0]
        assert row["importance_mean"] == pytest.approx(np.mean(falls), abs=1e-9)
        assert row["importance_std"] == pytest.approx(np.std(falls), abs=1e-9)


def test_edges(spark):
    df = spark.createDataFrame([(1, 1.0, "x", 1, None), (2, None, "y", 0, None), (3, 2.0, None, None, 1)], "id int, a double, t string, y int, own int")

    def score(rows):
        return rows.withColumns({"probability": F.when(F.col("t") == "x", 0.9).otherwise(0.1), "prediction": (F.col("t") == "x").cast("double")})

    got = {r.feature: r for r in permutation.permutation_importance(df, score, "y", ["a", "t"], ["id"], "neg_log_loss", 2).collect()}
    assert got["a"].importance_mean == 0 and got["t"].importance_mean == pytest.approx(np.log(9))
    acc = permutation.permutation_importance(df, score, "y", ["a", "t"], ["id"]).where("feature = 't'").first()
    assert acc.importance_mean == 1.0 and acc.importance_std == 0
    one = permutation.permutation_importance(df.where("id = 1"), score, "y", ["t"], ["id"]).first()
    assert one.importance_mean == 0
    assert permutation.permutation_importance(df.where("id = 9"), score, "y", ["t"], ["id"]).first().importance_mean is None
    with pytest.raises(ValueError):
        permutation.permutation_importance(df, score, "y", ["t"], ["id"], "f1")
