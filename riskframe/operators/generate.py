"""New columns made from existing ones."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import drop_nan, interval_bin
from riskframe.operators.clean import split_by_type
from riskframe.operators.ordering import cut_points, with_range
from riskframe.operators.screening import quantile_edges


def _guard(n: int, most: int | None) -> None:
    if most is not None and n > most:
        raise ValueError(f"{n} new columns asked for, at most {most} are allowed")


def polynomial_terms(cols: Sequence[str], degree: int = 2, bias: bool = False) -> dict[str, tuple[str, ...]]:
    """Name of each term -> its factors: 'a^2' is (a, a), 'a b' is (a, b), '1' is ()."""
    terms: dict[str, tuple[str, ...]] = {"1": ()} if bias else {}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            name = " ".join(c if combo.count(c) == 1 else f"{c}^{combo.count(c)}" for c in dict.fromkeys(combo))
            terms[name] = combo
    return terms


def add_polynomial(df: DataFrame, cols: Sequence[str] | None = None, degree: int = 2,
                   bias: bool = False, most: int | None = None) -> DataFrame:
    """Append every polynomial term of the numeric columns that is not a column already; more than ``most`` are refused."""
    cols = list(cols) if cols is not None else split_by_type(df, df.columns)[0]
    terms = {n: t for n, t in polynomial_terms(cols, degree, bias).items() if n not in df.columns}
    _guard(len(terms), most)
    new = []
    for name, factors in terms.items():
        e = F.lit(1.0)
        for i, f in enumerate(factors):
            x = F.col(f"`{f}`").cast("double")
            e = x if i == 0 else e * x
        new.append(e.alias(name))
    return df.select("*", *new)


def interaction_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """The pairs to multiply: all pairs of numeric columns, or the listed ones that are numeric."""
    num = split_by_type(df, df.columns)[0]
    if pairs is None:
        return list(combinations(num, 2))
    return [(a, b) for a, b in pairs if a in set(num) and b in set(num)]


def add_interactions(df: DataFrame, pairs: Sequence[tuple[str, str]] | None = None,
                     most: int | None = None) -> DataFrame:
    """Append ``a_x_b`` products; more than ``most`` are refused."""
    todo = interaction_pairs(df, pairs)
    _guard(len(todo), most)
    return df.select("*", *[(F.col(f"`{a}`").cast("double") * F.col(f"`{b}`").cast("double")).alias(f"{a}_x_{b}")
                            for a, b in todo])


def generate(df: DataFrame, polynomial: bool = False, degree: int = 2, bias: bool = False,
             interaction: bool = False, pairs: Sequence[tuple[str, str]] | None = None
             ) -> tuple[DataFrame, DataFrame]:
    """Polynomial terms first, then products over all columns present by then.

    Also returns the summary (feature, type) of what was added.
    """
    made: list[tuple[str, str]] = []
    out = df
    if polynomial:
        wider = add_polynomial(out, degree=degree, bias=bias)
        made += [(c, "polynomial") for c in wider.columns if c not in out.columns]
        out = wider
    if interaction:
        wider = add_interactions(out, pairs)
        made += [(c, "interaction") for c in wider.columns if c not in out.columns]
        out = wider
    return out, df.sparkSession.createDataFrame(made, "feature string, type string")


def add_group_statistics(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Mean, deviation, minimum and maximum of each column within the row's group.

    The grouping combines map-side; the join back is left to Spark, which broadcasts the
    statistics when they are small and splits skewed keys when they are not.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}_mean_by_{group}"), F.stddev_samp(x).alias(f"{c}_std_by_{group}"),
                 F.min(x).alias(f"{c}_min_by_{group}"), F.max(x).alias(f"{c}_max_by_{group}")]
    return df.join(df.groupBy(group).agg(*aggs), group, "left")


def add_bins(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Append ``<col>_bin``: the number of the equal-frequency bin, NULL for a missing value."""
    edges = quantile_edges(df, cols, bins)
    clean = drop_nan(df, cols)
    return clean.withColumns({f"{c}_bin": interval_bin(F.col(c).cast("double"), e) for c, e in edges.items()})


def add_components(df: DataFrame, cols: Sequence[str], k: int | None = None, share: float | None = None,
                   prefix: str = "pc") -> tuple[DataFrame, list[float]]:
    """Append principal components and return their variance shares.

    Give the number of components or the share of variance they must reach. Columns are
    used as they are: standardise them first if their units differ.
    """
    vectors = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df)
    model = PCA(k=len(cols), inputCol="_v", outputCol="_p").fit(vectors)
    shares = [float(x) for x in model.explainedVariance]
    if k is None:
        k, total = 0, 0.0
        while k < len(shares) and total < (1.0 if share is None else share):
            total += shares[k]
            k += 1
    parts = vector_to_array("_p")
    out = model.transform(vectors).select(*df.columns, *[parts[i].alias(f"{prefix}{i + 1}") for i in range(k)])
    return out, shares[:k]


def add_trailing(df: DataFrame, key: str, order: str, cols: Sequence[str], rows: int = 3,
                 tie: Sequence[str] = (), per_range: int | None = None) -> DataFrame:
    """Append the sum and mean over the current and the ``rows`` preceding rows of the same key.

    A key's history is cut into ranges of the order column so that a key with a large share
    of all rows does not land in one task. Each range also receives the last ``rows`` rows
    of what came before it, which is all a trailing frame can reach.
    """
    points = cut_points(df, [key], order, per_range)
    # a struct of NULL equals itself, so rows without a key keep theirs in the joins below
    tagged = with_range(df, order, points).withColumns({"_own": F.lit(True), "_g": F.struct(F.col(key).alias("k"))})
    sort = [F.col(order), *[F.col(t) for t in tie]]
    back = [F.col(order).desc(), *[F.col(t).desc() for t in tie]]
    # the last rows of each (key, range), handed on to the following occupied ranges of the key
    tail = (tagged.withColumn("_t", F.row_number().over(Window.partitionBy("_g", "_range").orderBy(*back)))
            .where(F.col("_t") <= rows).drop("_t"))
    sizes = tail.groupBy("_g", "_range").agg(F.count(F.lit(1)).alias("_n"))
    by_range = Window.partitionBy("_g").orderBy("_range")
    reach = sizes.withColumn("_next", F.collect_list(F.struct("_range", "_n")).over(
        by_range.rowsBetween(1, rows)))
    # a tail row is needed by later ranges until `rows` newer rows lie in between
    fed = reach.select("_g", "_range", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_next"), F.lit(1))),
        lambda i: F.struct(F.try_element_at("_next", i)["_range"].alias("to"),
                           F.aggregate(F.slice("_next", 1, i - 1), F.lit(0).cast("long"),
                                       lambda a, s: a + s["_n"]).alias("between")))).alias("_f"))
    fed = fed.where(F.col("_f.to").isNotNull() & (F.col("_f.between") < rows))
    halo = (tail.join(fed, ["_g", "_range"]).withColumn("_range", F.col("_f.to"))
            .withColumn("_own", F.lit(False)).drop("_f"))
    w = Window.partitionBy("_g", "_range").orderBy(*sort).rowsBetween(-rows, 0)
    both = tagged.unionByName(halo)
    new = {}
    for c in cols:
        new[f"{c}_sum_last_{rows}"] = F.sum(c).over(w)
        new[f"{c}_mean_last_{rows}"] = F.avg(c).over(w)
    return both.withColumns(new).where("_own").drop("_own", "_range", "_g")
