"""Fit on the training table, apply to any table: impute, scale, encode.

A fit is a few aggregation jobs that leave a small parameter document; applying it is one
projection of built-in expressions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import drop_nan
from riskframe.functions.skew import HOT_SHARE, hot_keys, lookup
from riskframe.operators.ordering import constant_array, exact_percentiles, running_totals, with_position
from riskframe.sources.lineage import checkpointed

SHORT_LIST = 16

# What each model family does to numeric and categorical columns.
FAMILIES = {
    "LR": ("standard", "mode", "onehot"),
    "RIDGE": ("standard", "mode", "onehot"),
    "LOGISTIC": ("standard", "mode", "onehot"),
    "RF": ("none", "constant", "ordinal"),
    "RF_REG": ("none", "constant", "ordinal"),
    "RANDOMFOREST": ("none", "constant", "ordinal"),
    "XGB": ("none", "constant", "index"),
    "XGB_REG": ("none", "constant", "index"),
    "LGB": ("none", "constant", "index"),
    "LGB_REG": ("none", "constant", "index"),
}
OTHER_FAMILY = ("standard", "mode", "ordinal")


def family_steps(family: str) -> tuple[str, str, str]:
    """(numeric scaling, categorical imputation, encoding) of a model family."""
    return FAMILIES.get(family.upper(), OTHER_FAMILY)


# ---- statistics ----------------------------------------------------------------------

def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_percentiles(drop_nan(df, cols), cols, [0.5]).items()}


def means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    row = drop_nan(df, cols).agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}")
                                   for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, n) of all listed columns together; hot values combine before the shuffle."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return (text.unpivot([], list(cols), "feature", "value").where(F.col("value").isNotNull())
            .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column, the smallest one on a tie."""
    if not cols:
        return {}
    best = category_counts(df, cols).groupBy("feature").agg(
        F.min(F.struct((-F.col("n")).alias("o"), F.col("value"))).alias("b"))
    found = {r["feature"]: r["b"]["value"] for r in best.collect()}
    return {c: found.get(c) for c in cols}


def bounded_counts(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> dict[str, dict[str, int]]:
    """Value counts per column, a row a category on the driver; with ``limit``, columns with more distinct values are refused.

    For columns like identifiers use ``ordinal_table`` or ``sparse_onehot``, whose dictionaries stay tables.
    """
    if not cols:
        return {}
    counts = checkpointed(category_counts(df, cols))
    if limit is not None:
        wide = [r["feature"] for r in counts.groupBy("feature").count().where(F.col("count") > limit).collect()]
        if wide:
            raise ValueError(f"more than {limit} categories in {wide}: use ordinal_table or sparse_onehot")
    out: dict[str, dict[str, int]] = {c: {} for c in cols}
    for r in counts.collect():
        out[r["feature"]][r["value"]] = r["n"]
    return out


# ---- expressions ---------------------------------------------------------------------

def fill(name: str, value) -> Column:
    return F.col(f"`{name}`") if value is None else F.coalesce(F.col(f"`{name}`"), F.lit(value))


def standardised(x: Column, mean: float | None, std: float | None) -> Column:
    if mean is None:
        return x
    return (x - F.lit(mean)) / F.lit(std if std else 1.0)


def ordinal_code(x: Column, cats: Sequence[str]) -> Column:
    """Position in the sorted categories, -1 for anything else; for short lists."""
    code = F.lit(-1)
    for i, c in enumerate(cats):
        code = F.when(x == F.lit(c), F.lit(i)).otherwise(code)
    return code


def with_ordinal_code(df: DataFrame, x: Column, cats: Sequence[str], out: str) -> DataFrame:
    """As ordinal_code, by binary search: for long lists."""
    df = with_position(df, x, cats, out)
    table = constant_array(cats, "string")
    hit = F.coalesce(F.try_element_at(table, F.col(out) + 1) == x, F.lit(False))
    return df.withColumn(out, F.when(hit, F.col(out)).otherwise(F.lit(-1)))


def onehot_columns(name: str, x: Column, cats: Sequence[str]) -> list[Column]:
    return [F.coalesce((x == F.lit(c)).cast("int"), F.lit(0)).alias(f"{name}_{c}") for c in cats]


# ---- dictionaries of any size --------------------------------------------------------

def ordinal_table(train: DataFrame, col: str) -> DataFrame:
    """(col, code): each distinct training value with its rank, for any number of values."""
    ranked = running_totals(train.select(col).where(F.col(col).isNotNull()).distinct(), [], col,
                            {"one": F.lit(1)})
    return ranked.select(col, (F.col("one_cum") - 1).cast("long").alias("code"))


def encode_by_table(df: DataFrame, col: str, table: DataFrame, out: str | None = None) -> DataFrame:
    """Replace a column by its code, -1 if unseen. Spark picks the join by the table's size."""
    out = out or col
    joined = df.join(table.withColumnRenamed("code", "_code"), col, "left")
    return joined.withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_code")


def sparse_onehot(df: DataFrame, col: str, table: DataFrame, out: str | None = None) -> DataFrame:
    """Append a sparse vector with a 1 at the code of the value, for any number of values; unseen and missing ones are all 0.

    The dictionary (``ordinal_table``) stays a table, and planning does not depend on its size.
    """
    out = out or f"{col}_vector"
    n = table.count()
    code = f"_{out}_code"
    coded = encode_by_table(df, col, table, code).withColumn(code, F.when(F.col(code) < 0, F.lit(n)).otherwise(F.col(code)).cast("double"))
    model = OneHotEncoder(inputCol=code, outputCol=out, dropLast=True)  # the last place is that of unknown values
    sizes = df.sparkSession.createDataFrame([(float(n),)], f"{code} double")
    return model.fit(sizes).transform(coded).drop(code)


# ---- estimator -----------------------------------------------------------------------

class _PreprocessParams(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric columns", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "categorical columns",
                            TypeConverters.toListString)
    family = Param(Params._dummy(), "family", "model family", TypeConverters.toString)
    numericImpute = Param(Params._dummy(), "numericImpute", "median or mean", TypeConverters.toString)
    scale = Param(Params._dummy(), "scale", "family, none, standard, minmax or robust", TypeConverters.toString)
    outliers = Param(Params._dummy(), "outliers", "none, iqr or zscore", TypeConverters.toString)
    outlierLimit = Param(Params._dummy(), "outlierLimit", "multiple of the IQR or of the deviation",
                         TypeConverters.toFloat)


class TabularPreprocessor(Estimator, _PreprocessParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns fills, scales and categories; columns not listed pass through untouched."""

    @keyword_only
    def __init__(self, *, numericCols=None, categoricalCols=None, family="LR", numericImpute="median",
                 scale="family", outliers="none", outlierLimit=1.5):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], family="LR", numericImpute="median",
                         scale="family", outliers="none", outlierLimit=1.5)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "TabularPreprocessorModel":
        num = list(self.getOrDefault(self.numericCols))
        cat = list(self.getOrDefault(self.categoricalCols))
        scaling, cat_fill, encoding = family_steps(self.getOrDefault(self.family))
        if self.getOrDefault(self.scale) != "family":
            scaling = self.getOrDefault(self.scale)
        spec: dict = {"encoding": encoding, "numeric": [], "categorical": []}
        if num:
            spec["numeric"] = self._fit_numeric(drop_nan(df, num), num, scaling)
        if cat:
            spec["categorical"] = self._fit_categorical(df, cat, cat_fill)
        return TabularPreprocessorModel(spec=json.dumps(spec))

    def _fit_categorical(self, df: DataFrame, cat: list[str], rule: str) -> list[dict]:
        """Fill value and sorted categories of every column, from one count of the values."""
        text = df.select(*[F.col(c).cast("string").alias(c) for c in cat])
        if rule == "constant":
            text = text.select(*[fill(c, "missing").alias(c) for c in cat])
        counts = bounded_counts(text, cat)
        steps = []
        for c in cat:
            common = min(counts[c], key=lambda v: (-counts[c][v], v), default=None)
            steps.append({"col": c, "fill": common if rule == "mode" else "missing", "cats": sorted(counts[c])})
        return steps

    def _fit_numeric(self, df: DataFrame, num: list[str], scaling: str) -> list[dict]:
        rule, limit = self.getOrDefault(self.outliers), self.getOrDefault(self.outlierLimit)
        use_median = self.getOrDefault(self.numericImpute) == "median"
        quart = {}
        if use_median or rule == "iqr" or scaling == "robust":
            quart = exact_percentiles(df, num, [0.25, 0.5, 0.75])
        plain = {}
        if not use_median or rule == "zscore":
            row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(num)],
                         *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")
                           for i, c in enumerate(num)]).first()
            plain = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(num)}
        steps = []
        for c in num:
            step = {"col": c, "fill": quart[c][1] if use_median else plain[c][0]}
            if rule == "iqr" and quart[c][0] is not None:
                iqr = quart[c][2] - quart[c][0]
                step["low"], step["high"] = quart[c][0] - limit * iqr, quart[c][2] + limit * iqr
            elif rule == "zscore" and plain[c][0] is not None:
                m, s = plain[c]
                step["low"], step["high"] = m - limit * s, m + limit * s
            steps.append(step)
        if scaling in ("standard", "minmax"):
            filled = df.select(*[_numeric_value(s).alias(f"c{i}") for i, s in enumerate(steps)])
            a, b = (F.avg, F.stddev_pop) if scaling == "standard" else (F.min, F.max)
            row = filled.agg(*[a(f"c{i}").alias(f"a{i}") for i in range(len(steps))],
                             *[b(f"c{i}").alias(f"b{i}") for i in range(len(steps))]).first()
            for i, s in enumerate(steps):
                if row[f"a{i}"] is None:
                    continue
                s["shift"] = row[f"a{i}"]
                spread = row[f"b{i}"] if scaling == "standard" else row[f"b{i}"] - row[f"a{i}"]
                s["spread"] = spread or 1.0
        elif scaling == "robust":
            for s in steps:
                q = quart[s["col"]]
                if q[1] is not None:
                    s["shift"], s["spread"] = q[1], (q[2] - q[0]) or 1.0
        return steps


def _numeric_value(step: dict) -> Column:
    c = F.col(f"`{step['col']}`").cast("double")
    x = F.when(~F.isnan(c), c)
    if step["fill"] is not None:
        x = F.coalesce(x, F.lit(float(step["fill"])))
    if "low" in step:
        x = F.greatest(F.least(x, F.lit(step["high"])), F.lit(step["low"]))
    return x


class TabularPreprocessorModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    spec = Param(Params._dummy(), "spec", "fitted parameters as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, spec="{}"):
        super().__init__()
        self._setDefault(spec="{}")
        self._set(**self._input_kwargs)

    @property
    def parameters(self) -> dict:
        return json.loads(self.getOrDefault(self.spec))

    def outputs(self) -> dict[str, str]:
        """Feature column -> the source column it was made from."""
        p = self.parameters
        out = {s["col"]: s["col"] for s in p.get("numeric", [])}
        for s in p.get("categorical", []):
            names = [f"{s['col']}_{c}" for c in s["cats"]] if p["encoding"] == "onehot" else [s["col"]]
            out.update({n: s["col"] for n in names})
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.parameters
        if not p:
            raise ValueError("the preprocessor has not been fitted")
        numeric = {s["col"]: s for s in p["numeric"]}
        text = {s["col"]: s for s in p["categorical"]}
        cols: list[Column] = []
        names = df.columns
        for name, s in text.items():
            if p["encoding"] != "onehot" and len(s["cats"]) > SHORT_LIST:
                df = with_ordinal_code(df, fill(name, s["fill"]).cast("string"), s["cats"], f"_code_{name}")
        for name in names:
            if name in numeric:
                s = numeric[name]
                x = _numeric_value(s)
                if "shift" in s:
                    x = (x - F.lit(s["shift"])) / F.lit(s["spread"])
                cols.append(x.alias(name))
            elif name in text:
                s = text[name]
                x = fill(name, s["fill"]).cast("string")
                if p["encoding"] == "onehot":
                    cols.extend(onehot_columns(name, x, s["cats"]))
                    continue
                code = F.col(f"`_code_{name}`") if f"_code_{name}" in df.columns else ordinal_code(x, s["cats"])
                if p["encoding"] == "index":
                    # boosters treat the column as nominal: unseen values share one extra level
                    code = F.when(code < 0, F.lit(len(s["cats"]))).otherwise(code).cast("double")
                    levels = {"ml_attr": {"type": "nominal", "name": name,
                                          "vals": [*s["cats"], "__unseen"]}}
                    cols.append(code.alias(name, metadata=levels))
                else:
                    cols.append(code.alias(name))
            else:
                cols.append(F.col(f"`{name}`"))
        return df.select(*cols)


# ---- further transforms --------------------------------------------------------------

def log_transform(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Signed log1p, so that negative values stay defined; NaN is missing."""
    return drop_nan(df, cols).withColumns({c: F.signum(F.col(c)) * F.log1p(F.abs(F.col(c))) for c in cols})


def quantile_rank(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Share of rows with a value at or below each row's value, in (0, 1]; NULL stays NULL, NaN is missing.

    A value with a large share of the rows is not gathered: hot values find their rank where their rows are.
    """
    df = drop_nan(df, [col])
    ranks = checkpointed(running_totals(df.select(col), [], col, {"n": F.lit(1)}).select(
        col, "n", "n_all", (F.col("n_cum") / F.col("n_all")).alias("_rank")))
    hot = hot_keys(ranks.select(col, "n", "n_all"), col, F.col("n") > F.col("n_all") / HOT_SHARE)
    return lookup(df, ranks.select(col, "_rank"), col, hot).withColumn(out or f"{col}_rank", F.col("_rank")).drop("_rank")


POWER_GRID = [g / 4 for g in range(-8, 9)]


def power_lambda(df: DataFrame, cols: Sequence[str], grid: Sequence[float] = POWER_GRID,
                 method: str = "yeo-johnson") -> DataFrame:
    """(feature, lambda, log_likelihood): the best power of each column on a grid.

    One pass: every (column, power) pair adds a variance to the same aggregate. Box-Cox
    needs positive values; a column without them gets no row.
    """
    num = drop_nan(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        slope = F.signum(x) * F.log1p(F.abs(x)) if method == "yeo-johnson" else F.log(F.when(x > 0, x))
        aggs += [F.count(c).alias(f"n{i}"), F.sum(slope).alias(f"l{i}"), F.min(c).alias(f"m{i}")]
        aggs += [F.var_pop(power(x, g, method)).alias(f"v{i}_{j}") for j, g in enumerate(grid)]
    wide = num.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        allowed = F.lit(True) if method == "yeo-johnson" else F.col(f"m{i}") > 0
        for j, g in enumerate(grid):
            v = F.col(f"v{i}_{j}")
            ll = F.when(allowed & (v > 0), -F.col(f"n{i}") / 2 * F.log(v) + F.lit(g - 1) * F.col(f"l{i}"))
            rows.append(F.struct(F.lit(c).alias("feature"), F.lit(float(g)).alias("lambda"),
                                 ll.alias("log_likelihood")))
    scores = wide.select(F.inline(F.array(*rows))).where(F.col("log_likelihood").isNotNull())
    top = scores.groupBy("feature").agg(F.max(F.struct("log_likelihood", -F.abs(F.col("lambda") - 1),
                                                       "lambda")).alias("b"))
    return top.select("feature", F.col("b.lambda").alias("lambda"),
                      F.col("b.log_likelihood").alias("log_likelihood"))


def power_transform(df: DataFrame, cols: Sequence[str], grid: Sequence[float] = POWER_GRID,
                    method: str = "yeo-johnson") -> DataFrame:
    """Replace each column by its best power; columns without one stay as they are."""
    best = {r["feature"]: r["lambda"] for r in power_lambda(df, cols, grid, method).collect()}
    return df.withColumns({c: power(F.col(c).cast("double"), g, method) for c, g in best.items()})


def power(x: Column, exponent: float, method: str = "yeo-johnson") -> Column:
    if method == "box-cox":
        y = F.log(x) if abs(exponent) < 1e-9 else (F.pow(x, F.lit(exponent)) - 1) / F.lit(exponent)
        return F.when(x > 0, y)
    up = F.log1p(x) if abs(exponent) < 1e-9 else (F.pow(x + 1, F.lit(exponent)) - 1) / F.lit(exponent)
    down = (-F.log1p(-x) if abs(exponent - 2) < 1e-9
            else -(F.pow(1 - x, F.lit(2 - exponent)) - 1) / F.lit(2 - exponent))
    return F.when(x >= 0, up).when(x < 0, down)


def target_encode(df: DataFrame, col: str, target: str, fold: str, smoothing: float = 10.0,
                  out: str | None = None) -> DataFrame:
    """Out-of-fold smoothed mean of the target: no row sees its own fold.

    One grouping by (value, fold); the other folds are the value's total minus the own fold.
    """
    y = F.col(target).cast("double")
    part = df.groupBy(col, fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    value = Window.partitionBy(col)
    overall = df.groupBy(fold).agg(F.sum(y).alias("_fs"), F.count(y).alias("_fn"))
    every = Window.partitionBy()  # one row per fold
    prior = overall.select(fold, ((F.sum("_fs").over(every) - F.col("_fs"))
                                  / (F.sum("_fn").over(every) - F.col("_fn"))).alias("_prior"))
    stats = (part.select(col, fold, (F.sum("_s").over(value) - F.col("_s")).alias("_os"),
                         (F.sum("_n").over(value) - F.col("_n")).alias("_on"))
             .join(F.broadcast(prior), fold)
             .select(col, fold, ((F.col("_os") + F.lit(smoothing) * F.col("_prior"))
                                 / (F.col("_on") + F.lit(smoothing))).alias("_te")))
    keyed = df.join(stats.withColumnsRenamed({col: "_v", fold: "_f"}),
                    F.col(col).eqNullSafe(F.col("_v")) & (F.col(fold) == F.col("_f")), "left")
    return keyed.withColumn(out or f"{col}_te", F.col("_te")).drop("_v", "_f", "_te")
