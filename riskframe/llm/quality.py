"""Document quality: a classifier's evidence combined with what is known of the document's site, by hierarchical empirical Bayes.

The classifier is a logistic regression over measures of the text, fitted to a bounded sample of labelled rows. A host's
posterior mean comes from all its documents (their label where one may be learned from, else the classifier's
probability), shrunk towards the global mean; a path's is shrunk towards its host's. How strongly, follows from how much the rates of hosts (of paths
within hosts) differ beyond chance. The site's log-odds against the global ones are added to those of the classifier.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import HOT_SHARE, checkpointed, hot_keys, lookup, texts
from riskframe.llm.labelled import labels_to_learn, logistic, sample

KEEP = 0.5
UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
LOWER, SIGN = bytes(range(97, 123)), b"#$%&*|~^=+<>{}[]\\/_@"


def measures(text: str) -> list[float]:
    """Numbers that describe a text: variety and repetition of words and lines, and shares of kinds of characters."""
    words, data = text.split(), text.encode("utf-8", "replace")
    n, size = len(words), len(data)
    if not n:
        return [0.0] * 16
    share = lambda kind: 1 - len(data.translate(None, kind)) / size
    counts = Counter(words)
    lines = text.split("\n")
    pairs = n - 1
    return [
        math.log1p(n),
        len(counts) / n ** 0.8,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / max(1, pairs),
        len(set(zip(words, words[1:], strict=False))) / max(1, pairs),
        len(set(lines)) / len(lines),
        math.log1p(len(lines)) - math.log1p(n),
        (size - n) / n / 10,
        share(UPPER),
        share(DIGIT),
        share(SIGN),
        share(b"|"),
        share(b"!"),
        share(b".,;:'\"()-"),
        share(LOWER),
        max(map(len, lines)) / size,
    ]


@dataclass
class Classifier:
    mean: list[float]
    scale: list[float]
    beta: list[float]

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = expanded((x - np.asarray(self.mean)) / np.asarray(self.scale))
        return np.clip(z @ np.asarray(self.beta[:-1]) + self.beta[-1], -12, 12)


def expanded(z: np.ndarray) -> np.ndarray:
    """Measures and their squares, bounded so that an odd text cannot leave the range of the fit by far."""
    z = np.clip(z, -8, 8)
    return np.concatenate([z, z * z / 4], axis=1)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 8000, id_col: str = "doc_id",
          text_col: str = "text") -> Classifier | None:
    """Fit to about ``most`` labelled documents of each class, held-out rows left aside; None without both classes."""
    chosen = F.broadcast(sample(labels_to_learn(labels, label), most))  # 2 x most rows

    def work(batches):
        for batch in batches:
            x = [measures(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    rows = texts(docs, id_col, text_col).join(chosen, "doc_id").select("text", "label").mapInArrow(work, "x array<double>, label int")
    fit = sorted(rows.collect(), key=lambda r: (r.label, r.x))
    y = np.array([r.label for r in fit], float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.array([r.x for r in fit])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    return Classifier(mean.tolist(), scale.tolist(), logistic(expanded((x - mean) / scale), y).tolist())


def evidence(model: Classifier | None, text: Column) -> Column:
    """The classifier's log-odds of good quality; 0 without a model. The whole text is read."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([measures(t or "") for t in batch]).reshape(len(batch), -1)
            yield pd.Series(model.logits(x) if model is not None and len(batch) else np.zeros(len(batch)))

    return F.pandas_udf(work, "double")(text)


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _strength(rates: DataFrame, mean: Column) -> Column:
    """The prior's weight in documents: binomial variance over the variance between groups beyond chance (method of moments)."""
    noise = mean * (1 - mean)
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2)) / F.sum("n")
    chance = F.sum(noise) / F.sum("n")
    return rates.agg(F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.avg(noise) / F.greatest(spread - chance, F.lit(1e-9)))).alias("k"))


def site_posteriors(rows: DataFrame, host: str = "host", path: str = "path", good: str = "good") -> tuple[DataFrame, float]:
    """(host, path, n, posterior) for every path, and the global mean. ``rows`` has a probability of good quality a document.

    Null hosts and paths are sites of their own.
    """
    paths = checkpointed(rows.groupBy(host, path).agg(F.count("*").alias("n"), F.sum(good).alias("good")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    if not total.n:
        return paths.select(F.col(host).alias("host"), F.col(path).alias("path"), "n", F.lit(0.5).alias("posterior")), 0.5
    mean = min(1 - 1e-6, max(1e-6, total.good / total.n))
    hosts = checkpointed(paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(mean)))
    k = _strength(hosts, F.col("prior")).first().k
    hosts = hosts.select(F.col(host).alias("_host"), ((F.col("good") + k * mean) / (F.col("n") + k)).alias("prior"))
    within = paths.join(hosts, F.col(host).eqNullSafe(F.col("_host"))).drop("_host")
    k2 = _strength(within, F.col("prior")).first().k
    return within.select(F.col(host).alias("host"), F.col(path).alias("path"), "n",
                         ((F.col("good") + k2 * F.col("prior")) / (F.col("n") + k2)).alias("posterior")), mean


def site(docs: DataFrame, columns: Sequence[str]) -> Column:
    """A text key of site columns; a null is a value of its own."""
    return F.to_json(F.array(*[docs[c].cast("string") for c in columns]), {"ignoreNullFields": "false"})


@dataclass
class Model:
    """Everything a document's score needs."""

    classifier: Classifier | None
    sites: DataFrame  # (site, n, lift): log-odds of a path against the global ones
    few: bool  # at most HOT_SHARE sites
    hot: DataFrame | None

    def lifted(self, rows: DataFrame, key: str, to: str) -> DataFrame:
        """The rows with their site's lift; few sites go to all tasks, of many only the hot ones."""
        lifts = self.sites.select(F.col("site").alias(key), F.col("lift").alias(to))
        found = rows.join(F.broadcast(lifts), key, "left") if self.few else lookup(rows, lifts, key, None if self.hot is None else self.hot.withColumnRenamed("site", key))
        return found.withColumn(to, F.coalesce(to, F.lit(0.0)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", host: Sequence[str] = ("source",), path: Sequence[str] = ("source", "lang"),
        id_col: str = "doc_id", text_col: str = "text", **kwargs) -> Model:
    """Learn the classifier and the posteriors of all sites of docs; hosts and paths are named by columns (path includes host)."""
    classifier = learn(docs, labels, label, id_col=id_col, text_col=text_col, **kwargs)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), site(docs, host).alias("host"), site(docs, path).alias("path"),
                       _probability(evidence(classifier, docs[text_col].cast("string"))).alias("p"))
    known = labels_to_learn(labels, label)
    rows = rows.join(known, "doc_id", "left").select("host", "path", F.coalesce(F.col("label").cast("double"), "p").alias("good"))
    sites, mean = site_posteriors(rows)
    mean_logit = math.log(mean / (1 - mean))
    sites = checkpointed(sites.select(F.col("path").alias("site"), "n", (F.ln(F.col("posterior") / (1 - F.col("posterior"))) - mean_logit).alias("lift")))
    few = sites.count() <= HOT_SHARE
    total = sites.agg(F.sum("n").alias("n")).first().n or 0
    return Model(classifier, sites, few, None if few else hot_keys(sites, "site", "n", total))


def scored(docs: DataFrame, model: Model, path: Sequence[str] = ("source", "lang"), text_col: str = "text", to: str = "quality_score") -> DataFrame:
    """All rows and columns of docs with the score, 0 to 1, in ``to`` (which docs must not have)."""
    found = model.lifted(docs.withColumn(f"{to}_site", site(docs, path)), f"{to}_site", f"{to}_lift")
    logit = evidence(model.classifier, F.col(f"`{text_col}`").cast("string")) + F.col(f"{to}_lift")
    return found.withColumn(to, _probability(logit)).drop(f"{to}_site", f"{to}_lift")


def judge(docs: DataFrame, labels: DataFrame, keep: float = KEEP, host: Sequence[str] = ("source",), path: Sequence[str] = ("source", "lang"),
          id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """(doc_id, evidence, site_lift, score, kept) for every row: log-odds of the text, what the site adds, their probability.

    Null and empty texts are measured as empty; null hosts and paths are sites of their own; null ids and repeated rows are
    kept. An empty table gives no rows; without labels of both classes the evidence is 0 and every score 0.5 (kept).
    """
    model = fit(docs, labels, host=host, path=path, id_col=id_col, text_col=text_col, **kwargs)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), site(docs, path).alias("site"))
    found = model.lifted(rows, "site", "site_lift").withColumn("evidence", evidence(model.classifier, F.col("text")))
    score = _probability(F.col("evidence") + F.col("site_lift"))
    return found.select("doc_id", "evidence", "site_lift", score.alias("score"), (score >= keep).cast("int").alias("kept"))
