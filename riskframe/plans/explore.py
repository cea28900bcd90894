"""Data exploration: which features are worth training on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from riskframe.operators.preprocess import TabularPreprocessor, TabularPreprocessorModel
from riskframe.operators.screening import FeatureSelector, missing_rates
from riskframe.sources.reports import feature_list


@dataclass
class Exploration:
    prep: TabularPreprocessorModel
    selector: FeatureSelector
    features: list[str]  # selected columns of the preprocessed table
    sources: list[str]  # the raw columns they are made from, in schema order


def explore_features(train: DataFrame, label: str, numeric: Sequence[str], text: Sequence[str] = (),
                     family: str = "LR", task: str = "classification",
                     methods: Sequence[str] = ("missing_rate", "correlation", "variance"),
                     **thresholds) -> Exploration:
    """Missing-rate screen on raw columns, then preprocessing without scaling, then the other screens.

    Scaling would give every column variance 1 and imputation would hide missing values, so
    both screens would be blind after the full preprocessing.
    """
    limit = thresholds.get("missing_rate_threshold", 0.5)
    sparse: list[str] = []
    if "missing_rate" in methods:
        rates = missing_rates(train, [*numeric, *text], limit)
        sparse = [r["feature"] for r in rates.where("NOT kept").collect()]
    num, cat = [c for c in numeric if c not in sparse], [c for c in text if c not in sparse]
    prep = TabularPreprocessor(numericCols=num, categoricalCols=cat, family=family, scale="none").fit(train)
    selector = FeatureSelector(label, task, [m for m in methods if m != "missing_rate"], family=family, **thresholds)
    selector.fit(prep.transform(train), list(prep.outputs()))
    if "missing_rate" in methods:
        selector.removed = {"missing_rate": sparse, **selector.removed}
    chosen = selector.get_selected_features()
    origin = prep.outputs()
    used = {origin[c] for c in chosen}
    return Exploration(prep, selector, chosen, [c for c in train.columns if c in used])


def save_features(train: DataFrame, found: Exploration, name: str, path: str, created: datetime) -> None:
    feature_list(train.sparkSession, name, found.features, created).write.mode("overwrite").json(path)
