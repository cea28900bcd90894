"""From a raw table to a trained, evaluated and stored model; and many of them."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import evaluate, sampling, scoring, tuning
from riskframe.operators.models import task_of, train
from riskframe.sources import reports
from riskframe.sources.lineage import checkpointed


def evaluate_model(model: PipelineModel, df: DataFrame, label: str, task: str, split: str = "split") -> DataFrame:
    """Metrics of a scored table in long form, for every split in it."""
    scored = scoring.predict(model, df, task=task)
    return evaluate.evaluate_bundle(scored, task, label, "prediction",
                                    None if task == "regression" else "probability", split)


def train_and_evaluate(df: DataFrame, label: str, code: str, numeric: Sequence[str], text: Sequence[str] = (),
                       key: str = "key", sampler: str | None = None, data_name: str = "data", test_size: float = 0.3,
                       search: int = 0, folds: int = 5, space: Mapping | None = None, seed: int = 42,
                       results: str | None = None, **params) -> tuple[PipelineModel, dict]:
    """Split, optionally search, fit, evaluate both splits; returns the model and its result document.

    With ``results`` the document is also stored below that folder.
    """
    task = task_of(code)
    strata = label if task == "classification" else None
    split = sampling.with_split(df, [key], test_size, seed, strata).persist()
    fit_rows = split.where(F.col("split") == "train").drop("split")
    start = time.monotonic()
    best = dict(params)
    if search:
        folded = tuning.FoldedTable(fit_rows, label, code, numeric, text, key, folds, sampler, seed)
        found = tuning.best_trial(folded.search(tuning.random_candidates(code, search, seed, space)))
        folded.close()
        best.update(found.params)
    model = train(fit_rows, label, code, numeric, text, key, sampler, seed=seed, **best)
    seconds = time.monotonic() - start
    metrics: dict[str, dict] = {"train": {}, "test": {}}
    for r in evaluate_model(model, split, label, task).collect():  # a dozen rows
        metrics[r["split"]][r["metric"]] = r["value"]
    matrix = report = None
    if task == "classification":
        test = scoring.predict(model, split.where(F.col("split") == "test"))
        counted = checkpointed(evaluate.confusion_matrix(test, label, "prediction"))
        cells = {(r["label"], r["prediction"]): r["n"] for r in counted.collect()}  # classes squared
        report = {r["class"]: {m: float(r[m]) for m in ("precision", "recall", "f1", "support")}
                  for r in evaluate.report_from_matrix(counted).collect()}
        classes = sorted({c for pair in cells for c in pair})
        matrix = [[cells.get((a, b), 0) for b in classes] for a in classes]
    split.unpersist()
    document = {
        "model_name": code,
        "evaluation_results": {
            "model_name": code, "data_name": data_name, "imbalance_method": sampler or "none",
            "metrics": {"train_metrics": metrics["train"], "test_metrics": metrics["test"],
                        "detailed_report": {"confusion_matrix": matrix, "classification_report": report}},
            "best_params": best, "training_time": seconds,
            "feature_count": len(model.stages[0].outputs()), "status": "success"},
        "timestamp": datetime.now().isoformat(),
    }
    if results is not None:
        reports.write_result(df.sparkSession, results, document)
    return model, document


def train_many(df: DataFrame, label: str, jobs: Sequence[Mapping], numeric, text=(), key: str = "key",
               parallelism: int = 2, retries: int = 0, **shared) -> list[dict]:
    """Train every job (model code, sampler, settings) on one cached table; failures are recorded."""
    table = df.persist()
    try:
        return tuning.run_jobs(
            jobs, lambda code, sampler=None, **p: train_and_evaluate(
                table, label, code, numeric, text, key, sampler, **{**shared, **p})[1], parallelism, retries)
    finally:
        table.unpersist()
