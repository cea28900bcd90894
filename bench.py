"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query runs BENCH_REPEATS times
(2 by default) in one session and the fastest run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskframe.catalog import QUERIES  # noqa: E402
from riskframe.session import local_session  # noqa: E402

HEADLINE = [
    "etl_flow", "profile_target", "split_stratified", "kfold_stratified", "sample_ratio_1_k", "over_sample", "smote",
    "impute_median", "preprocess_linear", "preprocess_boost", "woe_table", "sel_iv", "corr_matrix", "sel_mutual_info",
    "sel_f_classif", "sel_sequential", "gen_polynomial", "auc_exact", "roc_curve", "classification_report",
    "metrics_regression", "woe_transform", "apply_points", "apply_weighted_bins", "mon_performance", "drift_ks",
    "drift_chi2", "stream_volume", "train_lr", "train_ridge", "train_gbt", "train_rf",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="riskframe-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times, failed = {}, {}
    for name in HEADLINE:
        try:
            runs = []
            for _ in range(repeats):
                start = time.perf_counter()
                QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
            times[name] = round(min(runs), 3)
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {e}"[:200]
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus, "repeats": repeats}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
