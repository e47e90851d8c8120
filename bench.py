"""Time the headline queries: one JSON line.

Reads ``$BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on ``local[$BENCH_CPUS]``. Each query is
run to its last row. The learner table and its feature table are written once, timed as
``derive_students`` and ``store_features``. Names given as arguments replace the headline list.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

SHARED = os.environ.get("SHARED_DIR") or tempfile.mkdtemp(prefix="holdfast-shared-")
sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import registry  # noqa: E402
from catalog.students import student_table  # noqa: E402

HEADLINE = (
    "drop_duplicates",
    "clean",
    "clean_audit",
    "build_feature_set",
    "table_stats",
    "numeric_summary",
    "numeric_summary_lineitem",
    "correlation_matrix",
    "insights",
    "absence_box",
    "run_eda",
    "quality_report",
    "one_hot",
    "label_encode",
    "stratified_split",
    "standard_scale",
    "build_ml_dataset",
    "data_pipeline",
    "classification_metrics",
    "select_best",
    "score_display",
    "at_risk_filter",
    "drift_report",
    "user_activity",
    "train_logreg",
    "train_raw_balanced",
    "score_batch",
    "score_registered",
    "score_stream",
    "activity_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", SHARED)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {}

    start = time.perf_counter()
    student_table(spark, folder)
    queries["derive_students"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    registry.stored_features(spark, folder)
    queries["store_features"] = round(time.perf_counter() - start, 3)
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        queries[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
