"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) set the data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.queries import QUERIES  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
HEADLINE = [
    "enriched_rows", "graduation_labels", "progress_snapshots", "granular_snapshots",
    "student_profiles", "attendance_trend", "correlation_matrix", "correlation_matrix_rows", "target_correlation",
    "anova_grade_by_outcome", "chi_square_attendance", "retention_rate_by_band",
    "grade_histogram", "box_by_outcome", "backlog_box", "kde_by_outcome", "trend_bootstrap",
    "normalized_text", "subject_classification", "category_merge", "deterministic_sample",
    "profile_overview", "profile_numeric", "profile_categorical",
]


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="cohortline-"))
        .config("spark.log.level", "ERROR")
        .getOrCreate())
    # start-up cost of the session and of the first scan belongs to no query
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(FOLDER.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
