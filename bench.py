"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local cores,
BENCH_RUNS the timed runs per query (after one warm-up, but for the longest), BENCH_ALL=1 times
every registered query.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.plans.registry import QUERIES  # noqa: E402
from millrace.session import local_session  # noqa: E402

HEADLINE = [
    "describe_numeric", "describe_categorical", "missing_summary", "correlation_matrix", "skew_kurtosis",
    "duplicate_count", "drop_duplicates", "convert_int", "impute_ffill", "impute_median", "impute_interpolate",
    "encode_label", "encode_onehot", "encode_label_orderkey", "scale_standard_lineitem", "scale_robust_lineitem",
    "scale_quantile", "scale_boxcox", "iqr_outliers", "qq_fit", "ks_statistic", "anderson_statistic", "shapiro",
    "ttest", "anova", "mannwhitney", "kruskal", "wilcoxon", "chi_square", "chart_box", "chart_histogram_all",
    "chart_violin", "chart_histcontour", "chart_scatter_sampled", "chart_box_user", "ts_pattern", "ts_resample_d_mean",
    "ts_lags", "ts_forecast", "automl_classify", "automl_regress", "cluster_embeddings", "prepared_customers",
]
# Fits of many trees and models: timed once, without a warm-up.
LONG = {"ts_forecast", "automl_classify", "automl_regress"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    shared = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-shared-")}
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", **shared)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(1 if name in LONG else runs + 1):
            start = time.perf_counter()
            QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    found = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
