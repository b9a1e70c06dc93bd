"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then RUNS times; the median is reported.
``a3_cached_series`` starts from the cached hourly series and reduces the
windows to one hash row, the conditions of the baseline's window figure; all
others start from the Parquet files and write every row to a null sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.aggregate import windows_from_series
from pulsegrid.operators.day_features import ALL_FEATURES, channels_of, day_features
from pulsegrid.plans import all_queries, shared
from pulsegrid.plans.registry import Tables
from pulsegrid.session import build_session

RUNS = 2
HEADLINE = [
    "r1_explode_day_string",
    "r4_last_per_slot",
    "r5_gap_filled_spine",
    "a2_tumbling_downsample",
    "a3_sliding_windows",
    "t1_flu_positive_windows",
    "r11_window_zscore",
    "j1_channel_alignment",
    "j2_survey_labs_activity",
    "j3_asof_backward_7d",
    "j4_range_semi_join",
    "j9_sequential_pairs",
    "j10_random_pairing",
    "l5_lab_survey_positive",
    "l9_clean_annotation",
    "w2_day_islands",
    "w5_midrank",
    "o3_temporal_participant_split",
    "o5_user_split",
    "o10_precision_at_k",
    "e2_roc_auc",
    "e8_bootstrap_interval",
    "e12_regression_metrics",
    "e14_delong_variance",
]


def timed(run) -> float:
    run()
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "pulsegrid-bench", f"local[{cpus}]", int(cpus),
        spark__driver__memory=os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    results: dict[str, float] = {}

    series = shared.series_rows(tables).cache()
    series.count()

    def windows_hash() -> None:
        windows = windows_from_series(series, ["heart_rate", "steps"], 7, shared.HOUR)
        row_hash = F.xxhash64("participant_id", "start", "heart_rate", "steps").cast("decimal(38,0)")
        windows.agg(F.count(F.lit(1)), F.sum(row_hash)).collect()

    results["a3_cached_series"] = timed(windows_hash)
    series.unpersist()

    results["f_all_day_features"] = timed(
        lambda: drain(day_features(shared.series_rows(tables, channels_of(ALL_FEATURES)), ALL_FEATURES))
    )
    for name in HEADLINE:
        build = all_queries.QUERIES[name]
        results[name] = timed(lambda: drain(build(spark, folder)))

    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
