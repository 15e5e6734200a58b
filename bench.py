"""Times the feeds and some single operators; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from sigloom.registry import QUERIES  # noqa: E402
from sigloom.session import build_session  # noqa: E402

HEADLINE = [
    "Q_STD",
    "Q_HIGH",
    "Q_OPT",
    "Q_BEST",
    "Q_LEGACY",
    "Q_DIAG",
    "A1_change_probe",
    "J5_exists_pattern",
    "A6_multi_pattern_having",
    "J11_interval_labels",
    "J13_match_strategy",
    "T4_change_gate",
    "T6_dedup_seen",
    "T7_rate_per_minute",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["Q_DIAG"](spark, folder).collect()  # start-up is not part of any query
    timings = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(repeats):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        timings[name] = round(best, 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
