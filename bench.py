"""Time the headline queries (or, with BENCH_ALL=1, every query) and print one JSON line.

The tracking fixture is derived from ``orders`` and stored once before the clock starts
for the queries; its own time is reported as ``fixture``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from leadline.checks import fixture  # noqa: E402
from leadline.checks.all import QUERIES  # noqa: E402
from leadline.session import local_session  # noqa: E402

HEADLINE = [
    "trailing_first_value", "asof_lookback", "asof_two_tables", "equi_join", "semi_join",
    "top1_per_group", "percentile_by_group", "quantile_table", "rank_pct", "stratified_folds",
    "impute_median", "roc_auc", "payoffs", "sync_frames", "release_time", "lookback_xy",
    "kinematics_endpoint", "nearest_in_time", "trailing_speed", "path_length", "target_moment",
    "sprint_speed", "pop_time", "pickoff_set", "steal_set", "bip_set", "lead_profile",
    "resample_play",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")

    start = time.perf_counter()
    fixture.tracking(spark, folder)
    took = {"fixture": round(time.perf_counter() - start, 3)}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    total = sum(v for k, v in took.items() if k != "fixture")
    print(json.dumps({"metric": "total_query_time", "value": round(total, 3), "unit": "sec",
                      "queries": took, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
