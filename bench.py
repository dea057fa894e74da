"""Headline queries at one scale; prints a single JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mosarea.plans import catalog
from mosarea.session import local_session

HEADLINE = (
    "b3_a6_direct_phone",
    "f4_complete_strata",
    "f6_rake_converged",
    "f11_mics_households",
    "g1_j8_point_in_polygon",
    "m4_patterns",
    "m5_log_posterior_pc",
    "d2_d3_mr_phone_only",
    "d8_mrp_dhs_phone_only",
    "i1_summarise_draws",
    "m6_hierarchical_posterior_summary",
    "v9_roc_auc",
    "v4_v5_v6_v7_error_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
