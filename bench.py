"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and once for the clock.  Results are written to the
no-op sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from hearthmap.registry.spark_queries import QUERIES
from hearthmap.session import local_session

HEADLINE = [
    "s2_monthly_filter",
    "d1_classify",
    "a1_practice_totals",
    "d2_apportion",
    "d3_by_code",
    "d4b_two_step_faithful",
    "d5_locality",
    "d7_prevalence",
    "d9_category_wide",
    "d10_age_table",
    "d11_analysis_table",
    "d13_group_rates",
    "a8_crosstab_levels",
    "a13_decile",
    "t1_levene",
    "t2_welch",
    "t4_boxstats",
    "t6_score",
    "t7_pairs_given_score",
    "t8_balance_given_pairs",
    "t11_att",
]


def run(spark, name: str, sf: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    scratch = tempfile.mkdtemp(prefix="hearthmap-bench-")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "hearthmap-bench", spark__checkpoint__dir=scratch)
    times = {}
    for name in HEADLINE:
        run(spark, name, sf)
        times[name] = round(run(spark, name, sf), 3)
    result = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
