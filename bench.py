"""Benchmark: run the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma-separated subset).  Each query is executed in
full with the ``noop`` sink (no driver collect), after one untimed warm-up of
the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from finlex.plans import QUERIES  # noqa: E402
from finlex.session import get_spark  # noqa: E402

HEADLINE = [
    "T1_normalize",             # preprocessing (T1-T9 class)
    "T9_derived_metadata",
    "F23_composed_features",    # all feature groups F4-F22 per document
    "X1_vocabulary",            # vocabulary fit
    "L3_bernoulli_score",       # type model fit + score
    "L6_complement_score",      # sentiment model fit + score (TF-IDF)
    "L9_gaussian_score",        # impact model fit + score
    "A20_decision_summary",     # network aggregation + explanation
    "M6_weighted_vote",         # meta-learning vote
    "E7_impact_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app_name="finlex-bench")
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(1).collect()  # warm-up
    timings = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf}))


if __name__ == "__main__":
    main()
