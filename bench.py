"""Time the headline queries and print one JSON line.

Each query is built, planned and run to the end (every output column computed, rows
dropped) after one untimed warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "momentum",
    "volatility",
    "momentum_bounded",
    "coverage",
    "dependence",
    "scan_prices",
    "dedupe_prices",
    "merge_prices",
    "vanished_rows",
    "violation_examples",
    "dq_ohlc",
    "ingest_chart_json",
    "ingest_batch_status",
    "unpivot_wide_prices",
    "resolve_target",
    "missing_sessions",
    "frame_diff",
    "verify_momentum_contract",
    "overview_momentum",
    "vintage_diff",
)


def main() -> None:
    from catalog.queries import QUERIES
    from tickerloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["momentum"](spark, sf_dir).limit(1).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
