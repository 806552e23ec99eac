"""Time the headline queries on $BENCH_SF_DIR and print one JSON line.

A few queries of different kinds run unmeasured first, so that the measured ones do not pay
for starting Spark. Every result is written out in full to a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridpulse.catalog import all_queries
from gridpulse.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
WARM_UP = ["daily_avg", "payload_decode", "latest_per_point", "fill_linear", "stream_window_max"]


def run(spark, query, sf_dir):
    begin = time.perf_counter()
    query.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main():
    spark = local_session(CORES, "bench")
    times = {}
    found = all_queries()
    for name in WARM_UP:
        run(spark, found[name], SF_DIR)
    for name, query in found.items():
        times[name] = round(run(spark, query, SF_DIR), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
