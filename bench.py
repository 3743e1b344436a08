"""Times every registered query on the bench tables and prints one JSON line.

The panel is built and stored first and timed as ``panel_store``; the queries after it read it, as
they do in a session. ``BENCH_QUERIES`` (comma separated) limits the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stratapanel.plans import QUERIES  # noqa: E402
from stratapanel.plans.panel import panel  # noqa: E402
from stratapanel.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    partitions = str(cpus) if cpus.isdigit() else "8"
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=partitions, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    start = time.perf_counter()
    panel(spark, sf_dir)
    times["panel_store"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
