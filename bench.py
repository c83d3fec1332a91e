"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES (comma-separated ids, or ``all``), BENCH_MODELS (``all``: every model fit).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cashtrail import catalog
from cashtrail.session import local_session

HEADLINE = ["D1", "D2", "D3", "D4", "D5", "D6", "D8", "D9", "E1", "E2", "E3", "E8", "E9", "B16", "F4", "F6", "I4", "J9", "J12", "J14", "K1", "M3", "N3", "N6"]
# logistic regression; with BENCH_MODELS=all also boosted trees and forest at full size, fitted side by side. Their times are reported apart
MODELS = ["J8"] + ["J6"] * (os.environ.get("BENCH_MODELS") == "all")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE + MODELS
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()        # start the engine before the clock
    times = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    models = {k: times.pop(k) for k in MODELS if k in times and not wanted}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "models": models, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
