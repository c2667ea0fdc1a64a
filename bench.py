"""Times the headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]``. Each query runs once
to warm up on the same data and once for the clock (a long one only once, cold); results are counted through a full collect of
an aggregate over every column, so that no column is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from probita.plans import registry  # noqa: E402
from probita.session import build_session  # noqa: E402

HEADLINE = [
    "w4_top_cases", "r14_risk_assessment", "a1_transaction_statistics", "j3_client_transfers", "e3_batch_screen",
    "j7_light_search", "q2_batch_entities", "t2_injection", "t5_claims", "t8_egress", "g3_descendants", "l4_verify_chain",
]


#: A query that takes longer than so many seconds cold is not run a second time.
LONG = 60


def drain(df) -> int:
    """Evaluates every column of every row and returns the number of rows."""
    return df.select(F.xxhash64(*[F.col(c) for c in df.columns]).alias("h")).agg(F.count("h"), F.sum(F.col("h") % 1000)).first()[0]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", master=f"local[{cpus}]", partitions=max(8, 2 * cpus))
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    timed: dict[str, float] = {}
    for name in names:
        query = registry.queries()[name]
        for _ in range(2):
            start = time.time()
            rows = drain(query(spark, folder))
            timed[name] = round(time.time() - start, 3)
            if timed[name] > LONG:
                break
        print(f"{name}: {timed[name]}s, {rows} rows", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "headline_total", "value": round(sum(timed.values()), 3), "unit": "sec", "queries": timed, "sf": scale}))


if __name__ == "__main__":
    main()
