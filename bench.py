"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from residua import catalog
from residua.operators import store
from residua.plans import ssb
from residua.session import session

STAR = [f"ssb_q{q}" for q in ("1_1", "1_2", "1_3", "2_1", "2_2", "2_3", "3_1", "3_2", "3_3", "3_4", "4_1", "4_2", "4_3")]
NAMES = STAR + ["partition_bounds", "linear_fit_bits", "codec_roundtrip_fixed", "codec_roundtrip_cost_optimal", "access_encoded"]


def seconds(run) -> float:
    """The median of three runs after a first one."""
    times = []
    for _ in range(4):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    return round(median(times[1:]), 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, took, stored = catalog.queries(), {}, {}
    for name in NAMES:
        took[name] = seconds(lambda: queries[name](spark, sf_dir))
        print(name, took[name], file=sys.stderr)
    for name in STAR:
        stored[name] = {s: seconds(lambda: ssb.QUERIES[name].run(spark, sf_dir, s)) for s in ("scan", "encoded")}
        print(name, stored[name], file=sys.stderr)
    sizes = store.sizes(ssb.encoded_fact(spark, sf_dir), ssb.FACT).collect()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 4), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      # plain Parquet without pushed ranges against encoded columns
                      "by_strategy": stored,
                      "raw_to_encoded_bytes": {r["name"]: round(r["raw_bytes"] / r["packed_bytes"], 2) for r in sizes}}))


if __name__ == "__main__":
    main()
