"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and then three times; its figure is the median. Results are written to a no-op
sink, so all rows are made and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

TOP = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join([TOP, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, TOP)

HEADLINE = ["resolver_decisions", "resolver_near_ties", "bib_lock_audit", "claims_audit", "claim_consistency", "evidence_overlap", "topk_blocks", "issue_summary", "max_actions_gate", "html_anchors", "sha_manifest", "lock_upsert"]


def control(spark) -> float:
    """Seconds of a fixed job on rows that it makes itself, by which the machine's speed can be divided out."""
    began = time.perf_counter()
    rows = spark.range(0, 4_000_000, 1, 8).selectExpr("id % 100003 AS k", "sha2(cast(id AS string), 256) AS h")
    rows.groupBy("k").agg({"h": "max"}).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    from provlake.plans import registry
    from provlake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    control(spark)
    controls, took = [control(spark)], {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    controls.append(control(spark))
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "control": round(statistics.median(controls), 3), "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
