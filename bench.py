"""Times the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR names the folder of tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Each query is run once to warm up on the smallest tables, then timed writing its whole result to the
no-op sink, so nothing is collected and nothing is pruned.
"""

from __future__ import annotations

import importlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "q_good_by_source",
    "q_dedup_text",
    "q_best_per_url",
    "q_quality",
    "q_doc_numbering",
    "q_split",
    "q_payload_normalize",
    "q_per_doc",
    "q_leaderboard",
    "q_final_flat",
    "q_run_summary",
    "q_agreement_pairs",
    "q_fill_rate",
    "q_coverage",
    "q_topk_terms",
    "p1_found",
    "p2_found",
    "p3_found",
    "p4_found",
    "p5_found",
    "p6_found",
    "p7_found",
    "p8_ids",
    "p9_shares",
    "p10_found",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    small = os.path.join(os.path.dirname(root.rstrip("/")), "sf0.001")
    runtime = importlib.import_module("lexmill.runtime")
    queries = importlib.import_module("__spark_entry__").queries()
    spark = runtime.session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        if name not in queries:
            continue
        if os.path.isdir(small):
            queries[name](spark, small).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(root.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
