"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully evaluated through the ``noop`` sink (no collect to the
driver), twice: the first run compiles, the second one counts. Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parley.plans.queries import QUERIES  # noqa: E402
from parley.spark import get_spark, remove_work  # noqa: E402

HEADLINE = (
    "wer_macro",            # E3: T1 normalise + T2 word distance + A2 macro average
    "leaderboard",          # A3 pivot over all cases
    "best_model",           # A4 grouping sets over one scored input
    "qa_render",            # T5-T7 in-row parsing and run merging
    "qa_runs",              # T6 window form (skew-safe gaps and islands)
    "sentence_labels",      # M2 rules provider on documents (T8, T9, T6, T7)
    "summary_report",       # M3 extractive summary + T12 report
    "vocabulary_hits",      # T16 n-gram term coverage
    "assemble_transcript",  # A1 two-level ordered concatenation
    "skip_done",            # J1 incremental anti join
    "run_report",           # A7 all stages in one pass
    "session_lookup",       # K4 + S5: archive written twice, then looked up
    "stream_chain",         # R1-R2 streaming hand-off, sessions assembled in state
    "archive_compact",      # K4: ten runs merged into one file a bucket
    "target_index",         # P2: long target list by index
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", app="parley-bench", shuffle_partitions=int(cpus),
                      extra={"spark.driver.memory": "16g"})
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM / session start-up, no query work
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            t0 = time.time()  # includes building the plan (stored stage tables are written there)
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else None}))
    remove_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()
