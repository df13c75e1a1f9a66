"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.plans.queries import QUERIES  # noqa: E402
from tidemark.session import get_session  # noqa: E402

HEADLINE = [
    "script_risk",
    "rule_issues",
    "clean_lines",
    "chunk_rows",
    "hash_embedding",
    "vector_topk",
    "hybrid_evidence",
    "lexical_search",
    "page_content",
    "viral_benchmarks",
    "trend_briefs",
    "snapshot_serve",
    "report_reconcile",
    "talent_deletes",
    "library_listing",
    "workflow_steps",
    "step_durations",
    "reading_order",
    "real_tables",
    "layout_documents",
    "heading_levels",
    "citations",
    "trend_results",
    "talent_updates",
    "page_chunks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("tidemark-bench", master=f"local[{cpus}]")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        best = None
        # the first run also pays for class loading and code generation
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    sf = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
