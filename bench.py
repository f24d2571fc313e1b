"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pactum.session import build_session  # noqa: E402
from pactum.workload import all_queries  # noqa: E402

HEADLINE = [
    "wage_issues", "field_findings", "deadlines_sorted", "capped_scores", "order_employee",
    "passages", "contract_numbering", "clause_matches", "cross_conflicts", "redact_patterns",
    "tokens", "law_by_refs", "vector_topk", "extract_fields", "clause_boxes", "src_payroll_csv",
    "quota_24h", "status_changes", "report_assemble", "cache_hit_miss",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "pactum-bench")
    queries = all_queries()
    only = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in only:
        started = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
