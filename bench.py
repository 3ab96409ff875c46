"""Time the headline queries and print one JSON line.

Each query is written to the no-op sink, so every column of every row is
computed. Times are the better of two runs in one warm session. The test tables are
single row groups, which a scan cannot split; they are first stored in many files,
as a cluster has its tables, outside the time.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from runsift.session import local_session  # noqa: E402
from runsift.workload import ENTRIES  # noqa: E402

HEADLINE = (
    "reward_binary", "reward_final", "expected_vs_observed", "assess_base", "assess_detail", "status_detail",
    "validate_metadata", "public_index", "command_stages", "normalize_names", "results_latest", "carry_forward",
    "dedupe_override", "stratified_sample", "range_select", "extract_line_rules", "extract_override",
    "extract_severity", "extract_suite_context", "extract_section", "extract_nested", "extract_junit",
    "extract_json_events", "extract_counters", "extract_composite", "extract_multiline",
)


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
FILES = 16


def in_files(spark, sf_dir: str) -> str:
    """The tables that the headline queries read, each in several files."""
    folder = tempfile.mkdtemp(prefix="runsift-bench-")
    for name in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows.repartition(FILES if name in ("orders", "lineitem", "events") else 1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "runsift-bench")
    sf_dir = in_files(spark, given)
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            ENTRIES[name].query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(given.rstrip("/"))}))


if __name__ == "__main__":
    main()
