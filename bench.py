"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. The result is
fully computed and thrown away (noop sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sortdesk.plans import catalog  # noqa: E402
from sortdesk.session import builder  # noqa: E402

HEADLINE = (
    "mask_pii", "pii_census_documents", "input_rule_hits", "triage_decisions",
    "escalation_reasons", "pii_census_pages", "output_rule_hits",
    "accepted_decisions", "case_states", "audit_export", "dedupe_ttl", "admitted_requests",
    "policy_as_of", "lexical_topk", "vector_topk", "document_frequency",
    "parsed_classifications", "parsed_judgements", "final_attempts", "evaluation_summary",
    "latency_p95", "retrieved_contexts", "kb_search", "decisions_under_policy_history",
    "metrics_by_hour", "stream_triage_decisions", "baseline_classifier",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = (
        builder("bench").master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sortdesk-bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds = {}
    for name in only or HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
