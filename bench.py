"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the cores. Each query is run once to warm up the
JVM for its kind of plan (together with all others, on the smallest tables) and then timed once.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rolegrid import catalog  # noqa: E402
from rolegrid.session import build_session  # noqa: E402

HEADLINE = [
    "match_documents", "rejected_documents", "score_long_form", "freshness_events", "rescore_parts",
    "canonical_urls", "board_urls", "dedupe_pages", "dedupe_documents", "duplicate_links",
    "current_decisions", "decision_history", "review_filters", "review_page", "orphans", "metadata_score", "quarantine",
    "telemetry_rollup", "upsert_store", "upsert_moves", "new_matches", "mark_stale", "rescore_store", "enrich_parts", "prompt_upsert",
    "extract_greenhouse", "extract_lever", "extract_linkedin", "extract_details", "detail_descriptions", "next_page_walk",
    "template_prompts", "registry_match", "registry_issues", "discover_job", "search_job",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="20g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    timings = {}
    for name in names:
        if os.path.isdir(warm):
            run(name, warm)
        timings[name] = round(run(name, sf_dir), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
