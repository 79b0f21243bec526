"""Time the headline queries; prints one JSON line.

Each query runs twice: "queries" holds the second run, "first_run" the one
that also compiles. BENCH_SF_DIR and BENCH_CPUS choose data and cores. With --duckdb the same
queries' SQL is timed in DuckDB on the same files, under "duckdb".
"""

import json
import os
import sys
import time

from broadsheet.session import local_session
from checks.queries import ORACLES, QUERIES
from checks.views import TABLES

HEADLINE = [
    "relevance_score", "relevance_score_default", "keyword_frequency", "relevance_gate",
    "curated_articles", "dedup_first", "new_articles", "insert_absent", "refreshed_store",
    "not_excluded", "mark_reviewed", "store_order", "top_articles", "unique_slugs",
    "judge_batches", "judge_prompts", "compare_summary", "judge_batch_status",
    "api_articles", "feed_articles", "land_all", "extract_page_metadata", "classify_ingest",
    "resolve_notes", "archive_articles", "digest_lines", "published_articles",
    "resolve_values", "job_curate", "stream_landing",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    first, times = {}, {}
    for name in HEADLINE:
        for taken in (first, times):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {first[name]} {times[name]}", file=sys.stderr)
    out = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "first_run": first, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }
    if "--duckdb" in sys.argv:
        out["duckdb"] = duckdb_times(sf_dir, int(cpus) if cpus != "*" else None)
    print(json.dumps(out))


def duckdb_times(sf_dir: str, threads: int | None) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": threads} if threads else {})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        con.execute(ORACLES[name]).to_arrow_table()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"duckdb {name} {times[name]}", file=sys.stderr)
    return times


if __name__ == "__main__":
    main()
