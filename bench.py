"""Time the headline queries: one JSON line, seconds per query (median of three warm runs)."""

import json
import os
import statistics
import time

from newsloom.checks.queries import REGISTERED
from newsloom.session import local_session

HEADLINE = [
    "top_stories",
    "quality_scores",
    "article_excerpts",
    "mark_duplicates",
    "append_articles",
    "feed_entries",
    "ingest_batch",
    "recent_articles",
    "article_feed",
    "articles_by_source",
    "translation_per_language",
    "daily_publication",
    "glossary_retention",
    "summary_prompts",
    "complete_batch",
    "parsed_combined",
    "editorial_run",
    "api_usage",
    "incremental_ingest",
    "selection_stats",
    "dedup_stats",
    "translations_for_briefs",
    "orphan_rows",
    "known_duplicates",
]
WARM_RUNS = 3


def seconds(spark, name: str, sf_dir: str) -> float:
    """Wall time from building the query to having computed every row and column of it."""
    started = time.perf_counter()
    REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    times = {}
    for name in names:
        seconds(spark, name, sf_dir)
        times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(WARM_RUNS)), 3)
    result = {
        "metric": "total_warm_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
