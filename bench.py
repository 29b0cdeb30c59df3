"""Headline queries, timed: one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores), BENCH_QUERIES (names, comma
separated; default below), BENCH_REPEATS (timed runs per query, the median counts).
``index_build`` is the ingestion of all documents; the queries after it read the stored index, as a
deployment would.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gapmatch.plans import registry, tables  # noqa: E402
from gapmatch.session import local_session  # noqa: E402

HEADLINE = (
    "tokens_per_doc keywords sentence_table salient_terms requirement_extract ingest_status bm25_topk hashed_dense_topk "
    "dense_topk ranked_children small_to_big retrieval_metrics idf best_evidence verdicts match_report answer_scores "
    "scorecard action_items recurring_gaps progress_totals stage_rollup latency_p95 contract_quarantine spearman "
    "upsert_latest erase_cascade grounding_metrics"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(cores, "gapmatch-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine outside the timings
    queries = registry()
    seconds: dict[str, float] = {}

    def timed(run) -> float:
        start = time.perf_counter()
        run()
        return time.perf_counter() - start

    seconds["index_build"] = round(timed(lambda: tables.index(spark, folder)), 3)
    for name in names:
        def run(name=name):
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()

        seconds[name] = round(statistics.median(timed(run) for _ in range(repeats)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
