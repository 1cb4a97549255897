"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is timed once after a short warm-up of the session; the time covers building
the plan, all intermediate writes and the final result. The tables are first written again as
``FILES`` files each, outside the timing: a table of any size has many, and one file of one row
group would time a single core.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

FILES = 32
TABLES = "documents embeddings pages benchmark labels conversations events".split()
HEADLINE = (
    "tokenize_counts text_quality_diagnosis page_quality enhancement_decision enhancement_merge "
    "near_duplicate_fingerprint chunk_documents semantic_blocks bm25_topk_by_source bm25_document_search "
    "vector_topk rrf_fuse mmr_rerank retrieve_evidence retrieve_context retrieve_hybrid retrieval_metrics understanding_l0_l1 "
    "concept_memory concept_state_stream"
).split()


def in_files(spark, sf_dir: str) -> str:
    """A copy of the tables in the session's folder, dealt over files by a hash of the whole row."""
    from pyspark.sql import functions as F

    from lectern.session import shared_dir

    target = f"{shared_dir(spark).rstrip('/')}/bench-input"
    for name in TABLES:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        rows.repartition(FILES, F.xxhash64(*rows.columns)).write.mode("overwrite").parquet(f"{target}/{name}.parquet")
    return target


def main() -> None:
    from lectern.catalog import all_queries
    from lectern.session import local_session, ship_package

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="bench")
    ship_package(spark)
    queries = all_queries()
    source, sf_dir = sf_dir, in_files(spark, sf_dir)
    times: dict[str, float] = {}
    for name in wanted:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    line = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": source.rsplit("sf", 1)[-1],
    }
    if "bm25_topk_by_source" in times:
        from lectern.catalog.inputs import benchmark_requests

        asked = benchmark_requests(spark, sf_dir).count()  # one document a request
        line["lexical_requests_per_sec"] = round(asked / times["bm25_topk_by_source"], 1)
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
