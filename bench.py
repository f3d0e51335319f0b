"""Runs the headline queries and prints one JSON line with their seconds.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). The index of the documents is built
first, as a search engine's is, and its seconds are given apart ("index_build"). Each query runs twice and its result is
read whole; the better time counts.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from lexigrove.queries import INDEXES, QUERIES
from lexigrove.session import local_session
from lexigrove.sources.corpus import Corpus

#: What a search engine is asked for most: terms, phrases, structure, ranking, statistics.
HEADLINE = ("g_term", "g_phrase", "g_and", "g_from_to", "g_contains", "c_count", "c_documents_containing", "c_language_model", "r_bm25", "r_lm_dirichlet", "r_vector_space_raw", "r_dfr_ifb2", "r_qap", "r_bm25_containers", "f_feedback_okapi", "d_document_centric", "l_normalised_text")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    folder, began = tempfile.mkdtemp(prefix="lexigrove-index-"), time.perf_counter()
    Corpus.documents(spark, sf_dir).save(folder, cpus)
    INDEXES[sf_dir] = folder
    built = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(min(seconds.get(name, 1e9), time.perf_counter() - began), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "index_build": built, "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()
    shutil.rmtree(folder)


if __name__ == "__main__":
    main()
