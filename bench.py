"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query seconds.

Each query is executed fully with the ``noop`` sink (no collect to the
driver).  The session is warmed once on sf0.001 so JVM start-up is not
charged to the first query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bytespan.plans import queries as Q  # noqa: E402
from bytespan.session import get_spark  # noqa: E402

HEADLINE = [
    "agg5_chunk_scores",     # flagship: windows -> tags -> stitch -> chunk scores
    "fn2_windows",
    "jn2_clip",
    "win1_iobes",
    "win5_stitch",
    "win3_tags_to_spans",
    "agg8_confusion",
    "fn1_sentences",
    "agg3_dedupe_spans",
    "win9_split",
    "fn12_token_tags",
    "ml4_path_energy",
    "ml3_viterbi",
    "ml6_log_likelihood",
    "jn7_word_embedding_ids",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark()
    # the bench tables are one row group each: without this every text scan is one task
    spark.conf.set("spark.bytespan.spread", os.environ.get("BENCH_CPUS", "8"))
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        Q.REGISTRY["agg5_chunk_scores"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        Q.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
