"""Benchmark the headline queries: one JSON line on stdout.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query is fully computed into
Spark's ``noop`` sink (no driver collect); the JVM is warmed once on a small query first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["validity_by_prompt", "validity_rollup", "z_test", "synth_splits", "verify_splits", "interleave_docs",
            "mix_ratio", "ngram_counts", "completion_accuracy", "ppl_gap", "tokenize_ws", "normalize_punct",
            "conv_alternation", "event_path_valid", "stream_validity"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from seqlab.plans.queries import QUERIES
    from seqlab.session import get_session

    spark = get_session(cpus=cpus, app="seqlab-bench")
    QUERIES["corpus_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
