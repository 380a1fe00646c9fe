"""Benchmark: the J1-J6 pipeline at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "pipeline_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each job reads the previous job's written table and writes its own, so each
timing is one job end to end (scan -> shuffle(s) -> Parquet write). "inputs" is
the one-off derivation of the source tables and is not part of "value".
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from carelocus.plans.jobs import run_pipeline
    from carelocus.session import local_session

    scratch = tempfile.mkdtemp(prefix="carelocus-bench-")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="carelocus-bench")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", scratch)
    # Warm-up (reported, not timed): one pass of the same jobs over the smallest
    # table set, so the timed pass measures the jobs rather than JVM class loading
    # and JIT compilation of the first query.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    warmup = None
    if warm_dir and os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        w0 = time.perf_counter()
        run_pipeline(spark, warm_dir, root=os.path.join(scratch, "warmup"), with_reports=False)
        warmup = round(time.perf_counter() - w0, 3)

    t0 = time.perf_counter()
    run = run_pipeline(spark, sf_dir, root=os.path.join(scratch, "tables"), with_reports=True)
    total = time.perf_counter() - t0
    jobs = {k: v for k, v in run.timings.items() if k.startswith("J")}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "pipeline_total_sec",
        "value": round(sum(jobs.values()), 3),
        "unit": "sec",
        "queries": run.timings,
        "wall_sec": round(total, 3),
        "warmup_sec": warmup,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
