"""Summarise the physical plan of each job J1-J6 (built on materialised inputs).

    python tools/explain_jobs.py [--sf /root/testdata/sf0.01] > PLANS.md
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(name: str, df) -> str:
    formatted = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    ops = re.findall(r"\b(Exchange|BroadcastExchange|BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                     r"WindowGroupLimit|HashAggregate|SortAggregate|ObjectHashAggregate|Generate|Window)\b",
                     formatted.split("\n\n")[0])
    counts = {o: ops.count(o) for o in dict.fromkeys(ops)}
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", formatted)))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", formatted)
    lines = [f"### {name}", "", "| operator | count |", "| --- | --- |"]
    lines += [f"| {k} | {v} |" for k, v in counts.items()]
    lines += ["", "Pushed filters: " + ("; ".join(p for p in pushed if p) or "none")]
    lines += ["", "Columns read per scan: " + ", ".join(str(s.count(":")) for s in schemas), ""]
    lines += ["```", formatted.split("\n\n")[0].strip(), "```", ""]
    return "\n".join(lines)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    from carelocus.operators import index as idx
    from carelocus.operators import location as loc
    from carelocus.operators import nearest as nn
    from carelocus.operators import pincode as pc
    from carelocus.operators import plan as pl
    from carelocus.operators import search as sr
    from carelocus.plans.jobs import run_pipeline
    from carelocus.session import local_session

    spark = local_session(shuffle_partitions=16)
    run = run_pipeline(spark, args.sf, root=tempfile.mkdtemp(prefix="explain-"), with_reports=False)
    rd = lambda n: spark.read.parquet(run.path(n))
    src = {n: rd(f"src_{n}") for n in ["postal_directory", "facilities", "services", "equipment", "capabilities",
                                       "searches", "planner_responses"]}
    jobs = [
        ("J1 build_pincode_lookup", lambda: pc.build_pincode_lookup(src["postal_directory"])),
        ("J2 nearest_pin_complete", lambda: nn.nearest_pin_complete(src["facilities"], rd("J1_pincode_lookup"))),
        ("J3 locate_facilities", lambda: loc.locate_facilities(src["facilities"], rd("J1_pincode_lookup"),
                                                               rd("J2_nearest_pin"))),
        ("J4 build_facility_index", lambda: idx.build_facility_index(
            src["facilities"], src["services"], src["equipment"], src["capabilities"], rd("J3_facility_location"))),
        ("J5 merge_plans", lambda: pl.with_status(pl.merge_plans(src["searches"], src["planner_responses"]))),
        ("J6 search_top", lambda: sr.search_top(rd("J5_search_plans"), rd("J4_facility_index"))),
    ]
    print(f"# Physical plans of J1-J6\n\nGenerated by `tools/explain_jobs.py --sf {args.sf}` (local[*], 16 shuffle "
          "partitions, inputs read from the materialised tables of a pipeline run). At this size the checked "
          "broadcasts fire; beyond the byte bound the same joins plan as sort-merge joins "
          "(`tests/test_join_paths.py`).\n")
    for name, build in jobs:
        print(summarise(name, build()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
