"""The batch pipeline J1-J6 with materialised hand-offs.

Each job writes its table (Parquet, overwrite) and the next job reads the
written table back, so lineage is cut at every hand-off: a lost executor
recomputes at most one job's stages, and reports run off the written table
(one aggregate each) instead of re-running the lineage per count.

Tables live under ``<spark.checkpoint.dir>/tables/<run>`` unless a folder is
given; on a cluster that setting names the shared folder.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from carelocus.operators import index as idx
from carelocus.operators import location as loc
from carelocus.operators import nearest as nn
from carelocus.operators import pincode as pc
from carelocus.operators import plan as pl
from carelocus.operators import reports
from carelocus.operators import search as sr
from carelocus.operators.handoff import Handoff
from carelocus.session import work_dir
from carelocus.sources import fixtures as fx
from carelocus.sources.tables import create_or_replace, overwrite_parquet


@dataclass
class PipelineRun:
    spark: SparkSession
    root: str
    timings: dict[str, float] = field(default_factory=dict)

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def materialize(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Write `build()` to the run folder (timed) and return the written table."""
        t0 = time.perf_counter()
        overwrite_parquet(build(), self.path(name))
        self.timings[name] = round(time.perf_counter() - t0, 3)
        return self.spark.read.parquet(self.path(name))


def stage_inputs(run: PipelineRun, sf_dir: str, files: int | None = None) -> dict[str, DataFrame]:
    """Source tables (derived fixtures) written once, as a catalog would hold them:
    split over `files` files (default: the session's parallelism), as any table
    of size is, so the first scan of each job is read in parallel."""
    s = run.spark
    files = files or s.sparkContext.defaultParallelism
    makers = {
        "postal_directory": fx.postal_directory, "facilities": fx.facilities, "services": fx.services,
        "equipment": fx.equipment, "capabilities": fx.capabilities, "searches": fx.searches,
        "planner_responses": fx.planner_responses,
    }
    t0 = time.perf_counter()
    out = {}
    for name, make in makers.items():
        overwrite_parquet(make(s, sf_dir).repartition(files), run.path(f"src_{name}"))
        out[name] = s.read.parquet(run.path(f"src_{name}"))
    run.timings["inputs"] = round(time.perf_counter() - t0, 3)
    return out


def run_pipeline(spark: SparkSession, sf_dir: str | None = None, root: str | None = None, with_reports: bool = True,
                 inputs: dict[str, DataFrame | str] | None = None, table_prefix: str | None = None) -> PipelineRun:
    """J1-J6. Reads `inputs` (DataFrames or catalog table names, by the names of `stage_inputs`), or the test
    fixture derived from `sf_dir`. With `table_prefix` the jobs' results also become catalog tables."""
    run = PipelineRun(spark, root or work_dir(spark, f"run-{uuid.uuid4().hex[:8]}"))
    if inputs is not None:
        needed = {"postal_directory", "facilities", "services", "equipment", "capabilities", "searches", "planner_responses"}
        if missing := needed - set(inputs):
            raise ValueError(f"missing inputs: {sorted(missing)}")
        src = {k: spark.table(v) if isinstance(v, str) else v for k, v in inputs.items()}
    else:
        src = stage_inputs(run, sf_dir)

    lookup = run.materialize("J1_pincode_lookup", lambda: pc.build_pincode_lookup(src["postal_directory"]))
    with Handoff(spark) as handoff:
        nearest = run.materialize("J2_nearest_pin", lambda: nn.nearest_pin_complete(src["facilities"], lookup, handoff=handoff))
    location = run.materialize("J3_facility_location",
                               lambda: loc.locate_facilities(src["facilities"], lookup, nearest))
    index = run.materialize("J4_facility_index", lambda: idx.build_facility_index(
        src["facilities"], src["services"], src["equipment"], src["capabilities"], location))
    plans = run.materialize("J5_search_plans", lambda: pl.with_status(
        pl.merge_plans(src["searches"], src["planner_responses"])))
    with Handoff(spark) as handoff:
        cards = run.materialize("J6_result_cards", lambda: sr.result_cards(plans, index, handoff=handoff))
    if table_prefix:
        for name, table in (("pincode_lookup", lookup), ("nearest_pin", nearest), ("facility_location", location),
                            ("facility_index", index), ("search_plans", plans), ("result_cards", cards)):
            create_or_replace(table, table_prefix + name)

    if with_reports:
        t0 = time.perf_counter()
        run.reports = {
            "pincode": reports.pincode_report(lookup).first().asDict(),
            "nearest": reports.nearest_report(nearest).first().asDict(),
            "confidence": [r.asDict() for r in reports.confidence_distribution(location).collect()],
            "index": reports.index_report(index).first().asDict(),
        }
        run.timings["reports"] = round(time.perf_counter() - t0, 3)
    return run
