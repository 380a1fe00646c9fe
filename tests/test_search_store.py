"""The stored search index, the narrow ranking and the hand-offs of a search run."""

import os
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from carelocus.operators import search as sr
from carelocus.operators.handoff import Handoff
from carelocus.plans.registry import facility_index, plans

from conftest import SF01


def widths(node, name):
    """Numbers of columns that the plan's nodes of a name take in."""
    children = [node.children().apply(i) for i in range(node.children().size())]
    own = [children[0].output().size()] if node.nodeName() == name else []
    return own + [w for c in children for w in widths(c, name)]


def test_only_six_columns_pass_the_ranking(spark):
    with Handoff(spark) as handoff:
        _, ranked = sr.scored_candidates(plans(spark, SF01), facility_index(spark, SF01), handoff=handoff)
        top = sr.rank_results(ranked)
        assert len(top.columns) == 6
        assert widths(top._jdf.queryExecution().optimizedPlan(), "Window") == [5]


def test_cells_carry_numbers_only(spark):
    with Handoff(spark) as handoff:
        cells = sr.box_cells(handoff.store(sr.distinct_boxes(sr.distinct_plans(plans(spark, SF01))), "boxes"))
        assert {t for _, t in cells.dtypes} <= {"double", "bigint", "int"}


def test_repeated_ids_keep_their_rows(spark):
    """Rows that share an id are results of their own, each with its own index row, and rank in a fixed order."""
    index = facility_index(spark, SF01).cache()
    p = plans(spark, SF01).cache()
    best = sr.result_cards(p, index).orderBy("search_id", "rank").first()
    one = index.filter(F.col("unique_id") == best.unique_id)
    twice = index.unionByName(one.withColumn("name", F.lit("the other row")))
    orders = []
    for parts in (1, 7):
        cards = sr.result_cards(p.filter(F.col("search_id") == best.search_id), twice.repartition(parts)).orderBy("rank").collect()
        assert sorted(r.name for r in cards if r.unique_id == best.unique_id) == sorted([best.name, "the other row"])
        assert [r.rank for r in cards] == list(range(1, len(cards) + 1))
        orders.append([(r.unique_id, r.name) for r in cards])
    assert orders[0] == orders[1]


def test_a_city_reads_a_part_of_the_files(spark):
    index = facility_index(spark, SF01).cache()
    p = plans(spark, SF01).cache()
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "48"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        with Handoff(spark) as handoff:
            store = sr.store_search_index(index, handoff)
            one = p.filter("city = 'Delhi' AND radius_km <= 50")
            boxes = handoff.store(sr.distinct_boxes(sr.distinct_plans(one)), "boxes")
            facts = sr.box_facts(boxes)
            jvm = spark.sparkContext._jvm
            scan = jvm.PythonSQLUtils.explainString(sr.box_candidates(boxes, store)._jdf.queryExecution(), "formatted")
            pushed = [x for x in re.findall(r"PushedFilters: \[(.*?)\]", scan) if "facility_latitude" in x]
            assert pushed and "GreaterThanOrEqual(facility_latitude" in pushed[0] and "LessThanOrEqual(facility_longitude" in pushed[0]
            assert "description" not in re.search(r"ReadSchema: (.*facility_latitude.*)", scan).group(1)
            folder = f"{handoff.root}/search_index"
            hit = files = 0
            for name in sorted(x for x in os.listdir(folder) if x.endswith(".parquet")):
                meta = pq.ParquetFile(f"{folder}/{name}").metadata
                for g in range(meta.num_row_groups):
                    bounds = {}
                    for c in range(meta.num_columns):
                        column = meta.row_group(g).column(c)
                        bounds[column.path_in_schema] = column.statistics
                    files += 1
                    hit += all(bounds[f"facility_{a}"].min <= facts[f"max_{s}"] and bounds[f"facility_{a}"].max >= facts[f"min_{s}"] for a, s in (("latitude", "lat"), ("longitude", "lon")))
            assert files >= 40 and hit <= files / 3, (hit, files)
            cols = ["search_id", "rank", "unique_id"]
            assert sorted(sr.search_top(one, store).select(cols).collect()) == sorted(sr.search_top(p, index).join(one.select("search_id"), "search_id").select(cols).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_handoffs_are_dropped(spark):
    with Handoff(spark) as handoff:
        n = sr.result_cards(plans(spark, SF01).filter("search_id % 50 = 0"), facility_index(spark, SF01), handoff=handoff).count()
        assert n and set(os.listdir(handoff.root)) == {"boxes", "cards", "plans", "search_index", "winners"}
    assert not os.path.exists(handoff.root)
