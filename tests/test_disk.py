"""What the jobs leave on the executors' disks: shuffle files of stored steps, and how often rows are dealt."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carelocus.operators import index as idx
from carelocus.operators import nearest as nn
from carelocus.operators import plan as pl
from carelocus.operators import search as sr
from carelocus.operators.handoff import SHUFFLE_CLEANUP, Handoff
from carelocus.operators.quadtree import POINT, Squares, dealt_by_point, leaf_places, narrowed, tree
from carelocus.plans import registry

from conftest import SF001


def shuffle_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?<!Broadcast)Exchange (\w+)", plan)


def test_shuffle_files_of_a_stored_step_go_with_it(spark):
    spark._jvm.System.gc()
    before, mode = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP)
    with Handoff(spark) as handoff:
        counts = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
        stored = handoff.store(counts.join(spark.range(700).repartition(5).withColumnRenamed("id", "k"), "k"), "counts")
        assert not shuffle_files(spark) - before
        assert stored.count() == 700 and stored.agg(F.sum("count")).first()[0] == 5000
        again = handoff.store(stored.groupBy("count").agg(F.count("*").alias("n")), "again")
        assert sum(x["count"] * x.n for x in again.collect()) == 5000
    assert spark.conf.get(SHUFFLE_CLEANUP) == mode


def test_the_setting_is_put_back_when_a_step_fails(spark):
    for mode in ("true", "false"):
        spark.conf.set(SHUFFLE_CLEANUP, mode)
        try:
            with Handoff(spark) as handoff:
                handoff.store(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), "never")
        except Exception as e:  # noqa: BLE001
            assert "no" in str(e)
        else:
            raise AssertionError("the step did not fail")
        assert spark.conf.get(SHUFFLE_CLEANUP) == mode
    spark.conf.unset(SHUFFLE_CLEANUP)


def test_cells_of_a_point_are_not_dealt_again(spark):
    points = spark.range(50).select((F.col("id") / 7).alias("latitude"), (F.col("id") / 3).alias("longitude"))
    cells = F.explode(F.sequence(F.lit(1), F.lit(9)).cast("array<double>"))
    rows = dealt_by_point(points).select(POINT, "latitude", "longitude", cells.alias("bound"), F.lit(0.5).alias("gap"))
    near = narrowed(rows)
    assert exchanges(near) == ["hashpartitioning"]
    assert near.count() == 450 and near.select("bound").distinct().collect() == [(1.0,)]


def test_pins_meet_the_few_leaves_without_a_shuffle(spark):
    pins = spark.range(400).select((20 + F.col("id") / 4000).alias("pin_latitude"), (70 + F.col("id") % 20 / 200).alias("pin_longitude"), F.col("id").cast("string").alias("pincode"))
    with Handoff(spark) as handoff:
        pins = handoff.store(pins, "pins")
        squares = Squares(nn.DEFAULT_GRID_DEGREES)
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            placed = leaf_places(pins, tree(pins, 16, handoff, squares, first=0), squares, first=0)
            assert not exchanges(placed) and placed.count() == 400
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


class Unstored:
    """Gives the rows of a step back as they are, not stored."""

    def store(self, df, name):
        return df


def below(df, node):
    return df._jdf.queryExecution().optimizedPlan().toString().split(node, 1)[1]


def test_texts_of_the_search_index_are_made_behind_its_shuffle(spark):
    names = [c for c in idx.INDEX_COLUMNS if c not in ("facility_latitude", "facility_longitude")]
    index = spark.range(30).select(*(F.concat(F.lit(c), "id").alias(c) for c in names), (F.col("id") / 3).alias("facility_latitude"),
                                   F.when(F.col("id") % 5 != 0, 70 + F.col("id") / 9).alias("facility_longitude"))
    store = sr.store_search_index(index, Unstored())
    moved = below(store, "RepartitionByExpression")
    assert "search_text" not in moved and "match_text" not in moved
    assert store.count() == 24 and store.filter(F.col("search_text").contains(F.lower("name"))).count() == 24


def test_merging_moves_searches_without_their_plans(spark):
    searches = spark.createDataFrame([(1, "dialysis near Agra"), (1, "MRI scan"), (2, "hospital near Jaipur"), (None, "dental clinic"), (3, None)], "search_id long, query string")
    responses = spark.createDataFrame([(1, '{"city": "Jaipur", "keywords": ["a b"]}'), (1, "~none"), (2, "no"), (None, '{"city": "Agra"}')], "search_id long, response string")
    got = pl.merge_plans(searches, responses)
    assert "keywords" not in below(got, "Join LeftOuter")
    assert got.columns == pl.fallback_plan(searches).columns
    model = {r.query: r.city for r in got.filter(F.col("source") == pl.MODEL_SOURCE).collect()}
    assert model == {"dialysis near Agra": "Jaipur", "MRI scan": "Jaipur"} and got.count() == 5


def test_searches_read_a_stored_index(spark):
    index = registry.facility_index(spark, SF001)
    assert all("facility_index" in f for f in index.inputFiles())
    assert index.columns == idx.INDEX_COLUMNS and index.count() == registry.built_index(spark, SF001).count()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_tables_dealt_alike_meet_without_a_shuffle(spark, no_broadcast):
    left = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)] + [(f"x{i}", i) for i in range(90)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("a", 11), (None, 12), ("x7", 13), ("z", 14)], "k string, w int")
    spark._jvm.System.gc()
    before = shuffle_files(spark)
    with Handoff(spark) as handoff:
        met = handoff.dealt(left, "the-left", "k").join(handoff.dealt(right, "the-right", "k"), "k", "left")
        assert not exchanges(met) and not shuffle_files(spark) - before
        assert rows_of(met) == rows_of(left.join(right, "k", "left")) and met.count() == 96
        assert len(handoff.tables) == 2 and os.path.isdir(handoff.root.removeprefix("file:"))
        names = list(handoff.tables)
    assert not any(spark.catalog.tableExists(t) for t in names) and not os.path.exists(handoff.root.removeprefix("file:"))


def test_an_index_of_dealt_tables_is_the_plain_one(spark, no_broadcast):
    ids = ["F1", "F2", "F2", None, "F3", "F4"]
    base = [c for c in idx.BASE_COLUMNS if c != "unique_id"]
    facilities = spark.createDataFrame([(k, str(20 + i), str(70 + i), i) for i, k in enumerate(ids)], "unique_id string, latitude string, longitude string, i int")
    facilities = facilities.select("unique_id", "latitude", "longitude", *(F.concat(F.lit(c), "i").alias(c) for c in base))
    raw = spark.createDataFrame([("F1", '["ENT"]', '["MRI"]', '["2 CT scanner"]', '{"a": 1}'), ("F2", None, '["robotic hip replacement"]', "[]", "broken"),
                                 ("F2", '["Cardiology"]', None, None, "{}"), (None, '["ENT"]', None, None, None), ("F9", '["ENT"]', None, None, None)],
                                "unique_id string, specialties string, procedure string, equipment string, capability string")
    location = facilities.select(F.col("unique_id").alias("facility_id"), F.lit("p").alias("postcode"), *(F.concat(F.lit(c), "address_city").alias(c) for c in ("district", "state", "location_confidence")), F.lit(1.5).alias("coord_nearest_pin_distance_km"))
    plain = rows_of(idx.build_enriched_index(facilities, raw, location))
    with Handoff(spark) as handoff:
        index = idx.build_enriched_index(facilities, raw, location, handoff)
        assert not exchanges(index) and index.columns == idx.INDEX_COLUMNS
        assert rows_of(index) == plain and sum(plain.values()) == 68  # 2 rows of F2 meet 2 of each of the five added tables
    own = {(r.unique_id, r.specialties) for r in index.sparkSession.createDataFrame([tuple(r) for r in plain], index.schema).collect()}
    assert ("F1", '["otolaryngology"]') in own and ("F3", "specialties4") in own and ("F2", "specialties1") in own


@pytest.fixture
def own_folder(tmp_path, monkeypatch):
    """Hand-offs of this test alone."""
    monkeypatch.setattr("carelocus.operators.handoff.work_dir", lambda spark, name: f"{tmp_path}/{name}")
    return tmp_path


def stored(folder):
    """{folder: tables} of the hand-offs there are."""
    return {d.name: sorted(os.listdir(d)) for d in folder.iterdir() if d.name.startswith("handoff-")}


def left_by(folder, make):
    before = set(stored(folder))
    made = make()
    return made, sorted(t for d, tables in stored(folder).items() if d not in before for t in tables)


def test_what_a_search_index_is_made_of_goes(spark, own_folder):
    index, left = left_by(own_folder, lambda: registry.search_index(spark, SF001))
    assert left == ["search_index"] and set(sr.READ_COLUMNS) <= set(index.columns) and index.count() > 0
    (plans, _), left = left_by(own_folder, lambda: registry.searched(spark, SF001, registry.plans))
    assert left == ["search_index", "search_plans"] and plans.count() > 0


def test_what_a_location_is_made_of_goes(spark, own_folder):
    (facilities, found), left = left_by(own_folder, lambda: registry.located(spark, SF001, Handoff(spark)))
    assert left == ["facilities", "facility_location"] and rows_of(found) == rows_of(registry.location(spark, SF001))
    assert rows_of(facilities) == rows_of(registry.fx.facilities(spark, SF001))


def test_steps_of_the_nearest_search_go_before_its_result(spark, own_folder):
    lookup = registry.lookup(spark, SF001)
    with Handoff(spark) as handoff:
        near, left = left_by(own_folder, lambda: nn.nearest_pin_complete(registry.fx.facilities(spark, SF001), lookup, handoff=handoff))
        assert left == ["frontier", "leaf-pins", "nearest-of-points", "points"] and near.count() > 0
