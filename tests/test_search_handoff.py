"""The searches read plans that are stored, as the pipeline hands them over, and parsing skips no envelope."""

import datetime

import pytest
from pyspark.sql import functions as F

from carelocus.operators import plan as pl
from carelocus.operators import search as sr
from carelocus.plans import registry


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("events"))
    rows = [(i, datetime.datetime(2024, 1, 1), i % 13, "view", 1.0, None) for i in range(90)] + [(5, None, 3, None, None, None), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{root}/events.parquet")
    return root


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("planned", [registry.plans, registry.merged])
def test_plans_are_handed_over(spark, events, planned):
    stored = registry.handed_over(planned(spark, events))
    assert stored.count() == 92
    assert _rows(stored) == _rows(planned(spark, events).select(stored.columns))
    assert all("search_plans" in f for f in sr.distinct_plans(stored).inputFiles())


def test_distinct_plans_are_not_planned_again(spark, events):
    got = registry._dplans(spark, events)
    assert not [f for f in got.inputFiles() if "events.parquet" in f]
    assert _rows(got) == _rows(sr.distinct_plans(registry.plans(spark, events)))


@pytest.mark.parametrize("name", ["search_top", "search_counts", "result_cards"])
def test_searches_get_stored_plans(spark, events, monkeypatch, name):
    class Seen(Exception):
        pass

    def stop(plans, index, *a, **k):
        assert not [f for f in plans.inputFiles() if "events.parquet" in f]
        raise Seen

    monkeypatch.setattr(registry, "facility_index", lambda *a: None)
    monkeypatch.setattr(sr, name, stop)
    key = {"search_top": "search_top5"}.get(name, name)
    for query in (key, f"{key}_merged"):
        with pytest.raises(Seen):
            registry.QUERIES[query](spark, events)


def test_envelopes_by_any_spelling(spark):
    inner = '{\\"city\\": \\"Agra\\"}'
    texts = [f'{{"content": "{inner}"}}', f'{{"\\u0063ontent": "{inner}"}}', f'{{"output_tex\\u0074": "{inner}"}}', f'{{"text": "{inner}"}}',
             f'{{"choices": [{{"message": {{"content": "{inner}"}}}}]}}', '{"city": "Agra"}', '{"content": "", "city": "Agra"}', '{"content": "none"}', None, "no"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", F.try_variant_get(pl.parse_response(F.col("t")), "$.city", "string").alias("c")).collect()}
    assert got == {**{i: "Agra" for i in range(7)}, 7: None, 8: None, 9: None}
