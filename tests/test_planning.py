"""Golden search plans and the pinned quirks of rule-based planning."""

import pytest
from pyspark.sql import functions as F

from carelocus.operators import plan as pl


def plan_of(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "search_id long, query string")
    rows = pl.with_status(pl.fallback_plan(df)).orderBy("search_id").collect()
    return [r.asDict() for r in rows]


def test_dialysis_near_jaipur(spark):
    (p,) = plan_of(spark, "dialysis near Jaipur")
    assert p["city"] == "Jaipur" and (p["latitude"], p["longitude"]) == (26.9124, 75.7873)
    assert p["care_need"] == "dialysis"
    assert p["keywords"] == ["dialysis", "nephrology", "renal", "kidney", "haemodialysis", "hemodialysis"]
    assert p["radius_km"] == 50 and p["status"] == "ok" and p["source"] == "keyword fallback"


def test_emergency_surgery_near_patna(spark):
    (p,) = plan_of(spark, "emergency surgery near Patna")
    assert p["city"] == "Patna" and p["care_need"] == "emergency"
    assert p["keywords"] == ["surgery", "surgical", "operation", "trauma", "emergency", "casualty",
                             "critical care", "icu", "accident"]


def test_maternity_near_mumbai(spark):
    (p,) = plan_of(spark, "maternity near Mumbai")
    assert p["city"] == "Mumbai" and len(p["keywords"]) == 7


def test_broken_wrist_is_orthopedic(spark):
    (p,) = plan_of(spark, "broken wrist in Delhi")
    assert p["care_need"] == "orthopedic fracture surgery"
    assert p["keywords"][:4] == ["orthopedic", "orthopaedic", "orthopedics", "orthopaedics"]
    assert "hand surgery" in p["keywords"] and len(p["keywords"]) == 16


def test_substring_quirks(spark):
    vizag, new_delhi, chandigarh, cataract = plan_of(
        spark, "dialysis near visakhapatnam", "dialysis near new delhi", "eye care in chandigarh",
        "cataract surgery near Agra")
    assert vizag["city"] == "Patna"              # D17: 'patna' inside 'visakhapatnam'
    assert new_delhi["city"] == "Delhi"          # D17: 'delhi' listed before 'new delhi'
    assert chandigarh["care_need"] == "orthopedic"  # D18: 'hand' inside 'chandigarh'
    assert cataract["care_need"] == "orthopedic"    # D18: 'surgery' is an orthopedic keyword
    assert "cataract" not in cataract["keywords"]   # D19: 16-term cap cuts the user's own word


def test_status_and_defaults(spark):
    nocity, noterms, empty = plan_of(spark, "dialysis", "the near Delhi", "")
    assert nocity["status"] == "no_city" and nocity["city"] is None
    assert noterms["status"] == "no_keywords" and noterms["care_need"] == "matching"
    assert empty["status"] == "no_city"


def test_preferences(spark):
    (p,) = plan_of(spark, "big hospital with newer machines and good ratings near Pune")
    assert p["preferences"] == ["larger facility", "advanced equipment", "good ratings"]


@pytest.mark.parametrize("response,expected", [
    ('{"city": "Jaipur", "keywords": ["renal unit"], "radius_km": 25}', ("Jaipur", 25, "model planner")),
    ('```json\n{"city": "jaipur", "radius_km": "30"}\n```', ("jaipur", 30, "model planner")),
    ('prose {"city": "Atlantis", "radius_km": 900} more', ("Delhi", 500, "model planner")),
    ('{"radius_km": "abc"}', ("Delhi", 50, "model planner")),
    ('{"radius_km": 12.7}', ("Delhi", 12, "model planner")),
    ('{"radius_km": true}', ("Delhi", 5, "model planner")),
    ('{"radius_km": 1e400}', ("Delhi", 50, "keyword fallback")),
    ('no json here', ("Delhi", 50, "keyword fallback")),
    ('{"city": "Jaipur", "keywords": [', ("Delhi", 50, "keyword fallback")),
])
def test_merge_with_planner(spark, response, expected):
    s = spark.createDataFrame([(1, "dialysis near Delhi")], "search_id long, query string")
    r = spark.createDataFrame([(1, response)], "search_id long, response string")
    row = pl.merge_plans(s, r).first()
    assert (row["city"], row["radius_km"], row["source"]) == expected


def test_merge_keyword_order_and_cap(spark):
    s = spark.createDataFrame([(1, "dialysis near Delhi")], "search_id long, query string")
    kws = ", ".join(f'"k{i:02d}"' for i in range(20))
    r = spark.createDataFrame([(1, '{"keywords": [' + kws + '], "must_have": ["Renal Unit!"]}')],
                              "search_id long, response string")
    row = pl.merge_plans(s, r).first()
    assert row["keywords"] == [f"k{i:02d}" for i in range(16)]


def test_plans_are_one_projection(spark):
    """Planning must not shuffle: no Exchange in the physical plan for a multi-split input."""
    df = spark.range(0, 1000, numPartitions=16).select(
        F.col("id").alias("search_id"), F.lit("dialysis near Jaipur").alias("query"))
    plan = pl.fallback_plan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_dictionary_terms_are_clean(spark):
    """Precondition of the lambda-free keyword path: cleaning leaves every constant term unchanged."""
    from carelocus.functions.text import clean_terms
    from carelocus.sources import dims
    lists = [kws for _, kws in dims.CARE_NEEDS] + [dims.ORTHOPEDIC_PLAN_KEYWORDS, dims.SURGICAL_KEYWORDS]
    df = spark.createDataFrame([(kws,) for kws in lists], "terms array<string>")
    for (terms,), (cleaned,) in zip(df.collect(), df.select(clean_terms(F.col("terms"), 99)).collect()):
        assert cleaned == terms
