"""Evidence items (S7), cleanup (S8-S10) and snippets (I7-I9) on hand-made shapes."""

import pytest
from pyspark.sql import functions as F

from carelocus.functions import evidence as ev
from carelocus.functions import text as tx

SHAPES = [
    ('["nephrology","emergencyMedicine"]', ["Nephrology", "Emergency Medicine"]),
    ('[{"name": "Hemodialysis"}, {"capability_name": "ICU", "name": "x"}, {"description": "desc only"}, {"other": 1}]',
     ["Hemodialysis", "ICU", "Desc only"]),
    ('["plain", {"specialty_name": "cardiology"}]', ["Plain", "Cardiology"]),
    ('{"standardized_service_name": "Knee Replacement|Surgery"}', ["Knee Replacement|Surgery"]),
    ('{"capabilities": [{"capability_name": "ICU"}], "primary_focus": "x"}', []),
    ("{'capability_name': 'Burn unit', 'x': 1}", ["Burn unit"]),
    ("cardiology, nephrology ,  ENT", ["Cardiology", "Nephrology", "ENT"]),
    ('["a", "b"', ["A", "B"]),
    ("", []),
    (None, []),
    ("description: Great hospital, with ICU", ["Great hospital"]),
    ('"just text"', ["Just text"]),
]


def test_evidence_item_shapes(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(SHAPES)], "i int, v string")
    got = {r["i"]: r["items"] for r in ev.with_evidence_items(df, "v", "items").collect()}
    for i, (v, expected) in enumerate(SHAPES):
        assert got[i] == expected, v


@pytest.mark.parametrize("raw,clean", [
    ("specialty_name: orthopedicSurgery", "Orthopedic Surgery"),
    ("  [ {capability_name}] ", " {Capability"),  # strip stops at the blank
    ('"cardiology".', "Cardiology"),
    ("", ""),
])
def test_clean_evidence_text(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "v string").select(tx.clean_evidence_text("v")).first()[0] == clean


@pytest.mark.parametrize("raw,out", [
    ("+91 98765 00001 (desk)", "+91 98765 00001"),
    ("call us", "call us"),
    ("f1@clinic.example.org", "f1@clinic.example.org"),
    ("x" * 50, "x" * 40),
])
def test_clean_phone(spark, raw, out):
    assert spark.createDataFrame([(raw,)], "v string").select(tx.clean_phone("v")).first()[0] == out


def test_has_value(spark):
    vals = [None, "", "  ", "\t\n", " null\t", "None", "NaN", "n/a", "Unknown", "0", "12"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(tx.has_value("v")).collect()]
    assert got == [False] * 9 + [True, True]


def test_snippets_first_three_in_field_order(spark):
    row = ('["nephrology","emergencyMedicine"]', '["Hemodialysis|Treatment"]',
           '{"capabilities": [{"capability_name": "Dialysis unit"}], "primary_focus": "x"}',
           "Dialysis unit in nation 3, segment building")
    df = spark.createDataFrame([row], "specialties string, standardized_services string, "
                                      "parsed_capability string, description string")
    kws = F.array(*[F.lit(k) for k in ["dialysis", "nephrology", "renal", "kidney", "haemodialysis", "hemodialysis"]])
    got = ev.with_evidence(df, kws).first()["evidence"]
    assert got == [
        "Matched specialty: Nephrology",
        "Matched service: Hemodialysis|Treatment",
        'Matched capability: ...Capability": "Dialysis unit"}], "primary_focus": "x',
    ]


def test_excerpt_marks(spark):
    text = "a" * 50 + " dialysis " + "b" * 100
    df = spark.createDataFrame([(text,)], "v string")
    out = df.select(ev.excerpt(F.col("v"), F.lit("Dialysis"))).first()[0]
    assert out.startswith("...") and out.endswith("...")
    assert len(out) == 3 + 120 + 3 - 0 or "dialysis" in out
