"""Cases that clean fixtures do not hold: repeated ids, loose JSON, quantities, shared folders."""

import json

import pytest
from pyspark.sql import functions as F


def test_repeated_id_keeps_its_match(spark):
    from carelocus.operators import nearest as nn

    fac = spark.createDataFrame([("F1", "28.6", "77.2"), ("F1", "8.0", "93.0"), ("F2", "8.0", "93.0")], "unique_id string, latitude string, longitude string")
    lookup = spark.createDataFrame([("110001", "New Delhi", "Delhi", 28.61, 77.21, True)], "pincode string, district string, statename string, latitude double, longitude double, has_coordinates boolean")
    rows = {r.facility_id: r.coord_nearest_pincode for r in nn.nearest_pin_complete(fac, lookup).collect()}
    assert rows == {"F1": "110001", "F2": None}
    assert [r.facility_id for r in nn.unmatched_facilities(fac, lookup).collect()] == ["F2"]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('{"a": 1}', '{"a":1}'), ('{"a": 1} or maybe {"a": 2}', None), ('["a","b"] and more', None), ("[1] , [2", None),
        ("[]", "[]"), ("nonsense", None), ("", None), ('"x"', '"x"'), ("1] , [2", None), ('{"a": 1}, {"a": 2}', None),
    ],
)
def test_strict_json(spark, text, value):
    from carelocus.functions.text import strict_json

    row = spark.createDataFrame([(text,)], "t string").select(F.to_json(strict_json(F.col("t"))).alias("j")).first()
    assert row.j == value


def _merged(spark, responses):
    from carelocus.operators import plan as pl

    searches = spark.createDataFrame([(1, "dialysis near Delhi")], "search_id long, query string")
    given = spark.createDataFrame([(1, r) for r in responses], "search_id long, response string")
    return pl.merge_plans(searches, given).collect()


def test_list_fields_of_a_response(spark):
    row = _merged(spark, ['{"keywords": {"renal unit": 1}, "city": "Jaipur"}'])[0]
    assert "renal unit" in row.keywords and row.city == "Jaipur"
    row = _merged(spark, ['{"keywords": 5, "city": "Jaipur"}'])[0]
    assert row.source == "keyword fallback" and row.city == "Delhi"
    row = _merged(spark, ['{"keywords": 0, "city": "Jaipur"}'])[0]
    assert row.city == "Jaipur"


def test_chat_answer_and_repeated_response(spark):
    inner = json.dumps({"city": "Jaipur", "radius_km": 35})
    row = _merged(spark, [json.dumps({"choices": [{"message": {"content": inner}}]})])[0]
    assert (row.city, row.radius_km) == ("Jaipur", 35)
    rows = _merged(spark, ['{"city": "Jaipur"}', '{"city": "Delhi"}'])
    assert len(rows) == 1 and rows[0].city == "Delhi"


def test_terms_keep_their_numbers(spark):
    from carelocus.operators import enrich as en

    terms = ["12-lead ECG machine", "3D printer", "Apex 2", "Patient lift", "64 slice CT scanner", "2 CT scanner", "ventilators x3", "Lift", "Building"]
    raw = spark.createDataFrame([("F1", json.dumps(terms), json.dumps(["internalMedicine"]), json.dumps(["Robotic surgery", "3D mammography"]))], "unique_id string, equipment string, specialties string, procedure string")
    got = [x.split("|")[0] for x in json.loads(en.standardize_equipment(raw).first()[1])]
    assert got == ["12-lead Ecg Machine", "3d Printer", "Apex 2", "Patient Lift", "64 Slice Ct Scanner", "CT Scanner", "Ventilator"]
    assert json.loads(en.standardize_specialties(raw).first()[1]) == ["internalMedicine"]
    assert json.loads(en.standardize_services(raw).first()[1]) == ["Robotic Surgery|Surgery", "3d Mammography|Diagnostic"]


def test_no_silent_local_folder_on_a_cluster(spark):
    from carelocus.session import ensure_checkpoint_dir

    class Conf:
        def __init__(self, master):
            self.given = {"spark.master": master}

        def get(self, key, default=None):
            return self.given.get(key, default)

    class Session:
        conf = Conf("spark://host:7077")

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        ensure_checkpoint_dir(Session())


def test_pipeline_from_tables_to_tables(spark):
    from carelocus.plans.jobs import PipelineRun, run_pipeline, stage_inputs
    from carelocus.session import work_dir

    staged = stage_inputs(PipelineRun(spark, work_dir(spark, "from-tables")), "/root/testdata/sf0.001")
    inputs = {}
    for name, df in staged.items():
        df.write.mode("overwrite").saveAsTable(f"in_{name}")
        inputs[name] = f"in_{name}"
    run_pipeline(spark, inputs=inputs, with_reports=False, table_prefix="out_")
    assert spark.table("out_result_cards").count() > 0
    assert spark.table("out_pincode_lookup").count() == spark.table("out_pincode_lookup").select("pincode").distinct().count()


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ('[0,false,"a"]', ["A"]), ('{"name":0,"description":"d"}', ["D"]), ('[{"name":false,"description":"x"}]', ["X"]),
        ('["false", "0", [], {}, null]', ["False", "0"]), ('{"name": "a", "name": "b"}', ["B"]), ("0", ["0"]),
    ],
)
def test_missing_values_are_no_evidence(spark, text, items):
    from carelocus.functions.evidence import with_evidence_items

    assert with_evidence_items(spark.createDataFrame([(text,)], "v string"), "v", "items").first()["items"] == items


def test_planner_fields_that_count_as_missing(spark):
    from carelocus.operators import plan as pl

    searches = spark.createDataFrame([(i, "dialysis near Jaipur") for i in range(5)], "search_id int, query string")
    answers = [
        '{"care_need":0,"city":"Jaipur"}', '{"city":"Delhi","city":"Patna"}', '{"care_need":false,"city":[],"keywords":["x ray"]}',
        '{"care_need":"0","city":"Jaipur"}', '{"keywords":["one"],"keywords":["two words"],"city":"Delhi"}',
    ]
    got = {r.search_id: r for r in pl.merge_plans(searches, spark.createDataFrame(list(enumerate(answers)), "search_id int, response string")).collect()}
    assert [got[i].care_need for i in range(5)] == ["dialysis", "dialysis", "dialysis", "0", "dialysis"]
    assert [got[i].city for i in range(5)] == ["Jaipur", "Patna", "Jaipur", "Jaipur", "Delhi"]
    assert got[2].keywords[0] == "x ray" and got[4].keywords[0] == "two words" and "one" not in got[4].keywords
