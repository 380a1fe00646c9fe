"""Input tables derived from the driver's parquet tables (see FIXTURES.md).

Every fixture is a pure projection / aggregation of ``orders``, ``customer``
or ``events`` with integer arithmetic, so its size grows with the input and
DuckDB can rebuild identical rows for the oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelocus.functions.text import const

# FIXED VALUES — fixture vocabulary V: (specialty, service, capability), index 0..11.
VOCAB: list[tuple[str, str, str]] = [
    ("nephrology", "Hemodialysis|Treatment", "Dialysis unit"),
    ("emergencyMedicine", "Trauma Care|Treatment", "24x7 casualty and ICU"),
    ("obstetricsAndGynecology", "Normal Delivery|Treatment", "Neonatal care"),
    ("cardiology", "Angioplasty|Surgery", "Heart centre"),
    ("ophthalmology", "Cataract Surgery|Surgery", "Retina clinic"),
    ("orthopedicSurgery", "Fracture Fixation|Surgery", "Trauma and hand surgery"),
    ("pediatrics", "Vaccination|Support Service", "Children ward"),
    ("medicalOncology", "Chemotherapy|Treatment", "Cancer day care"),
    ("dentistry", "Root Canal|Surgery", "Oral and maxillofacial"),
    ("neurology", "EEG|Diagnostic", "Stroke unit"),
    ("physiotherapy", "Physical Therapy|Treatment", "Rehabilitation"),
    ("radiology", "MRI Scan|Diagnostic", "Imaging"),
]

# FIXED VALUES — search texts T (0..11) and cities C (0..7; '' = no city).
SEARCH_TEXTS: list[str] = [
    "dialysis", "emergency surgery", "maternity", "best cardiac hospital",
    "cataract surgery", "broken wrist", "child with seizure",
    "big hospital with good ratings for cancer", "dental clinic", "hospital",
    "physiotherapy newer machines", "MRI scan",
]
SEARCH_CITIES: list[str] = [
    "Delhi", "New Delhi", "Jaipur", "Agra", "Chandigarh", "Visakhapatnam", "Mumbai", "",
]

DMS_FRAGMENT = "26°57'17.7"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _pick(values: list[str], index: Column) -> Column:
    """values[index] for a 0-based integer column (constant-size literal array)."""
    return F.element_at(const(list(values)), (index + 1).cast("int"))


def _dec(m: Column) -> Column:
    """Decimal text of m/1000 with three places, NULL-propagating."""
    return F.concat(
        F.floor(m / 1000).cast("string"),
        F.lit("."),
        F.lpad((m % 1000).cast("string"), 3, "0"),
    )


def postal_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post office per order: pincode, district, statename, latitude, longitude (strings)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey")
    p = F.expr("o_orderkey div 8")
    j = F.col("o_orderkey") % 8
    base_dno = (p * 31) % 40
    shifted = ((p % 10 == 0) & (j >= 6)) | ((p % 10 == 1) & (j >= 4))
    dno = F.when(shifted, (base_dno + 1) % 40).otherwise(base_dno)
    df = o.select(p.alias("p"), j.alias("j"), dno.alias("dno"))
    dn = F.concat(F.lit("District "), F.col("dno").cast("string"))
    p, j, dno = F.col("p"), F.col("j"), F.col("dno")
    lat_na = (p % 25 == 7) | ((p + j) % 13 == 0)
    return df.select(
        (p + 110000).cast("string").alias("pincode"),
        F.when(p % 50 == 2, F.lit(None).cast("string"))
        .when(j % 3 == 0, F.upper(dn))
        .when(j % 3 == 1, dn)
        .otherwise(F.concat(F.lit(" "), F.lower(dn), F.lit(" ")))
        .alias("district"),
        F.when((p % 10 == 3) & (j >= 4), F.concat(F.lit("State "), ((dno + 1) % 6).cast("string")))
        .otherwise(F.concat(F.lit("State "), (dno % 6).cast("string")))
        .alias("statename"),
        F.when(lat_na, F.lit("NA"))
        .when((p % 20 == 5) & (j == 3), F.lit(DMS_FRAGMENT))
        .otherwise(_dec(F.lit(25000) + (p * 7919) % 4993 + j))
        .alias("latitude"),
        F.when(lat_na | ((p % 30 == 11) & (j == 2)), F.lit("NA"))
        .otherwise(_dec(F.lit(74000) + (p * 104729) % 4999 + 2 * j))
        .alias("longitude"),
    )


def _customers_with_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    first_order = (
        read_table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.expr("min(o_orderkey) div 8").alias("p"))
    )
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return cust.join(first_order, cust.c_custkey == first_order.o_custkey, "left").drop("o_custkey")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One facility per customer with the columns the pipeline reads."""
    c = _customers_with_p(spark, sf_dir)
    k, p = F.col("c_custkey"), F.col("p")
    ks = k.cast("string")
    no_coord = k % 17 == 0
    far = k % 19 == 1
    pin = (p + 110000).cast("string")
    spec = [v[0] for v in VOCAB]
    cap = [v[2] for v in VOCAB]
    return c.select(
        F.concat(F.lit("F"), ks).alias("unique_id"),
        F.col("c_name").alias("name"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("organization_type"),
        F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("call us")).alias("phone_numbers"),
        F.when(k % 3 == 0, F.lit("unknown"))
        .otherwise(F.concat(F.lit("+91 98765 "), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit(" (desk)")))
        .alias("officialPhone"),
        F.concat(F.lit("f"), ks, F.lit("@clinic.example.org")).alias("email"),
        F.when(k % 4 == 2, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit('["https://f'), ks, F.lit('.example.org"]'))).alias("websites"),
        F.when(k % 5 == 3, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://f"), ks, F.lit(".example.org"))).alias("officialWebsite"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
        .when(k % 4 == 1, F.lit("unknown"))
        .otherwise((k % 50 + 1).cast("string")).alias("numberDoctors"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise((k % 300).cast("string")).alias("capacity"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(_pick(cap, k % 12), F.lit(" in nation "), F.col("c_nationkey").cast("string"),
                            F.lit(", segment "), F.lower(F.col("c_mktsegment"))))
        .alias("description"),
        F.concat(F.lit("Plot "), (k % 97 + 1).cast("string"), F.lit(", Main Road")).alias("address_line1"),
        F.when(k % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("Near bus stand")).alias("address_line2"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("City "), (k % 40).cast("string"))).alias("address_city"),
        F.when(k % 14 == 0, F.lit("")).otherwise(F.concat(F.lit("State "), (k % 6).cast("string")))
        .alias("address_stateOrRegion"),
        F.when(k % 10 <= 5, pin)
        .when(k % 10 == 6, F.lit(None).cast("string"))
        .when(k % 10 == 7, (p + 110001).cast("string"))
        .when(k % 10 == 8, F.lit("999999"))
        .otherwise(F.concat(F.lit(" "), pin))
        .alias("address_zipOrPostcode"),
        F.lit("India").alias("address_country"),
        F.concat(F.lit('["'), _pick(spec, k % 12), F.lit('","'), _pick(spec, (k * 5 + 1) % 12), F.lit('"]'))
        .alias("specialties"),
        F.when(no_coord, F.lit("NA"))
        .when(far, _dec(F.lit(10000) + k % 1000))
        .otherwise(_dec(F.lit(25000) + (p * 7919) % 4993 + k % 7))
        .alias("latitude"),
        F.when(no_coord, F.lit("NA"))
        .when(far, _dec(F.lit(70000) + k % 1000))
        .otherwise(_dec(F.lit(74000) + (p * 104729) % 4999 + k % 11))
        .alias("longitude"),
    )


def _custkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    svc = [v[1] for v in VOCAB]
    return _custkeys(spark, sf_dir).filter(k % 9 != 0).select(
        F.concat(F.lit("F"), k.cast("string")).alias("unique_id"),
        F.concat(F.lit('["'), _pick(svc, k % 12), F.lit('","'), _pick(svc, (k * 5 + 1) % 12), F.lit('"]'))
        .alias("standardized_services"),
    )


def equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _custkeys(spark, sf_dir).filter(k % 10 != 0).select(
        F.concat(F.lit("F"), k.cast("string")).alias("unique_id"),
        F.when(k % 2 == 0, F.lit('["CT Scanner|Imaging Equipment"]'))
        .otherwise(F.lit('["Ventilator|Life Support Equipment"]'))
        .alias("standardized_equipment"),
    )


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    cap = [v[2] for v in VOCAB]
    return _custkeys(spark, sf_dir).filter(k % 11 != 0).select(
        F.concat(F.lit("F"), k.cast("string")).alias("unique_id"),
        F.concat(
            F.lit('{"capabilities": [{"capability_name": "'), _pick(cap, k % 12),
            F.lit('"}], "primary_focus": "'), _pick(cap, (k * 5 + 1) % 12), F.lit('"}'),
        ).alias("parsed_capability"),
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One free-text search per event."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    city = _pick(SEARCH_CITIES, F.col("user_id") % 8)
    text = _pick(SEARCH_TEXTS, F.col("event_id") % 12)
    return e.select(
        F.col("event_id").alias("search_id"),
        F.when(city == "", text).otherwise(F.concat(text, F.lit(" near "), city)).alias("query"),
    )


# FIXED VALUES — planner response templates; {C} = search city (may be ''),
# {c} = lower-cased city, {T} = search text. Every search gets template
# (event_id div 4) % 15; the last one stands for "no response" (NULL).
RESPONSE_TEMPLATES: list[str | None] = [
    '{"city": "{C}", "care_need": "{T}", "keywords": ["{T}", "specialist"], "must_have": ["{T}"], '
    '"nice_to_have": [], "preferences": ["larger facility"], "radius_km": 25}',
    '```json\n{"city": "{C}", "keywords": ["{T} unit"], "radius_km": "30"}\n```',
    'Here is the plan: {"city": "{c}", "care_need": null, "keywords": ["{T}"], "radius_km": null} Hope this helps.',
    'Sorry, I cannot plan this search.',
    '{"city": "Atlantis", "keywords": ["{T}"], "radius_km": 900}',
    '{"city": "{C}", "keywords": ["{T}"], "radius_km": "abc"}',
    '{"city": "{C}", "keywords": ["k01", "k02", "k03", "k04", "k05", "k06", "k07", "k08", "k09", "k10", '
    '"k11", "k12", "k13", "k14", "k15", "k16", "k17", "k18"], "radius_km": 12.7}',
    '{"city": "{C}", "keywords": ["{T}"], "radius_km": 2}',
    '{"city": "{C}", "keywords": [',
    '{"city": "", "care_need": "", "keywords": [], "preferences": ["Good Ratings!", "good ratings"], "radius_km": true}',
    '{"city": "{C}", "radius_km": 25} or maybe {"city": "{C}", "radius_km": 30}',
    '{"city": "{C}", "keywords": {"{T} unit": 1}, "radius_km": 12}',
    '{"city": "{C}", "keywords": 5, "radius_km": 12}',
    '{"choices": [{"message": {"role": "assistant", "content": "{\\"city\\": \\"{C}\\", \\"radius_km\\": 35}"}}]}',
    None,
    '{"city": "Atlantis", "keywords": ["first"], "city": "{C}", "keywords": ["{T}"], "radius_km": 20}',
    '{"city": false, "care_need": 0, "keywords": ["{T}"], "preferences": [], "radius_km": 15}',
    '{"city": {}, "care_need": [], "keywords": 0, "must_have": false, "nice_to_have": ["{T}"]}',
]


def planner_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_id, response: a model planner's raw text for every search (NULL = no answer)."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id")
    city = _pick(SEARCH_CITIES, F.col("user_id") % 8)
    text = _pick(SEARCH_TEXTS, F.col("event_id") % 12)
    shape = F.floor(F.col("event_id") / 4) % len(RESPONSE_TEMPLATES)
    filled = F.replace(F.replace(F.replace(
        _pick(RESPONSE_TEMPLATES, shape), F.lit("{C}"), city), F.lit("{c}"), F.lower(city)), F.lit("{T}"), text)
    return e.select(F.col("event_id").alias("search_id"), filled.alias("response"))


# FIXED VALUES — shapes of semi-structured evidence text (our own), by rule from the customer key; {T} is a term.
EVIDENCE_SHAPES: list[str] = [
    '[0, false, "{T}", null, "", [], {}, true, 7, 0.0, 1.5]',
    '{"name": 0, "description": "{T}"}',
    '[{"name": false, "description": "{T}"}, {"name": "", "specialty_name": "x y"}, {"name": []}, {"other": "{T}"}]',
    '{"name": "first", "description": "d", "name": "{T}"}',
    '{"capability_name": {}, "standardized_service_name": null, "specialty_name": 3}',
    '["{T}", "{T}"]',
    "{'name': '{T}', 'x': 1}",
    '{T}, other ,"quoted"',
    '{"capabilities": [{"name": "{T}"}]}',
    '0', 'false', '"{T}"', '[]', '{}', '', '["{T}"',
    '[{"name": "a", "name": "{T}"}]',
]


def evidence_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, value: an evidence text for every customer key."""
    k = F.col("k")
    return _custkeys(spark, sf_dir).select("k", F.replace(_pick(EVIDENCE_SHAPES, k % len(EVIDENCE_SHAPES)), F.lit("{T}"), _pick(RAW_PROCEDURES, k % len(RAW_PROCEDURES))).alias("value"))


# FIXED VALUES — raw, unstandardised terms as facilities state them (our own
# fixture vocabulary), indexed by rule from the customer key.
RAW_SPECIALTIES: list[str] = [
    "Nephrology", "kidney specialist", "Cardiology", "heart  specialist", "Cardiac Surgery", "Orthopaedics",
    "orthopedic surgery", "dental", "Dentistry", "General Medicine", "ENT", "Paediatrics", "pediatrics ",
    "internalMedicine", "obstetricsAndGynecology",
]
RAW_PROCEDURES: list[str] = [
    "Robotic knee replacement", "knee replacement", "Hip replacement", "hip  replacement surgery", "CT scan",
    "MRI", "Dialysis", "hemodialysis", "Cataract surgery", "Root canal treatment", "Angioplasty",
    "Robotic-assisted hip replacement", "Chemotherapy", "physio therapy",
    "Robotic surgery", "3D mammography",
]
RAW_EQUIPMENT: list[str] = [
    "2 CT scanner", "CT Scanner", "MRI machine", "Parking", "ventilators x3", "Defibrillator", "X-ray",
    "Building", "Hospital beds", "Staff: 20 nurses", "Ultrasound", "dialysis machine", "3 Ventilators",
    "12-lead ECG machine", "3D printer", "Apex 2", "Patient lift", "64 slice CT scanner", "Lift",
]
RAW_CAPABILITY_NAMES: list[str] = [
    "24x7 emergency", "Dialysis unit", "Cardiac cath lab", "Neonatal ICU", "Robotic surgery", "Tele-medicine",
]
CAPABILITY_CATEGORIES: list[str] = ["Clinical", "Operational", "Technical", "Infrastructure", "Bogus"]
COMPLEXITY_LEVELS: list[str] = ["Basic", "Intermediate", "Advanced", "Specialized", "Extreme"]
SPECIALIZATION_LEVELS: list[str] = ["General", "Specialized", "Tertiary", "Quaternary", "Unknown"]


def _json_list(values: list[str], k: Column, steps: list[tuple[int, int]]) -> Column:
    parts = []
    for mul, add in steps:
        parts.append(_pick(values, (k * mul + add) % len(values)))
    return F.concat(F.lit('["'), F.concat_ws('", "', *parts), F.lit('"]'))


def raw_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unique_id + raw specialties / procedure / equipment (JSON arrays as text) and a
    model-style capability object, with broken JSON and NULLs mixed in."""
    k = F.col("k")
    steps = [(1, 0), (7, 3), (11, 5)]
    cap_obj = F.concat(
        F.lit('{"capabilities": [{"capability_name": "'), _pick(RAW_CAPABILITY_NAMES, k % 6),
        F.lit('", "category": "'), _pick(CAPABILITY_CATEGORIES, k % 5),
        F.lit('", "description": "Provides '), F.lower(_pick(RAW_CAPABILITY_NAMES, k % 6)),
        F.lit(' services", "complexity_level": "'), _pick(COMPLEXITY_LEVELS, (k * 3) % 5),
        F.lit('", "ai_agent_tags": ["tag'), (k % 4).cast("string"), F.lit('", "care"]}, {"capability_name": "'),
        _pick(RAW_CAPABILITY_NAMES, (k + 2) % 6), F.lit('", "category": "Clinical"}], "primary_focus": "'),
        _pick(RAW_CAPABILITY_NAMES, (k + 1) % 6), F.lit('", "specialization_level": "'),
        _pick(SPECIALIZATION_LEVELS, k % 5), F.lit('", "summary": "'),
        F.repeat(F.lit("Facility with broad services. "), (k % 8).cast("int")), F.lit('"}'),
    )
    return _custkeys(spark, sf_dir).select(
        F.concat(F.lit("F"), k.cast("string")).alias("unique_id"),
        F.when(k % 17 == 0, F.lit(None).cast("string"))
        .when(k % 13 == 0, F.lit('["Nephrology", '))
        .otherwise(_json_list(RAW_SPECIALTIES, k, steps)).alias("specialties"),
        F.when(k % 19 == 0, F.lit(None).cast("string"))
        .otherwise(_json_list(RAW_PROCEDURES, k, steps)).alias("procedure"),
        F.when(k % 23 == 0, F.lit("[]"))
        .otherwise(_json_list(RAW_EQUIPMENT, k, steps)).alias("equipment"),
        F.when(k % 7 == 0, F.lit('{"capabilities": [{"capability_name": "broken"'))
        .when(k % 29 == 0, F.lit(None).cast("string"))
        .otherwise(cap_obj).alias("capability"),
    )


def part_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Raw term lists for a dictionary of the user's own: each part's name in a longer term, its type, its kind alone."""
    kind = F.element_at(F.split("p_name", " "), -1)
    terms = F.array(F.concat("p_name", F.lit(" unit")), F.col("p_type"), F.concat(F.lit("Spare "), kind), F.concat(F.lit(" old  "), "p_name"))
    return read_table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("unique_id"), F.to_json(terms).alias("terms"))


def part_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Term dictionary of the parts: whole names with a type as category, and kinds alone, of which "bolt" is excluded."""
    parts = read_table(spark, sf, "part")
    names = parts.groupBy("p_name").agg(F.min("p_type").alias("category")).select(F.col("p_name").alias("variant"), "category", F.lit(False).alias("excluded"))
    kind = F.element_at(F.split("p_name", " "), -1)
    kinds = parts.select(kind.alias("variant")).distinct().select("variant", F.lit(None).cast("string").alias("category"), (F.col("variant") == "bolt").alias("excluded"))
    return names.unionByName(kinds).select(F.lit("part").alias("kind"), "variant", F.upper("variant").alias("canonical"), "category", "excluded")
