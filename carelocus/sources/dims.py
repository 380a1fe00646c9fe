"""Constant dictionaries used by search planning and result display.

The values below are FIXED VALUES: they must equal the behaviour being
matched for results to agree, so they are stated plainly and in their
original priority order. Order is semantic — the first gazetteer name and
the first care need that match a search text win — so every table carries an
explicit priority when it is turned into a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — city gazetteer: (name, latitude, longitude), priority order.
# ---------------------------------------------------------------------------
GAZETTEER: list[tuple[str, float, float]] = [
    ("delhi", 28.6139, 77.2090), ("new delhi", 28.6139, 77.2090),
    ("mumbai", 19.0760, 72.8777), ("bombay", 19.0760, 72.8777),
    ("bangalore", 12.9716, 77.5946), ("bengaluru", 12.9716, 77.5946),
    ("hyderabad", 17.3850, 78.4867),
    ("chennai", 13.0827, 80.2707), ("madras", 13.0827, 80.2707),
    ("kolkata", 22.5726, 88.3639), ("calcutta", 22.5726, 88.3639),
    ("pune", 18.5204, 73.8567),
    ("ahmedabad", 23.0225, 72.5714),
    ("jaipur", 26.9124, 75.7873),
    ("patna", 25.5941, 85.1376),
    ("lucknow", 26.8467, 80.9462),
    ("bhopal", 23.2599, 77.4126),
    ("indore", 22.7196, 75.8577),
    ("chandigarh", 30.7333, 76.7794),
    ("kochi", 9.9312, 76.2673), ("cochin", 9.9312, 76.2673),
    ("nagpur", 21.1458, 79.0882),
    ("visakhapatnam", 17.6868, 83.2185), ("vizag", 17.6868, 83.2185),
    ("surat", 21.1702, 72.8311),
    ("coimbatore", 11.0168, 76.9558),
    ("agra", 27.1767, 78.0081),
    ("varanasi", 25.3176, 82.9739),
    ("amritsar", 31.6340, 74.8723),
    ("guwahati", 26.1445, 91.7362),
    ("bhubaneswar", 20.2961, 85.8245),
    ("thiruvananthapuram", 8.5241, 76.9366), ("trivandrum", 8.5241, 76.9366),
    ("ranchi", 23.3441, 85.3096),
    ("raipur", 21.2514, 81.6296),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — care needs and their keywords, priority order.
# ---------------------------------------------------------------------------
CARE_NEEDS: list[tuple[str, list[str]]] = [
    ("dialysis", ["dialysis", "nephrology", "renal", "kidney", "haemodialysis", "hemodialysis"]),
    ("emergency", ["emergency", "trauma", "casualty", "critical care", "icu", "accident"]),
    ("maternity", ["maternity", "obstetrics", "gynaecology", "gynecology", "delivery", "neonatal", "prenatal"]),
    ("cardiac", ["cardiac", "cardiology", "heart", "cardiovascular", "angioplasty", "bypass"]),
    ("cancer", ["cancer", "oncology", "chemotherapy", "radiation", "tumour", "tumor"]),
    ("orthopedic", [
        "orthopedic", "orthopaedic", "orthopedics", "orthopaedics",
        "fracture", "broken", "broke", "surgery", "surgical", "trauma",
        "joint replacement", "spine", "bone", "hand", "wrist", "arm",
    ]),
    ("eye", ["eye", "ophthalmology", "cataract", "retina", "glaucoma", "vision"]),
    ("dental", ["dental", "dentist", "dentistry", "teeth", "oral", "tooth"]),
    ("neurology", ["neurology", "neuro", "brain", "stroke", "seizure", "epilepsy"]),
    ("pediatric", ["pediatric", "paediatric", "children", "child", "nicu", "infant"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — words dropped from search text before keyword extraction.
# ---------------------------------------------------------------------------
STOPWORDS: list[str] = [
    "a", "an", "and", "around", "at", "best", "care", "center", "centre", "clinic",
    "doctor", "doctors", "facility", "find", "for", "help", "hospital", "hospitals",
    "in", "me", "near", "nearby", "need", "of", "please", "support", "the", "to",
    "treatment", "with", "want", "make", "sure", "live", "require", "requires",
    "required", "plenty", "newer", "good", "ratings", "rating", "machines",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — intent rules, preference rules, scoring and evidence terms.
# ---------------------------------------------------------------------------
INJURY_WORDS = ["broke", "broken", "fracture", "fractured"]
LIMB_WORDS = ["hand", "wrist", "arm", "finger", "thumb", "bone"]
ORTHOPEDIC_PLAN_KEYWORDS = [
    "orthopedic", "orthopaedic", "orthopedics", "orthopaedics",
    "fracture", "trauma", "bone", "hand surgery", "surgery", "surgical",
]
ORTHOPEDIC_NEED = "orthopedic fracture surgery"
SURGERY_TRIGGERS = ["surgery", "surgical"]
SURGICAL_KEYWORDS = ["surgery", "surgical", "operation", "trauma"]
SURGICAL_NEED = "surgical care"
DEFAULT_NEED = "matching"

# (preference label, trigger phrases), in the order preferences are listed.
PREFERENCE_RULES: list[tuple[str, list[str]]] = [
    ("larger facility", ["big hospital", "large hospital", "plenty", "many doctors"]),
    ("advanced equipment", ["newer machines", "advanced equipment", "machines", "equipment"]),
    ("good ratings", ["good ratings", "rating", "ratings", "review", "reviews"]),
]
STRENGTH_WISH_TERMS = ["large", "larger", "big", "capacity", "doctor", "equipment"]

ORTHOPEDIC_INTENT_TERMS = ["orthopedic", "orthopaedic", "fracture", "hand surgery"]
# (terms any of which must appear, points) for orthopedic-intent scoring.
ORTHOPEDIC_SCORE_RULES: list[tuple[list[str], int]] = [
    (["orthopedic", "orthopaedic"], 8),
    (["fracture"], 5),
    (["trauma"], 4),
    (["hand surgery"], 4),
    (["surgery", "surgical"], 1),
]
DENTAL_TERMS = ["dental", "oral", "maxillofacial"]
DENTAL_PENALTY = 8
ORTHOPEDIC_MIN_SCORE = 4
ORTHOPEDIC_EVIDENCE_KEYWORDS = [
    "orthopedic", "orthopaedic", "orthopedics", "orthopaedics",
    "fracture", "trauma", "hand surgery", "surgery",
]

# Values treated as "no value" by the display layer.
MISSING_MARKERS = ["null", "none", "nan", "n/a", "unknown"]

# Evidence field order and labels.
EVIDENCE_FIELDS: list[tuple[str, str]] = [
    ("specialties", "Matched specialty"),
    ("standardized_services", "Matched service"),
    ("parsed_capability", "Matched capability"),
    ("description", "Mentioned in facility notes"),
]
# Fields that are scanned (lower-cased, blank-joined) for relevance.
SEARCH_TEXT_FIELDS = ["name", "organization_type", "specialties", "standardized_services",
                      "parsed_capability", "description"]
# JSON keys that name an evidence item, in priority order.
EVIDENCE_NAME_KEYS = ["capability_name", "standardized_service_name", "specialty_name", "name", "description"]

CONFIDENCE_LABELS: list[tuple[str, str]] = [
    ("confirmed", "confirmed location"),
    ("coordinate_based", "approximate location"),
    ("ambiguous_pin", "location uncertain"),
    ("unresolved", "location unknown"),
]
UNKNOWN_CONFIDENCE_LABEL = "unknown"

# Search limits.
KEYWORD_LIMIT = 16
PREFERENCE_LIMIT = 8
MIN_TERM_LENGTH = 3
RADIUS_MIN_KM = 5
RADIUS_MAX_KM = 500
RADIUS_DEFAULT_KM = 50
TOP_K = 5
EVIDENCE_PER_RESULT = 3
STRUCTURED_MATCHES = 3
EXCERPT_BEFORE = 36
EXCERPT_AFTER = 84
EVIDENCE_DISPLAY_CHARS = 140
CONTACT_FALLBACK_CHARS = 40
KM_PER_DEGREE = 111.0


# ---------------------------------------------------------------------------
# Dimension DataFrames (A7). Each is tiny and fixed in size, so broadcasting
# them is safe by construction.
# ---------------------------------------------------------------------------
def gazetteer_df(spark: SparkSession) -> DataFrame:
    rows = [(name, i, lat, lon) for i, (name, lat, lon) in enumerate(GAZETTEER, start=1)]
    return spark.createDataFrame(rows, "name string, priority int, lat double, lon double")


def care_needs_df(spark: SparkSession) -> DataFrame:
    rows = [
        (need, p, kw, k)
        for p, (need, kws) in enumerate(CARE_NEEDS, start=1)
        for k, kw in enumerate(kws, start=1)
    ]
    return spark.createDataFrame(rows, "need string, need_priority int, keyword string, kw_pos int")


def stopwords_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOPWORDS], "word string")


def confidence_labels_df(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(CONFIDENCE_LABELS, "location_confidence string, label string"))
