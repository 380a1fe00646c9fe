"""S1-S6 — enrichment of raw facility text.

The reference asks a hosted language model, per row, to standardise
specialties, services and equipment and to structure capability text. Here:

* S1 builds the same prompts as a column (NULL input -> NULL prompt).
* S2 sends only DISTINCT prompts to a caller-supplied batch function through
  ``mapInPandas`` (Arrow batches) and joins the answers back, so a prompt
  repeated by a third of all rows costs one call.
* S3-S5 are deterministic dictionary jobs: a term is normalised, looked up in
  a small synonym map (a literal map, evaluated per row with no join and no
  shuffle), or rebuilt by rule; order is kept and duplicates dropped.
* S6 parses a capability object into one row per capability.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelocus.functions.text import const, contains_any, strict_json

# FIXED VALUES — prompt text around each input column (model name is a parameter).
PROMPTS: dict[str, tuple[str, str, str]] = {
    # kind: (input column, text before, text after)
    "specialties": (
        "specialties",
        "You are a medical specialties expert. Standardize the following specialties using the conventions "
        "(https://careersinmedicine.aamc.org/explore-options/specialty-profiles) as the gold standard. "
        "Return ONLY a valid JSON array in this exact format: [\"standardized_name\", ...]. "
        "Rules: "
        "1. Combine similar/duplicate services into single standardized terms "
        "2. Use camelCase for specialty names "
        "3. Ensure to use AAMC-based valid specialties "
        "4. For specialties with brand names, standardize to generic name "
        "Input JSON array: ",
        ". Output only the JSON array, no explanation.",
    ),
    "services": (
        "procedure",
        "You are a medical terminology expert. Standardize the following medical procedures and services using "
        "Mayo Clinic naming conventions (https://www.mayoclinic.org/tests-procedures/index) as the gold standard. "
        "Return ONLY a valid JSON array in this exact format: [\"standardized_name|category\", ...]. "
        "Rules: "
        "1. Use Mayo Clinic official procedure names when available (e.g., \"Hip replacement\" → \"Hip Replacement\") "
        "2. Remove all facility names, metadata, and non-medical content "
        "3. Combine similar/duplicate services into single standardized terms "
        "4. Use Title Case for procedure names "
        "5. Keep precise medical terminology "
        "6. Categorize each as: Surgery, Diagnostic, Treatment, or Support Service "
        "7. For robotic-assisted procedures, standardize as the base procedure (e.g., \"Robotic knee replacement\" → "
        "\"Knee Replacement|Surgery\") "
        "Input JSON array: ",
        ". Output only the JSON array, no explanation.",
    ),
    "equipment": (
        "equipment",
        "You are a medical equipment classification expert. Standardize the following medical equipment using "
        "Wikipedia medical equipment naming conventions (https://en.wikipedia.org/wiki/Category:Medical_equipment) "
        "as the gold standard. "
        "Return ONLY a valid JSON array in this exact format: [\"standardized_equipment_name|category\", ...]. "
        "Rules: "
        "1. Use Wikipedia official medical equipment names when available (e.g., \"CT scanner\" → \"CT Scanner\") "
        "2. Remove quantities, facility names, metadata, and non-equipment content "
        "3. Combine similar/duplicate equipment into single standardized terms "
        "4. Use Title Case for equipment names "
        "5. Keep precise medical terminology "
        "6. Categorize each as: Imaging Equipment, Life Support Equipment, Surgical Equipment, Diagnostic Equipment, "
        "Laboratory Equipment, or Medical Furniture "
        "7. For equipment with brand names, standardize to generic name "
        "8. Exclude non-medical infrastructure (parking, buildings, staff counts) "
        "Input JSON array: ",
        ". Output only the JSON array, no explanation.",
    ),
    "capability": (
        "capability",
        "You are a healthcare capability analyst preparing data for AI agent consumption. "
        "Parse and structure the following medical facility capability information. "
        "Return a JSON object with this exact structure: "
        "{\"capabilities\": [{\"capability_name\": \"<name>\", \"category\": "
        "\"<Clinical|Operational|Technical|Infrastructure|Educational|Research>\", \"description\": \"<description>\", "
        "\"complexity_level\": \"<Basic|Intermediate|Advanced|Specialized>\", \"ai_agent_tags\": [\"<tags>\"]}], "
        "\"primary_focus\": \"<focus>\", \"specialization_level\": \"<General|Specialized|Tertiary|Quaternary>\", "
        "\"summary\": \"<150 char summary>\"} "
        "Rules: 1. Standardize capability names 2. Use specified categories 3. Assign complexity levels "
        "4. Add AI agent tags 5. Identify primary focus 6. Assess specialization level 7. Create concise summary "
        "8. Remove redundancy 9. Include metrics. "
        "Input capability data: ",
        "",
    ),
}

# FIXED VALUES — allowed enumerations of the capability object.
CAPABILITY_CATEGORY = ["Clinical", "Operational", "Technical", "Infrastructure", "Educational", "Research"]
COMPLEXITY = ["Basic", "Intermediate", "Advanced", "Specialized"]
SPECIALIZATION = ["General", "Specialized", "Tertiary", "Quaternary"]
SUMMARY_CHARS = 150

# Our own term dictionaries (normalised variant -> standard form). Small by
# construction; they stand in for the model's knowledge in deterministic runs.
SPECIALTY_SYNONYMS = {
    "kidney specialist": "nephrology", "heart specialist": "cardiology", "orthopaedics": "orthopedicSurgery",
    "orthopedics": "orthopedicSurgery", "orthopedic surgery": "orthopedicSurgery", "dental": "dentistry",
    "general medicine": "internalMedicine", "ent": "otolaryngology", "paediatrics": "pediatrics",
}
SERVICE_SYNONYMS = {
    "hip replacement surgery": "hip replacement", "hemodialysis": "dialysis", "physio therapy": "physical therapy",
    "mri": "mri scan", "root canal treatment": "root canal",
}
SERVICE_NAMES = {"ct scan": "CT Scan", "mri scan": "MRI Scan"}
SERVICE_CATEGORY_RULES = [  # (words, category), first match wins; default Treatment
    (["surgery", "replacement", "ectomy", "root canal", "angioplasty"], "Surgery"),
    (["scan", "x-ray", "test", "biopsy", "mri", "graphy"], "Diagnostic"),
    (["counselling", "vaccination", "ambulance"], "Support Service"),
]
EQUIPMENT_SYNONYMS = {
    "ventilators": "ventilator", "mri machine": "mri scanner", "x-ray": "x-ray machine",
    "ultrasound": "ultrasound machine", "hospital beds": "hospital bed",
}
EQUIPMENT_NAMES = {"ct scanner": "CT Scanner", "mri scanner": "MRI Scanner", "x-ray machine": "X-Ray Machine"}
# Excluded wherever they stand as whole words, and excluded as whole terms.
EQUIPMENT_EXCLUDE_WORDS = ["parking", "building", "staff", "canteen", "nurses"]
EQUIPMENT_EXCLUDE_TERMS = ["lift", "lifts", "passenger lift", "elevator"]
EXCLUDED_WORDS = r"\b(" + "|".join(EQUIPMENT_EXCLUDE_WORDS) + r")\b"
SPECIFICATION = r"^[0-9]+ (slice|lead|channel|row|way|tesla|watt|litre|liter|mm|cm|ml|kv|ma|inch|part)s?\b"
EQUIPMENT_CATEGORY_RULES = [
    (["scanner", "x-ray", "ultrasound", "mri"], "Imaging Equipment"),
    (["ventilator", "defibrillator", "monitor", "dialysis"], "Life Support Equipment"),
    (["bed", "trolley", "wheelchair", "stretcher"], "Medical Furniture"),
    (["analyzer", "centrifuge", "microscope"], "Laboratory Equipment"),
    (["scalpel", "laparoscope", "cautery"], "Surgical Equipment"),
]
EQUIPMENT_DEFAULT_CATEGORY = "Diagnostic Equipment"


# --------------------------------------------------------------------------- S1 / S2
def enrichment_requests(raw: DataFrame, id_col: str = "unique_id") -> DataFrame:
    """One (id, kind, prompt) row per facility and enrichment kind; NULL input -> NULL prompt."""
    per_kind = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(before), F.col(col), F.lit(after)).alias("prompt"))
        for kind, (col, before, after) in PROMPTS.items()
    ])
    return raw.select(id_col, F.inline(per_kind))


def apply_model(requests: DataFrame, model: Callable[[pd.Series], pd.Series], prompt_col: str = "prompt",
                out_col: str = "response") -> DataFrame:
    """Answer each DISTINCT non-NULL prompt once with `model` (pandas Series in,
    Series out, called per Arrow batch) and attach the answers to every request."""
    asked = requests.where(F.col(prompt_col).isNotNull())
    distinct = asked.select(prompt_col).distinct()

    def answer(batches):
        for pdf in batches:
            yield pd.DataFrame({prompt_col: pdf[prompt_col], out_col: model(pdf[prompt_col]).astype("string")})

    answered = distinct.mapInPandas(answer, f"{prompt_col} string, {out_col} string")
    # Requests without a prompt stay out of the join, where they would all meet in one task.
    silent = requests.where(F.col(prompt_col).isNull()).withColumn(out_col, F.lit(None).cast("string"))
    return asked.join(answered, prompt_col, "left").unionByName(silent)


def echo_model(prompts: pd.Series) -> pd.Series:
    """A deterministic stand-in model for tests: 'ok:<prompt length>'."""
    return "ok:" + prompts.str.len().astype(str)


# --------------------------------------------------------------------------- S3-S5
def _json_strings(c: Column) -> Column:
    """Strict parse of a JSON array of strings (NULL when not one)."""
    return F.try_variant_get(strict_json(c), "$", "array<string>")


def _norm(t: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(const_map(mapping), key)


def const_map(mapping: dict[str, str]) -> Column:
    keys, values = list(mapping), list(mapping.values())
    return F.map_from_arrays(const(keys), const(values))


def camel_case(words_text: Column) -> Column:
    """'orthopedic surgery' -> 'orthopedicSurgery'."""
    words = F.split(words_text, " ")
    return F.concat(F.lower(F.get(words, 0)),
                    F.array_join(F.transform(F.slice(words, F.lit(2), F.size(words)), lambda w: F.initcap(w)), ""))


def _categorise(name: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    out = None
    for words, category in rules:
        cond = contains_any(name, words)
        out = F.when(cond, F.lit(category)) if out is None else out.when(cond, F.lit(category))
    return out.otherwise(F.lit(default))


def _finish(items: Column) -> Column:
    return F.to_json(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))))


def standardize_specialties(raw: DataFrame, col: str = "specialties") -> DataFrame:
    """S3: JSON array of raw specialties -> JSON array of camelCase standard names."""
    def one(t: Column) -> Column:
        n = _norm(F.regexp_replace(t, "([a-z])([A-Z])", "$1 $2"))
        return F.coalesce(_lookup(SPECIALTY_SYNONYMS, n), camel_case(n))
    return raw.select("unique_id", _finish(F.transform(_json_strings(F.col(col)), one)).alias("standardized_specialties"))


def standardize_services(raw: DataFrame, col: str = "procedure") -> DataFrame:
    """Raw procedures -> ["Name|Category", ...]: robotic variants become the base
    procedure, synonyms merge, Title Case, category by dictionary rules."""
    def one(t: Column) -> Column:
        n = _norm(t)
        base = F.when(n.isin("robotic surgery", "robotic-assisted surgery"), n).otherwise(F.regexp_replace(n, r"^robotic(-assisted)? ", ""))
        merged = F.coalesce(_lookup(SERVICE_SYNONYMS, base), base)
        name = F.coalesce(_lookup(SERVICE_NAMES, merged), F.initcap(merged))
        category = _categorise(merged, SERVICE_CATEGORY_RULES, "Treatment")
        return F.when(merged != "", F.concat(name, F.lit("|"), category))
    return raw.select("unique_id", _finish(F.transform(_json_strings(F.col(col)), one)).alias("standardized_services"))


def standardize_equipment(raw: DataFrame, col: str = "equipment") -> DataFrame:
    """Raw equipment -> ["Name|Category", ...]: quantities removed, non-medical
    infrastructure excluded, synonyms merged, Title Case, category by rules."""
    def one(t: Column) -> Column:
        n = _norm(t)
        # A whole leading number is a quantity unless it belongs to a specification; so is a whole trailing "x N".
        counted = F.when(n.rlike(SPECIFICATION), n).otherwise(F.regexp_replace(n, r"^[0-9]+ ", ""))
        bare = F.trim(F.regexp_replace(counted, r" x ?[0-9]+$", ""))
        merged = F.coalesce(_lookup(EQUIPMENT_SYNONYMS, bare), bare)
        name = F.coalesce(_lookup(EQUIPMENT_NAMES, merged), F.initcap(merged))
        category = _categorise(merged, EQUIPMENT_CATEGORY_RULES, EQUIPMENT_DEFAULT_CATEGORY)
        return F.when((merged != "") & ~n.rlike(EXCLUDED_WORDS) & ~bare.isin(EQUIPMENT_EXCLUDE_TERMS), F.concat(name, F.lit("|"), category))
    return raw.select("unique_id", _finish(F.transform(_json_strings(F.col(col)), one)).alias("standardized_equipment"))


# --------------------------------------------------------------------------- S6
CAPABILITY_SCHEMA = (
    "capabilities array<struct<capability_name: string, category: string, description: string, "
    "complexity_level: string, ai_agent_tags: array<string>>>, primary_focus string, "
    "specialization_level string, summary string"
)


def _enum(c: Column, allowed: list[str]) -> Column:
    return F.when(c.isin(*allowed), c)


def capability_explode(raw: DataFrame, col: str = "capability") -> DataFrame:
    """Capability object -> one row per capability (a facility whose text is
    missing or not valid JSON keeps one row of NULLs); enums checked, summary cut."""
    ok = strict_json(F.col(col)).isNotNull()
    parsed = raw.select("unique_id", ok.alias("parse_ok"),
                        F.when(ok, F.from_json(F.col(col), CAPABILITY_SCHEMA)).alias("p"))
    rows = parsed.select("unique_id", "parse_ok", "p", F.posexplode_outer("p.capabilities").alias("cap_pos", "c"))
    return rows.select(
        "unique_id", "parse_ok", "cap_pos",
        F.col("c.capability_name").alias("capability_name"),
        _enum(F.col("c.category"), CAPABILITY_CATEGORY).alias("category"),
        F.col("c.description").alias("description"),
        _enum(F.col("c.complexity_level"), COMPLEXITY).alias("complexity_level"),
        F.array_join(F.col("c.ai_agent_tags"), ", ").alias("ai_agent_tags"),
        F.col("p.primary_focus").alias("primary_focus"),
        _enum(F.col("p.specialization_level"), SPECIALIZATION).alias("specialization_level"),
        F.substring(F.col("p.summary"), 1, SUMMARY_CHARS).alias("summary"),
    )
