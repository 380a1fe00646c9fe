"""J5 — turn a DataFrame of free-text searches into search plans, set-at-a-time.

Every step is a Column expression over constants (the gazetteer, care needs
and stop words are fixed, tiny literals), so planning is a narrow projection:
no join, no shuffle, no Python worker. Priority order of the dictionaries is
kept by CASE chains that return the position of the first hit (cities) and
one regex alternation per care need, tested in priority order.

Plan columns: city, latitude, longitude, care_need, keywords, preferences,
radius_km, source (+ status from ``with_status``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelocus.functions.text import clean_terms, const, contains_any, keep_last_of_repeated_keys, lit_array, strict_json, truthy_text
from carelocus.sources import dims

FALLBACK_SOURCE = "keyword fallback"
MODEL_SOURCE = "model planner"

PLAN_COLUMNS = ["city", "latitude", "longitude", "care_need", "keywords", "preferences", "radius_km", "source"]

_TOKEN = r"[a-z][a-z0-9+-]{2,}"


def _empty() -> Column:
    return F.array().cast("array<string>")


def _gazetteer() -> Column:
    return const([{"name": n, "title": n.title(), "lat": lat, "lon": lon} for n, lat, lon in dims.GAZETTEER])


def _needs() -> Column:
    return const([{"need": need, "keywords": kws} for need, kws in dims.CARE_NEEDS])


def _first_hit(conditions: list[Column]) -> Column:
    """0-based position of the first true condition (NULL if none): a CASE chain,
    evaluated inside whole-stage codegen and stopping at the first hit."""
    out = None
    for i, cond in enumerate(conditions):
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def occurs(ql: Column, term: str, match: str = "substring") -> Column:
    """`term` occurs in the text: as a substring (default, as the reference does,
    so 'patna' is found in 'visakhapatnam'), or as whole words (match='word')."""
    if match == "word":
        return ql.rlike(r"(?U)\b" + re.escape(term) + r"\b")
    return ql.contains(term)


def resolve_city(ql: Column, match: str = "substring") -> Column:
    """H1: struct(name, title, lat, lon) of the first gazetteer name contained in the text."""
    return F.get(_gazetteer(), _first_hit([occurs(ql, n, match) for n, _, _ in dims.GAZETTEER]))


def occurs_any(ql: Column, terms: list[str], match: str = "substring") -> Column:
    """Any of `terms` occurs: one regex alternation (a single compiled pattern,
    small generated code) instead of a chain of substring tests."""
    alternation = "|".join(re.escape(t) for t in terms)
    if match == "word":
        return ql.rlike(r"(?U)\b(?:" + alternation + r")\b")
    return ql.rlike(alternation)


def resolve_care_need(ql: Column, match: str = "substring") -> Column:
    """H2: struct(need, keywords) of the first need whose name or any keyword occurs."""
    conds = [occurs_any(ql, [need, *kws], match) for need, kws in dims.CARE_NEEDS]
    return F.get(_needs(), _first_hit(conds))


def city_words(ql: Column, match: str = "substring") -> Column:
    """Words of every gazetteer name found in the text (evaluated once per row)."""
    names = lit_array([n for n, _, _ in dims.GAZETTEER])
    if match == "word":
        found = F.filter(names, lambda n: F.regexp_like(ql, F.concat(F.lit(r"(?U)\b"), n, F.lit(r"\b"))))
    else:
        found = F.filter(names, lambda n: ql.contains(n))
    return F.flatten(F.transform(found, lambda n: F.split(n, " ")))


def query_tokens(ql: Column, words_of_cities: Column | None = None) -> Column:
    """H3: word tokens minus stop words minus the words of every city named."""
    cw = city_words(ql) if words_of_cities is None else words_of_cities
    stop = lit_array(dims.STOPWORDS)
    tokens = F.regexp_extract_all(ql, F.lit(_TOKEN), 0)
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t) & ~F.array_contains(cw, t))


def clean_query_tokens(ql: Column, words_of_cities: Column) -> Column:
    """Tokens minus stop words and city words, first occurrences only.

    Same terms, in the same order, as ``query_tokens`` once duplicates are
    dropped — which the keyword list does anyway — but set operations on
    arrays run in generated code where a lambda filter is interpreted.
    """
    tokens = F.regexp_extract_all(ql, F.lit(_TOKEN), 0)
    return F.array_except(tokens, F.concat(lit_array(dims.STOPWORDS), words_of_cities))


def clean_term_list(terms: Column, limit: int = dims.KEYWORD_LIMIT) -> Column:
    """H4 for lists made only of clean terms (dictionary keywords, regex tokens):
    cleaning would leave each term unchanged, so only the ordered de-duplication
    and the cap remain (no lambda). ``test_dictionary_terms_are_clean`` pins the
    precondition for the constant lists."""
    return F.slice(F.array_distinct(terms), 1, limit)


def infer_preferences(ql: Column) -> Column:
    """H7: preference labels whose trigger phrases occur, in rule order."""
    labels = F.array(*[F.when(contains_any(ql, triggers), F.lit(label)) for label, triggers in dims.PREFERENCE_RULES])
    return F.array_except(labels, F.array(F.lit(None).cast("string")))  # drop the rules that did not fire


def clamp_radius(r: Column) -> Column:
    """H8: clamp to [5, 500]; the value is already an integer or NULL -> default."""
    r = F.coalesce(r, F.lit(float(dims.RADIUS_DEFAULT_KM)))
    return F.least(F.greatest(r, F.lit(float(dims.RADIUS_MIN_KM))), F.lit(float(dims.RADIUS_MAX_KM))).cast("int")


def fallback_plan(searches: DataFrame, text_col: str = "query",
                  default_radius_km: int = dims.RADIUS_DEFAULT_KM, match: str = "substring",
                  keyword_limit: int = dims.KEYWORD_LIMIT) -> DataFrame:
    """H1-H9: the rule-based plan of every search (all input columns kept), with at most `keyword_limit` keywords.

    Intermediate values (lower-cased text, cities found, need found, city
    words, base keywords, intent flags) are staged as columns so that each is
    evaluated once per row, not once per array element inside a lambda.
    """
    ql, city, need = F.col("_ql"), F.col("_city"), F.col("_need")
    base = (
        searches.withColumn("_ql", F.lower(F.col(text_col)))
        .withColumn("_city", resolve_city(ql, match))
        .withColumn("_need", resolve_care_need(ql, match))
        .withColumn("_cw", city_words(ql, match))
        .withColumn("_kw", clean_term_list(F.concat(F.coalesce(need["keywords"], _empty()),
                                                    clean_query_tokens(ql, F.col("_cw"))), keyword_limit))
        .withColumn("_inj", contains_any(ql, dims.INJURY_WORDS) & contains_any(ql, dims.LIMB_WORDS))
        .withColumn("_surg", contains_any(ql, dims.SURGERY_TRIGGERS))
    )
    inj, surg, kw = F.col("_inj"), F.col("_surg"), F.col("_kw")
    keywords = (
        F.when(inj, clean_term_list(F.concat(lit_array(dims.ORTHOPEDIC_PLAN_KEYWORDS), kw), keyword_limit))
        .when(surg, clean_term_list(F.concat(lit_array(dims.SURGICAL_KEYWORDS), kw), keyword_limit))
        .otherwise(kw)
    )
    need_name = (
        F.when(inj, F.lit(dims.ORTHOPEDIC_NEED))
        .when(surg, F.coalesce(F.nullif(need["need"], F.lit("")), F.lit(dims.SURGICAL_NEED)))
        .otherwise(need["need"])
    )
    staged = base.withColumn("keywords", keywords).withColumn("_need2", need_name)
    # H6: no need yet -> the first three keywords, else a generic label.
    care_need = F.coalesce(
        F.nullif(F.col("_need2"), F.lit("")),
        F.nullif(F.array_join(F.slice(F.col("keywords"), 1, 3), " "), F.lit("")),
        F.lit(dims.DEFAULT_NEED),
    )
    return (
        staged.withColumn("care_need", care_need)
        .withColumn("city", city["title"])
        .withColumn("latitude", city["lat"])
        .withColumn("longitude", city["lon"])
        .withColumn("preferences", infer_preferences(ql))
        .withColumn("radius_km", clamp_radius(F.lit(float(default_radius_km))))
        .withColumn("source", F.lit(FALLBACK_SOURCE))
        .drop("_ql", "_city", "_need", "_cw", "_kw", "_inj", "_surg", "_need2")
    )


def with_status(plans: DataFrame) -> DataFrame:
    """H12: 'no_city' without a resolved point, 'no_keywords' without terms, else 'ok'."""
    return plans.withColumn(
        "status",
        F.when(F.col("city").isNull() | F.col("latitude").isNull() | F.col("longitude").isNull(), F.lit("no_city"))
        .when(F.coalesce(F.size("keywords"), F.lit(0)) == 0, F.lit("no_keywords"))
        .otherwise(F.lit("ok")),
    )


# --------------------------------------------------------------------------- planner responses
def _json_object(text: Column) -> Column:
    """The object from the first '{' to the last '}' of a text, parsed strictly; else NULL."""
    candidate = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(candidate != "", strict_json(candidate))


def parse_response(response: Column) -> Column:
    """The JSON object inside a model response (code fence / prose around it).

    NULL when there is no object, it is not valid JSON, or more than one value
    stands between the outer braces. An object in one of the shapes of a chat
    answer (`choices[0].message.content`, else `content`, `text`, `output_text`,
    the first that is not empty) stands for the object inside that text.
    """
    # A key of these names is spelled out in the text, or with an escape; else there is nothing to look for.
    enveloped = F.coalesce(response, F.lit("")).rlike(r"content|text|\\")

    def inner(outer: Column) -> Column:
        content = F.when(enveloped, F.coalesce(*(truthy_text(outer, p) for p in ("$.choices[0].message.content", "$.content", "$.text", "$.output_text"))))
        return F.get(F.transform(F.array(content), lambda c: F.when(c.isNotNull(), _json_object(c)).otherwise(outer)), 0)

    return F.get(F.transform(F.array(_json_object(response)), inner), 0)  # lambdas bind each parse once


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _list(v: Column, path: str) -> Column:
    """A list field: the items of an array, the keys of an object, the characters of a text; nothing for NULL."""
    kind = _kind(v, path)
    return (
        F.when(kind.startswith("OBJECT"), F.map_keys(F.try_variant_get(v, path, "map<string,variant>")))
        .when(kind == "STRING", F.filter(F.split(F.try_variant_get(v, path, "string"), ""), lambda c: c != ""))
        .otherwise(F.coalesce(F.try_variant_get(v, path, "array<string>"), _empty()))
    )


def _listable(v: Column, path: str) -> Column:
    """False for a number or boolean other than 0 and false: such a field makes the whole response unusable."""
    kind = _kind(v, path)
    scalar = ~(kind.startswith("ARRAY") | kind.startswith("OBJECT") | kind.isin("STRING", "VOID"))
    empty = F.try_variant_get(v, path, "string").isin("0", "0.0", "-0.0", "false")
    return ~F.coalesce(scalar & ~F.coalesce(empty, F.lit(False)), F.lit(False))


def response_radius(v: Column) -> tuple[Column, Column]:
    """Integer radius from the parsed object, and whether it is unusable (infinite).

    A JSON string must hold an integer literal; a JSON number is truncated
    toward zero; true/false count as 1/0; anything else -> NULL (default).
    """
    node = F.try_variant_get(v, "$.radius_km", "variant")
    kind = F.schema_of_variant(node)
    text = F.try_variant_get(node, "$", "string")
    as_double = F.try_variant_get(node, "$", "double")
    value = (
        F.when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("double")))
        .when(kind == "BOOLEAN", F.when(text == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT"),
              F.when(F.abs(as_double) != float("inf"), F.when(as_double < 0, F.ceil(as_double))
                     .otherwise(F.floor(as_double)).cast("double")))
    )
    infinite = F.coalesce((kind == "DOUBLE") & (F.abs(as_double) == float("inf")), F.lit(False))
    return value, infinite


def merge_plans(searches: DataFrame, responses: DataFrame, text_col: str = "query",
                default_radius_km: int = dims.RADIUS_DEFAULT_KM, match: str = "substring",
                keyword_limit: int = dims.KEYWORD_LIMIT) -> DataFrame:
    """Combine model planner responses with the rule-based plan.

    `responses(search_id, response)`; a search without a readable response
    keeps its rule-based plan (source 'keyword fallback'), and so does one with
    a list field that cannot be read as a list. A city named by the
    model wins only when the gazetteer knows it; keyword lists are merged
    (model keywords, must-haves, nice-to-haves, then rule keywords) and
    cleaned again; the model radius is clamped.
    """
    keep_last_of_repeated_keys(searches.sparkSession)
    # Of several responses to one search the first in text order counts.
    one = responses.groupBy("search_id").agg(F.min("response").alias("response"))
    r = one.select("search_id", parse_response(F.col("response")).alias("_v"))
    v = F.col("_v")
    radius, infinite = response_radius(v)
    # The join moves the searches as they came; their plans, with lists of terms, are made behind it.
    fb = fallback_plan(searches.join(r, "search_id", "left"), text_col, default_radius_km, match, keyword_limit)
    staged = (
        fb.withColumn("_given", truthy_text(v, "$.city"))
        .withColumn("_radius", radius)
        .withColumn("_usable", v.isNotNull() & ~infinite & _listable(v, "$.keywords") & _listable(v, "$.must_have")
                    & _listable(v, "$.nice_to_have") & _listable(v, "$.preferences"))
    )
    given = F.col("_given")
    staged = staged.withColumn("_known", F.get(F.filter(_gazetteer(), lambda g: g["name"] == F.lower(given)), 0))
    known = F.col("_known")
    take_given = given.isNotNull() & known.isNotNull()
    model = {
        "city": F.when(take_given, given).otherwise(F.col("city")),
        "latitude": F.when(take_given, known["lat"]).otherwise(F.col("latitude")),
        "longitude": F.when(take_given, known["lon"]).otherwise(F.col("longitude")),
        "care_need": F.coalesce(truthy_text(v, "$.care_need"), F.col("care_need")),
        "keywords": clean_terms(F.concat(_list(v, "$.keywords"), _list(v, "$.must_have"),
                                         _list(v, "$.nice_to_have"), F.col("keywords")), keyword_limit),
        "preferences": clean_terms(F.concat(_list(v, "$.preferences"), F.col("preferences")),
                                   dims.PREFERENCE_LIMIT),
        "radius_km": clamp_radius(F.coalesce(F.col("_radius"), F.lit(float(default_radius_km)))),
        "source": F.lit(MODEL_SOURCE),
    }
    usable = F.col("_usable")
    return staged.withColumns({name: F.when(usable, expr).otherwise(F.col(name)) for name, expr in model.items()}) \
        .drop("_v", "_given", "_radius", "_usable", "_known")
