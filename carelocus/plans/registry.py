"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator key.

Each query rebuilds its inputs from the driver tables, so its work grows with
them. Keys match ``carelocus.plans.oracle.ORACLE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelocus.functions.geo import haversine_km, rounded
from carelocus.operators import answers as ans
from carelocus.operators import dictionary as dic
from carelocus.operators import index as idx
from carelocus.operators import location as loc
from carelocus.operators import nearest as nn
from carelocus.operators import nearest_exact as nx
from carelocus.operators import pincode as pc
from carelocus.operators import reports
from carelocus.operators.handoff import Handoff
from carelocus.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


# ----------------------------------------------------------------- shared inputs
def lookup(spark, sf, handoff=None):
    """J1 output, materialised (as the pipeline hands it over) so that the size
    checks and both later joins read it instead of recomputing it."""
    return (handoff or Handoff(spark)).store(pc.build_pincode_lookup(fx.postal_directory(spark, sf)), "pincode_lookup")


def nearest_complete(spark, sf, lk=None):
    return nn.nearest_pin_complete(fx.facilities(spark, sf), lookup(spark, sf) if lk is None else lk)


def signals(spark, sf, handoff):
    """J1's and J2's output, materialised as the pipeline hands them over; what J2 stored on its way goes."""
    lk = lookup(spark, sf, handoff)
    with Handoff(spark) as steps:
        return lk, handoff.store(nn.nearest_pin_complete(fx.facilities(spark, sf), lk, handoff=steps), "nearest_pin")


def location(spark, sf):
    """J3 over J2's output."""
    return loc.locate_facilities(fx.facilities(spark, sf), *signals(spark, sf, Handoff(spark)))


def located(spark, sf, handoff):
    """The facilities, which J3 and J4 read in turn, and J3's output, both materialised as the pipeline hands them over;
    J1's and J2's go, as nothing reads them any more."""
    with Handoff(spark) as steps:
        lk, near = signals(spark, sf, steps)
        facilities = handoff.store(fx.facilities(spark, sf), "facilities")
        return facilities, handoff.store(loc.locate_facilities(facilities, lk, near), "facility_location")


def built_index(spark, sf, handoff=None):
    handoff = handoff or Handoff(spark)
    facilities, location = located(spark, sf, handoff)
    return idx.build_facility_index(
        facilities, fx.services(spark, sf), fx.equipment(spark, sf), fx.capabilities(spark, sf), location, handoff=handoff)


def facility_index(spark, sf, handoff=None, made=None):
    """J4 output, materialised as the pipeline hands it over: the searches deal it by ranges, which reads it twice.
    `made`: what is made of it and given instead."""
    with Handoff(spark) as steps:
        index = (handoff or Handoff(spark)).store(built_index(spark, sf, steps), "facility_index")
    return made(index) if made else index


def search_index(spark, sf):
    """J4 output as the searches store it, with the columns they read; the index that it is dealt from goes."""
    with Handoff(spark) as steps:
        return facility_index(spark, sf, steps, lambda index: sr.store_search_index(index.select(*sr.READ_COLUMNS), Handoff(spark)))


# ----------------------------------------------------------------- J1
@query("pin_normalize")
def _pin_normalize(spark, sf):
    return pc.normalize_directory(fx.postal_directory(spark, sf))


@query("pin_district_counts")
def _pin_district_counts(spark, sf):
    return pc.district_counts(pc.normalize_directory(fx.postal_directory(spark, sf))).select(
        "pincode", "district_norm", "statename_norm", "office_count_for_district")


@query("pin_ambiguity")
def _pin_ambiguity(spark, sf):
    return pc.district_ambiguity(pc.normalize_directory(fx.postal_directory(spark, sf)))


@query("pin_coords")
def _pin_coords(spark, sf):
    return pc.coordinate_means(pc.district_counts(pc.normalize_directory(fx.postal_directory(spark, sf))))


@query("pin_modal_district")
def _pin_modal(spark, sf):
    return pc.modal_district(pc.district_counts(pc.normalize_directory(fx.postal_directory(spark, sf))))


@query("pincode_lookup")
def _pincode_lookup(spark, sf):
    return lookup(spark, sf)


@query("pincode_report")
def _pincode_report(spark, sf):
    return reports.pincode_report(lookup(spark, sf))


# ----------------------------------------------------------------- J2
@query("facility_grid")
def _facility_grid(spark, sf):
    return nn.facility_points(fx.facilities(spark, sf))


@query("neighborhood_expand")
def _neighborhood_expand(spark, sf):
    return nn.neighborhood_expand(nn.pin_points(lookup(spark, sf))).select("pincode", "cell_lat", "cell_lon")


@query("grid_candidates")
def _grid_candidates(spark, sf):
    c = nn.grid_candidates(nn.facility_points(fx.facilities(spark, sf)), nn.pin_points(lookup(spark, sf)))
    return c.select("facility_id", "pincode", rounded("distance_km", 6).alias("distance_km"))


@query("haversine_pairs")
def _haversine_pairs(spark, sf):
    f = fx.facilities(spark, sf)
    pts = nn.facility_points(f).join(
        f.select(F.col("unique_id").alias("facility_id"), "address_zipOrPostcode"), "facility_id")
    pins = nn.pin_points(lookup(spark, sf))
    pairs = pts.join(pins, pts.address_zipOrPostcode == pins.pincode)
    return pairs.select(
        "facility_id", "pincode",
        F.round(haversine_km("latitude", "longitude", "pin_latitude", "pin_longitude"), 6).alias("distance_km"))


@query("nearest_pin")
def _nearest_pin(spark, sf):
    return nn.nearest_pin(fx.facilities(spark, sf), lookup(spark, sf))


@query("unmatched_facilities")
def _unmatched(spark, sf):
    return nn.unmatched_facilities(fx.facilities(spark, sf), lookup(spark, sf))


@query("nearest_pin_complete")
def _nearest_complete(spark, sf):
    return nearest_complete(spark, sf)


@query("nearest_pin_exact")
def _nearest_exact(spark, sf):
    return nx.nearest_pin_exact(fx.facilities(spark, sf), lookup(spark, sf))


@query("nearest_report")
def _nearest_report(spark, sf):
    return reports.nearest_report(nearest_complete(spark, sf))


# ----------------------------------------------------------------- J3
@query("postcode_join")
def _postcode_join(spark, sf):
    return loc.postcode_join(fx.facilities(spark, sf), lookup(spark, sf))


@query("location_confidence")
def _location_confidence(spark, sf):
    return location(spark, sf).select("facility_id", "location_confidence")


@query("facility_location")
def _facility_location(spark, sf):
    return location(spark, sf)


@query("confidence_distribution")
def _confidence_distribution(spark, sf):
    return reports.confidence_distribution(location(spark, sf))


# ----------------------------------------------------------------- J4
@query("gold_base_projection")
def _gold_base(spark, sf):
    return idx.base_projection(fx.facilities(spark, sf))


@query("facility_index")
def _facility_index(spark, sf):
    return built_index(spark, sf)


@query("index_report")
def _index_report(spark, sf):
    return reports.index_report(built_index(spark, sf))


# ----------------------------------------------------------------- J5
from carelocus.operators import plan as pl  # noqa: E402


def _joined(c: str) -> F.Column:
    """Arrays are reported as ' | '-joined text so both engines compare them as strings."""
    return F.array_join(F.col(c), " | ").alias(c)


def plans(spark, sf):
    return pl.with_status(pl.fallback_plan(fx.searches(spark, sf)))


def merged(spark, sf):
    return pl.with_status(pl.merge_plans(fx.searches(spark, sf), fx.planner_responses(spark, sf)))


def handed_over(planned):
    """J5 output for the searches, materialised as the pipeline hands it over: J6 reads it several times, and a filter
    on `status` over the lazy plans would be pushed into the planning and work its expressions out once more a use."""
    return Handoff(planned.sparkSession).store(planned.select("search_id", "status", "preferences", *sr.PLAN_KEY), "search_plans")


def _plan_view(df):
    return df.select("search_id", "city", "latitude", "longitude", "care_need", _joined("keywords"),
                     _joined("preferences"), "radius_km", "source", "status")


@query("resolve_city")
def _resolve_city(spark, sf):
    s = fx.searches(spark, sf)
    c = pl.resolve_city(F.lower("query"))
    return s.select("search_id", c["title"].alias("city"), c["lat"].alias("city_lat"), c["lon"].alias("city_lon"))


@query("resolve_care_need")
def _resolve_care_need(spark, sf):
    s = fx.searches(spark, sf)
    n = pl.resolve_care_need(F.lower("query"))
    return s.select("search_id", n["need"].alias("care_need"),
                    F.array_join(n["keywords"], " | ").alias("mapped_keywords"))


@query("query_tokens")
def _query_tokens(spark, sf):
    s = fx.searches(spark, sf)
    return s.select("search_id", F.array_join(pl.query_tokens(F.lower("query")), " | ").alias("tokens"))


@query("clean_terms")
def _clean_terms(spark, sf):
    from carelocus.functions.text import clean_terms
    s = fx.searches(spark, sf)
    n = pl.resolve_care_need(F.lower("query"))
    kws = clean_terms(F.concat(F.coalesce(n["keywords"], F.array().cast("array<string>")),
                               pl.query_tokens(F.lower("query"))))
    return s.select("search_id", F.array_join(kws, " | ").alias("keywords"))


@query("infer_intent")
def _infer_intent(spark, sf):
    return plans(spark, sf).select("search_id", "care_need", _joined("keywords"))


@query("search_preferences")
def _search_preferences(spark, sf):
    return plans(spark, sf).select("search_id", _joined("preferences"))


@query("search_plan")
def _search_plan(spark, sf):
    return _plan_view(plans(spark, sf))


@query("search_status")
def _search_status(spark, sf):
    return plans(spark, sf).select("search_id", "status")


@query("plan_response_parse")
def _plan_response_parse(spark, sf):
    tx.keep_last_of_repeated_keys(spark)
    r = fx.planner_responses(spark, sf)
    v = pl.parse_response(F.col("response"))
    radius, infinite = pl.response_radius(v)
    return r.select(
        "search_id",
        v.isNotNull().alias("readable"),
        F.try_variant_get(v, "$.city", "string").alias("city"),
        F.try_variant_get(v, "$.care_need", "string").alias("care_need"),
        F.array_join(F.try_variant_get(v, "$.keywords", "array<string>"), " | ").alias("keywords"),
        radius.cast("bigint").alias("radius_value"),
    )


@query("merge_plans")
def _merge_plans(spark, sf):
    return _plan_view(merged(spark, sf))


# ----------------------------------------------------------------- J6
from carelocus.functions import evidence as ev  # noqa: E402
from carelocus.functions import text as tx  # noqa: E402
from carelocus.operators import search as sr  # noqa: E402


def _dplans(spark, sf):
    return Handoff(spark).store(sr.distinct_plans(handed_over(plans(spark, sf))), "plans")


def searched(spark, sf, planned):
    """The plans and the index of the searches. The index is stored first: its shuffle is the largest, the plans wait for it."""
    index = search_index(spark, sf)
    return handed_over(planned(spark, sf)), index


@query("search_bbox")
def _search_bbox(spark, sf):
    b = sr.plan_boxes(_dplans(spark, sf))
    return b.select("plan_id", *[F.round(c, 6).alias(c) for c in ["min_lat", "max_lat", "min_lon", "max_lon"]])


@query("facility_text")
def _facility_text(spark, sf):
    i = built_index(spark, sf)
    return i.select("unique_id", sr.facility_text(i).alias("search_text"))


@query("search_candidates")
def _search_candidates(spark, sf):
    return sr.search_candidates(_dplans(spark, sf), search_index(spark, sf)).select("plan_id", "unique_id")


@query("search_within_radius")
def _search_within_radius(spark, sf):
    w = sr.within_radius(sr.search_candidates(_dplans(spark, sf), search_index(spark, sf)))
    return w.select("plan_id", "unique_id", F.round("distance_km", 6).alias("distance_km"))


@query("relevance_score")
def _relevance_score(spark, sf):
    w = sr.within_radius(sr.search_candidates(_dplans(spark, sf), search_index(spark, sf)))
    return w.select("plan_id", "unique_id", "orthopedic", "relevance_score")


@query("search_top5")
def _search_top5(spark, sf):
    t = sr.search_top(*searched(spark, sf, plans))
    return t.select("search_id", "rank", "unique_id", "relevance_score", F.round("distance_km", 6).alias("distance_km"))


@query("search_counts")
def _search_counts(spark, sf):
    return sr.search_counts(*searched(spark, sf, plans))


@query("search_evidence")
def _search_evidence(spark, sf):
    r = sr.run_searches(*searched(spark, sf, plans))
    return sr.evidence(sr.winner_rows(r["winners"], r["plans"], r["store"])).select("plan_id", "rank", "unique_id", _joined("evidence"))


@query("result_cards")
def _result_cards(spark, sf):
    c = sr.result_cards(*searched(spark, sf, plans))
    return c.select(*[_joined(x) if x == "evidence" else x for x in c.columns])


@query("search_top5_merged")
def _search_top5_merged(spark, sf):
    t = sr.search_top(*searched(spark, sf, merged))
    return t.select("search_id", "rank", "unique_id", "relevance_score", F.round("distance_km", 6).alias("distance_km"))


@query("search_counts_merged")
def _search_counts_merged(spark, sf):
    return sr.search_counts(*searched(spark, sf, merged))


@query("result_cards_merged")
def _result_cards_merged(spark, sf):
    c = sr.result_cards(*searched(spark, sf, merged))
    return c.select(*[_joined(x) if x == "evidence" else x for x in c.columns])


@query("has_value_flags")
def _has_value_flags(spark, sf):
    f = fx.facilities(spark, sf)
    cols = ["numberDoctors", "capacity", "officialPhone", "phone_numbers", "email", "organization_type"]
    return f.select("unique_id", *[tx.has_value(c).alias(f"has_{c}") for c in cols])


@query("contact_pick")
def _contact_pick(spark, sf):
    return fx.facilities(spark, sf).select("unique_id", sr.contact().alias("contact"),
                                           sr.strength_label().alias("strength"))


@query("clean_phone")
def _clean_phone(spark, sf):
    f = fx.facilities(spark, sf)
    return f.select("unique_id", *[tx.clean_phone(c).alias(c) for c in ["officialPhone", "phone_numbers", "email"]])


@query("clean_evidence")
def _clean_evidence(spark, sf):
    i = built_index(spark, sf)
    return i.select("unique_id", *[tx.clean_evidence_text(c).alias(c) for c in sr.EVIDENCE_COLUMNS])


@query("evidence_shapes")
def _evidence_shapes(spark, sf):
    rows = ev.with_evidence_items(fx.evidence_shapes(spark, sf), "value", "items")
    return rows.select("k", F.array_join("items", " | ").alias("items"))


@query("evidence_items")
def _evidence_items(spark, sf):
    cols = ["specialties", "standardized_services", "parsed_capability", "standardized_equipment"]
    i = ev.with_evidence_items_many(built_index(spark, sf).select("unique_id", *cols),
                                    {c: f"items_{c}" for c in cols})
    return i.select("unique_id", *[F.array_join(f"items_{c}", " | ").alias(c) for c in cols])


# ----------------------------------------------------------------- S1-S6
from carelocus.operators import enrich as en  # noqa: E402


@query("enrichment_requests")
def _enrichment_requests(spark, sf):
    return en.enrichment_requests(fx.raw_terms(spark, sf))


@query("enrichment_apply")
def _enrichment_apply(spark, sf):
    req = en.enrichment_requests(fx.raw_terms(spark, sf))
    return en.apply_model(req, en.echo_model).select("unique_id", "kind", "response")


@query("enrichment_store")
def _enrichment_store(spark, sf):
    """Two runs over one answer store: what the first has answered the second does not ask again."""
    store = ans.AnswerStore(spark, Handoff(spark).root + "/answers")
    raw = fx.raw_terms(spark, sf)
    store.ask(ans.raw_requests(raw, kinds=["services"]), en.echo_model, "1")
    store.ask(ans.raw_requests(raw), lambda prompts: "again " + en.echo_model(prompts), "2")
    return store.attach(ans.raw_requests(raw)).select("unique_id", "kind", "response")


@query("standardize_specialties")
def _standardize_specialties(spark, sf):
    return en.standardize_specialties(fx.raw_terms(spark, sf))


@query("standardize_services")
def _standardize_services(spark, sf):
    return en.standardize_services(fx.raw_terms(spark, sf))


@query("standardize_equipment")
def _standardize_equipment(spark, sf):
    return en.standardize_equipment(fx.raw_terms(spark, sf))


@query("standardize_dictionary")
def _standardize_dictionary(spark, sf):
    return dic.standardize_terms(fx.part_terms(spark, sf), fx.part_dictionary(spark, sf), "part", "terms", "names", unknown=F.upper)


@query("enriched_index")
def _enriched_index(spark, sf):
    handoff = Handoff(spark)
    facilities, location = located(spark, sf, handoff)
    return idx.build_enriched_index(facilities, fx.raw_terms(spark, sf), location, handoff)


@query("capability_explode")
def _capability_explode(spark, sf):
    return en.capability_explode(fx.raw_terms(spark, sf))
