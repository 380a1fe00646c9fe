"""J6 — run a whole table of search plans against the facility index.

Plan of the job:

1. The index is stored once for searching (``store_search_index``): rows with coordinates, a row key (facility ids may
   repeat), the grid cell, the texts that searches scan, and the card columns, clustered along a space-filling curve,
   so that files and row groups cover small areas. A stored index can be kept and passed to any number of runs.
2. Searches that share a plan (point, radius, care need, keywords) are run once: ``distinct_plans`` keeps one row per
   plan with ``plan_id`` = the smallest search_id of the group (partial aggregation, so a plan used by a third of all
   searches is combined map-side).
3. Two-level proximity join: plans that share point and radius share a box. Boxes alone, numbers without texts, are
   exploded into coarse grid cells and meet the facilities of those cells; box test and distance are worked out once a
   (box, facility) pair. Only pairs within the box meet the plans of the box, with keyword test and score.
4. Top-k per plan with ``row_number`` over six narrow columns (Catalyst plans a partial WindowGroupLimit before the
   shuffle, so a hot plan is cut to k rows per map partition). The winners alone then fetch their index rows by row
   key. Counts per plan are a partial aggregate.
5. Results are joined back to every search of the plan.

Boxes, distinct plans and winners are stored as Parquet between the steps (``Handoff``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelocus.functions.evidence import with_evidence
from carelocus.functions.geo import box_half_widths, grid_cell, haversine_km
from carelocus.functions.text import clean_phone, clean_terms, contains_any, has_value
from carelocus.operators.handoff import Handoff
from carelocus.operators.sizing import broadcast_below, broadcast_if_small
from carelocus.sources import dims

SEARCH_CELL_DEGREES = 0.5
BOX_KEY = ["latitude", "longitude", "radius_km"]
PLAN_KEY = [*BOX_KEY, "care_need", "keywords"]
EVIDENCE_COLUMNS = ["specialties", "standardized_services", "parsed_capability", "description"]
#: What searches and cards read of the index; an index that is stored for them alone needs no more.
READ_COLUMNS = [*dict.fromkeys([
    "unique_id", "facility_latitude", "facility_longitude", *dims.SEARCH_TEXT_FIELDS, *EVIDENCE_COLUMNS, "standardized_equipment",
    "numberDoctors", "capacity", "district", "state", "address_city", "address_stateOrRegion", "location_confidence",
    "officialPhone", "phone_numbers", "email",
])]


def facility_text(index: DataFrame) -> Column:
    """The lower-cased, blank-joined text scanned for relevance (once per facility)."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in dims.SEARCH_TEXT_FIELDS]))


@dataclass(frozen=True)
class MatchOptions:
    """How keywords meet the index text. Defaults match the reference exactly.

    humanize_specialties   match 'critical care' in 'criticalCareMedicine' (D20)
    strip_service_category do not let 'surgery' hit every 'Name|Surgery' service (D21)
    search_equipment       also search the standardized equipment column (D24)
    keyword_limit          keywords of a plan that are searched for (D19)
    """
    humanize_specialties: bool = False
    strip_service_category: bool = False
    search_equipment: bool = False
    keyword_limit: int = dims.KEYWORD_LIMIT


DEFAULT_MATCH = MatchOptions()


def _match_fields(opts: MatchOptions) -> dict[str, Column]:
    spec = F.col("specialties")
    if opts.humanize_specialties:
        spec = F.regexp_replace(spec, "([a-z])(?=[A-Z])", "$1 ")
    svc = F.lower("standardized_services")
    if opts.strip_service_category:
        svc = F.regexp_replace(svc, r"\|[^\"|]*", "")
    fields = {"specialties_lc": F.lower(spec), "standardized_services_lc": svc,
              "parsed_capability_lc": F.lower("parsed_capability"), "description_lc": F.lower("description")}
    if opts.search_equipment:
        fields["standardized_equipment_lc"] = F.lower("standardized_equipment")
    return fields


# Joins the lower-cased match fields; cannot occur in a cleaned search term, so a
# term found in the joined text was found inside one field (same as OR over fields).
FIELD_SEPARATOR = "\u0001"


#: Row key of a stored search index: rows in the order of the curve, then of the facility id.
FACILITY_KEY = "facility_key"
CURVE_BITS = 16
NARROW_COLUMNS = [FACILITY_KEY, "unique_id", "facility_latitude", "facility_longitude", "cell_lat", "cell_lon",
                  "match_text", "search_text", "has_doctors", "has_capacity"]


def search_index(index: DataFrame, cell_degrees: float = SEARCH_CELL_DEGREES,
                 opts: MatchOptions = DEFAULT_MATCH) -> DataFrame:
    """Index rows usable for search with their cell, match text and relevance text
    (all computed once per facility, not per candidate pair)."""
    fields = [F.coalesce(e, F.lit("")) for e in _match_fields(opts).values()]
    return (
        index.filter(F.col("facility_latitude").isNotNull() & F.col("facility_longitude").isNotNull())
        .withColumn("cell_lat", grid_cell("facility_latitude", cell_degrees))
        .withColumn("cell_lon", grid_cell("facility_longitude", cell_degrees))
        .withColumn("search_text", facility_text(index))
        .withColumn("match_text", F.concat_ws(FIELD_SEPARATOR, *fields))
        .withColumn("has_doctors", has_value("numberDoctors"))
        .withColumn("has_capacity", has_value("capacity"))
    )


def curve_place(lat: str, lon: str) -> Column:
    """Place of a point on a Z-order curve over the globe: the bits of both axes, one from each in turn."""
    def spread(c: str, span: float) -> Column:
        bits = F.floor((F.col(c) + span / 2) / span * (1 << CURVE_BITS)).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask))
        return bits

    return F.shiftleft(spread(lat, 180.5), 1).bitwiseOR(spread(lon, 360.5))


def store_search_index(index: DataFrame, handoff: Handoff, cell_degrees: float = SEARCH_CELL_DEGREES,
                       opts: MatchOptions = DEFAULT_MATCH) -> DataFrame:
    """The search index as a table clustered by place, with a row key in that order.

    Rows are dealt by ranges of the curve and sorted inside them, so every file and row group covers a small area and
    the bounds of a run's boxes leave the others unread. Ties on the curve go by facility id and by all columns, so
    the order of keys does not depend on how the index was read.
    """
    rows = index.filter(F.col("facility_latitude").isNotNull() & F.col("facility_longitude").isNotNull())
    rows = rows.withColumn("_curve", curve_place("facility_latitude", "facility_longitude"))
    order = ["_curve", "unique_id", "_row"]
    rows = rows.withColumn("_row", F.xxhash64(*index.columns)).repartitionByRange(*order).sortWithinPartitions(*order)
    # The texts that searches scan repeat columns of the row: they are made behind the shuffle.
    rows = search_index(rows.drop("_curve", "_row"), cell_degrees, opts)
    return handoff.store(rows.withColumn(FACILITY_KEY, F.monotonically_increasing_id()), "search_index")


def count_found(text: Column, terms: Column, lower_terms: bool = False) -> Column:
    """Number of terms that occur in `text`.

    The first KEYWORD_LIMIT positions are unrolled (get(terms, i) is NULL past
    the end), which keeps the per-pair test inside whole-stage codegen; a
    lambda covers any longer list.
    """
    def term(c: Column) -> Column:
        return F.lower(c) if lower_terms else c

    total = F.lit(0)
    for i in range(dims.KEYWORD_LIMIT):
        total = total + F.when(text.contains(term(F.get(terms, i))), F.lit(1)).otherwise(F.lit(0))
    rest = F.slice(terms, F.lit(dims.KEYWORD_LIMIT + 1), F.greatest(F.size(terms), F.lit(1)))
    extra = F.when(F.size(terms) > dims.KEYWORD_LIMIT,
                   F.size(F.filter(rest, lambda k: text.contains(term(k))))).otherwise(F.lit(0))
    return total + extra


def orthopedic_intent(care_need: Column, keywords: Column) -> Column:
    """I4: orthopedic intent on the blank-joined need + keywords text."""
    text = F.lower(F.concat_ws(" ", F.coalesce(care_need, F.lit("")), keywords))
    return contains_any(text, dims.ORTHOPEDIC_INTENT_TERMS)


def distinct_plans(plans: DataFrame, keyword_limit: int = dims.KEYWORD_LIMIT) -> DataFrame:
    """One row per runnable plan; plan_id = smallest search_id using it."""
    ok = plans.filter(F.col("status") == "ok")
    return (
        ok.groupBy(*PLAN_KEY).agg(F.min("search_id").alias("plan_id"))
        .withColumn("search_terms", clean_terms(F.col("keywords"), keyword_limit))
        .withColumn("orthopedic", orthopedic_intent(F.col("care_need"), F.col("keywords")))
    )


BOX_DECIMALS = 6  # bounds are applied at 6 decimals, as rendered into the candidate predicate


def plan_boxes(dplans: DataFrame) -> DataFrame:
    """Box bounds of every plan."""
    dlat, dlon = box_half_widths(F.col("latitude"), F.col("radius_km"), dims.KM_PER_DEGREE)
    lat, lon = F.col("latitude"), F.col("longitude")
    return dplans.select(
        "*",
        F.round(lat - dlat, BOX_DECIMALS).alias("min_lat"), F.round(lat + dlat, BOX_DECIMALS).alias("max_lat"),
        F.round(lon - dlon, BOX_DECIMALS).alias("min_lon"), F.round(lon + dlon, BOX_DECIMALS).alias("max_lon"),
    )


def distinct_boxes(dplans: DataFrame) -> DataFrame:
    """One row per point and radius with its box; box_id = smallest plan_id of the box."""
    return plan_boxes(dplans.groupBy(*BOX_KEY).agg(F.min("plan_id").alias("box_id")))


def _cell_ranges(cell_degrees: float) -> dict[str, tuple[Column, Column]]:
    return {c: (grid_cell(f"min_{c}", cell_degrees), grid_cell(f"max_{c}", cell_degrees)) for c in ("lat", "lon")}


def box_cells(boxes: DataFrame, cell_degrees: float = SEARCH_CELL_DEGREES) -> DataFrame:
    """Every grid cell a box touches (sequence of rows x columns)."""
    for axis, (first, last) in _cell_ranges(cell_degrees).items():
        boxes = boxes.withColumn(f"cell_{axis}", F.explode(F.sequence(first, last)))
    return boxes


def box_facts(boxes: DataFrame, cell_degrees: float = SEARCH_CELL_DEGREES) -> dict:
    """One row about stored boxes: the number of cells they will explode into, and the bounds of all of them."""
    lat, lon = _cell_ranges(cell_degrees).values()
    return boxes.agg(
        F.coalesce(F.sum((lat[1] - lat[0] + 1) * (lon[1] - lon[0] + 1)), F.lit(0)).alias("cells"),
        *(F.min(c).alias(c) for c in ("min_lat", "min_lon")), *(F.max(c).alias(c) for c in ("max_lat", "max_lon")),
    ).first().asDict()


def _keyword_hit(terms: Column) -> Column:
    """Any term in any of the evidence fields (LIKE '%term%' on lower-cased text)."""
    return count_found(F.col("match_text"), terms) > 0


def box_candidates(boxes: DataFrame, store: DataFrame, cell_degrees: float = SEARCH_CELL_DEGREES,
                   check_broadcast: bool = True) -> DataFrame:
    """(box, facility) pairs inside the box with their distance; candidate work grows with boxes, not with plans.

    The bounds of all boxes are literals of the index scan, so row groups outside are not read. The cells are numbers
    only; they are counted before they are made, and broadcast under the byte bound, so that the index is scanned once
    and never shuffled for this join; beyond it this is a shuffle join on the cell.
    """
    cells = box_cells(boxes, cell_degrees)
    facilities = store.select(*NARROW_COLUMNS)
    if check_broadcast:
        facts = box_facts(boxes, cell_degrees)
        cells = broadcast_below(cells, facts["cells"] * 8 * (len(cells.columns) + 2))
        if facts["cells"]:
            facilities = facilities.filter(
                F.col("facility_latitude").between(facts["min_lat"], facts["max_lat"])
                & F.col("facility_longitude").between(facts["min_lon"], facts["max_lon"]))
    inside = (F.col("facility_latitude").between(F.col("min_lat"), F.col("max_lat"))
              & F.col("facility_longitude").between(F.col("min_lon"), F.col("max_lon")))
    distance = haversine_km("latitude", "longitude", "facility_latitude", "facility_longitude")
    pairs = cells.join(facilities, ["cell_lat", "cell_lon"]).filter(inside).withColumn("distance_km", distance)
    return pairs.select("box_id", "radius_km", "distance_km", FACILITY_KEY, "unique_id", "match_text", "search_text",
                        "has_doctors", "has_capacity")


def search_candidates(dplans: DataFrame, index: DataFrame, cell_degrees: float = SEARCH_CELL_DEGREES,
                      check_broadcast: bool = True, opts: MatchOptions = DEFAULT_MATCH,
                      handoff: Handoff | None = None) -> DataFrame:
    """(plan, facility) pairs inside the plan's box whose fields mention a term.

    `index` is the facility index or one stored by ``store_search_index`` (then `opts` are those it was stored with).
    """
    handoff = handoff or Handoff(dplans.sparkSession)
    store = index if FACILITY_KEY in index.columns else store_search_index(index, handoff, cell_degrees, opts)
    boxes = handoff.store(distinct_boxes(dplans), "boxes")
    in_box = box_candidates(boxes, store, cell_degrees, check_broadcast)
    of_box = dplans.join(boxes.select("box_id", *BOX_KEY), BOX_KEY).select(
        "plan_id", "box_id", "care_need", "keywords", "search_terms", "orthopedic")
    if check_broadcast:
        of_box = broadcast_if_small(of_box)
    return in_box.join(of_box, "box_id").filter(_keyword_hit(F.col("search_terms")))


def relevance_score(text: Column, keywords: Column, orthopedic: Column) -> Column:
    """Orthopedic weights (dental penalty below 8) or one point per keyword found."""
    ortho = F.lit(0)
    for terms, points in dims.ORTHOPEDIC_SCORE_RULES:
        ortho = ortho + F.when(contains_any(text, terms), F.lit(points)).otherwise(F.lit(0))
    ortho = F.when(contains_any(text, dims.DENTAL_TERMS) & (ortho < 8), ortho - dims.DENTAL_PENALTY).otherwise(ortho)
    per_keyword = count_found(text, keywords, lower_terms=True)
    return (F.when(orthopedic, ortho).otherwise(per_keyword)
            + F.col("has_doctors").cast("int") + F.col("has_capacity").cast("int"))


def within_radius(candidates: DataFrame) -> DataFrame:
    """Exact distance filter (below the join with the plans, as it needs the box alone) and relevance score."""
    return candidates.filter(F.col("distance_km") <= F.col("radius_km")).withColumn(
        "relevance_score", relevance_score(F.col("search_text"), F.col("keywords"), F.col("orthopedic")))


def apply_threshold(scored: DataFrame) -> DataFrame:
    """Orthopedic searches keep only results scoring at least 4."""
    return scored.filter(~F.col("orthopedic") | (F.col("relevance_score") >= dims.ORTHOPEDIC_MIN_SCORE))


def rank_results(ranked: DataFrame, k: int = dims.TOP_K) -> DataFrame:
    """best k per plan by score desc, distance asc, facility id asc, then row key (ids may repeat).

    Only what the order needs goes through the window; the winners' index rows are joined later by row key.
    """
    w = Window.partitionBy("plan_id").orderBy(
        F.col("relevance_score").desc(), F.col("distance_km").asc(), F.col("unique_id").asc(), F.col(FACILITY_KEY).asc())
    narrow = ranked.select("plan_id", FACILITY_KEY, "unique_id", "relevance_score", "distance_km")
    return narrow.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def winner_rows(top: DataFrame, dplans: DataFrame, store: DataFrame) -> DataFrame:
    """The top rows with their plan's keywords and their index row.

    `top` is stored: the range of its row keys is a literal of the index scan, and the scan is joined by row key with
    the winners broadcast under the byte bound, else by a shuffle on the key.
    """
    bounds = top.agg(F.min(FACILITY_KEY), F.max(FACILITY_KEY)).first()
    rows = store.drop("unique_id", "search_text", "match_text", "cell_lat", "cell_lon")
    if bounds[0] is not None:
        rows = rows.filter(F.col(FACILITY_KEY).between(*bounds))
    planned = top.join(dplans.select("plan_id", "keywords", "orthopedic"), "plan_id")
    return rows.join(broadcast_if_small(planned), FACILITY_KEY)


def attach_plan_ids(plans: DataFrame, dplans: DataFrame) -> DataFrame:
    """Searches (status ok) with the plan_id of their plan.

    `dplans` is stored: it is measured and broadcast under the byte bound,
    so a plan shared by a third of all searches causes no skewed shuffle; with
    very many distinct plans this is a sort-merge join with AQE skew splitting.
    """
    ok = plans.filter(F.col("status") == "ok").select("search_id", "preferences", *PLAN_KEY)
    keyed = broadcast_if_small(dplans.select("plan_id", *PLAN_KEY))
    return ok.join(keyed, PLAN_KEY)


def scored_candidates(plans: DataFrame, index: DataFrame, cell_degrees: float = SEARCH_CELL_DEGREES,
                      opts: MatchOptions = DEFAULT_MATCH, handoff: Handoff | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct plans (stored) and every candidate in radius with its score."""
    handoff = handoff or Handoff(plans.sparkSession)
    dplans = handoff.store(distinct_plans(plans, opts.keyword_limit), "plans")
    found = search_candidates(dplans, index, cell_degrees, opts=opts, handoff=handoff)
    return dplans, apply_threshold(within_radius(found))


def run_searches(plans: DataFrame, index: DataFrame, k: int = dims.TOP_K,
                 cell_degrees: float = SEARCH_CELL_DEGREES, opts: MatchOptions = DEFAULT_MATCH,
                 handoff: Handoff | None = None) -> dict[str, DataFrame]:
    """Per-plan results and their mapping back to searches.

    Returns ``{"plans": distinct plans, "searches": search->plan, "ranked": all candidates in radius (scored),
    "winners": plan_id, rank, row key, id, score and distance of the top k per plan (stored), "store": the index they
    are keyed in}``. `index` may be one stored by ``store_search_index``. The caller drops `handoff` once what it made
    of the result is written.
    """
    handoff = handoff or Handoff(plans.sparkSession)
    store = index if FACILITY_KEY in index.columns else store_search_index(index, handoff, cell_degrees, opts)
    dplans, ranked = scored_candidates(plans, store, cell_degrees, opts, handoff)
    return {
        "plans": dplans,
        "searches": attach_plan_ids(plans, dplans),
        "ranked": ranked,
        "winners": handoff.store(rank_results(ranked, k), "winners"),
        "store": store,
    }


def search_top(plans: DataFrame, index: DataFrame, k: int = dims.TOP_K, opts: MatchOptions = DEFAULT_MATCH,
               handoff: Handoff | None = None) -> DataFrame:
    """Top-k results of every search: search_id, plan_id, rank, row key and id of the facility, score, distance."""
    r = run_searches(plans, index, k, opts=opts, handoff=handoff)
    return r["searches"].select("search_id", "plan_id").join(broadcast_if_small(r["winners"]), "plan_id")


def search_counts(plans: DataFrame, index: DataFrame, k: int = dims.TOP_K, opts: MatchOptions = DEFAULT_MATCH,
                  handoff: Handoff | None = None) -> DataFrame:
    """per search (every status): results found and results shown (<= k)."""
    dplans, found = scored_candidates(plans, index, opts=opts, handoff=handoff)
    counts = found.groupBy("plan_id").agg(F.count(F.lit(1)).alias("result_count"))
    per_search = attach_plan_ids(plans, dplans).select("search_id", "plan_id").join(counts, "plan_id", "left")
    return (
        plans.select("search_id", "status").join(per_search.select("search_id", "result_count"), "search_id", "left")
        .select("search_id", "status",
                F.coalesce("result_count", F.lit(0)).cast("bigint").alias("result_count"),
                F.least(F.coalesce("result_count", F.lit(0)), F.lit(k)).cast("bigint").alias("shown_count"))
    )


# --------------------------------------------------------------------------- result cards
def _display_place() -> Column:
    """(district or city), (state or region), '' counting as missing."""
    parts = F.array(
        F.coalesce(F.nullif(F.col("district"), F.lit("")), F.nullif(F.col("address_city"), F.lit(""))),
        F.coalesce(F.nullif(F.col("state"), F.lit("")), F.nullif(F.col("address_stateOrRegion"), F.lit(""))),
    )
    joined = F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", ")
    return F.when(joined == "", F.lit("Location on file")).otherwise(joined)


def strength_label() -> Column:
    """B17: '<n> doctors, capacity <m>' from the meaningful values present."""
    return F.concat_ws(", ",
                       F.when(has_value("numberDoctors"), F.concat(F.col("numberDoctors"), F.lit(" doctors"))),
                       F.when(has_value("capacity"), F.concat(F.lit("capacity "), F.col("capacity"))))


def contact() -> Column:
    """First meaningful of office phone, phones, e-mail, cleaned."""
    first = F.coalesce(*[F.when(has_value(c), F.col(c)) for c in ["officialPhone", "phone_numbers", "email"]])
    return F.when(first.isNotNull(), clean_phone(first))


def confidence_label() -> Column:
    """Display label of the confidence class ('unknown' for anything else)."""
    out = F.lit(dims.UNKNOWN_CONFIDENCE_LABEL)
    for level, label in reversed(dims.CONFIDENCE_LABELS):
        out = F.when(F.col("location_confidence") == level, F.lit(label)).otherwise(out)
    return out


def wants_strength(preferences: Column) -> Column:
    """A preference mentioning size, capacity, doctors or equipment."""
    text = F.lower(F.concat_ws(" ", F.coalesce(preferences, F.array().cast("array<string>"))))
    return contains_any(text, dims.STRENGTH_WISH_TERMS)


def evidence(top: DataFrame) -> DataFrame:
    """Evidence snippets of the top results (keywords per plan, orthopedic list if intent)."""
    ev_keywords = F.when(F.col("orthopedic"), F.array(*[F.lit(x) for x in dims.ORTHOPEDIC_EVIDENCE_KEYWORDS])) \
        .otherwise(F.col("keywords"))
    return with_evidence(top, ev_keywords)


def result_cards(plans: DataFrame, index: DataFrame, k: int = dims.TOP_K, opts: MatchOptions = DEFAULT_MATCH,
                 handoff: Handoff | None = None) -> DataFrame:
    """One display row per (search, rank). Cards are made once a winner and joined back to the searches."""
    handoff = handoff or Handoff(plans.sparkSession)
    r = run_searches(plans, index, k, opts=opts, handoff=handoff)
    top = evidence(winner_rows(r["winners"], r["plans"], r["store"])).select(
        "plan_id", "rank", "unique_id",
        F.coalesce("name", F.lit("")).alias("name"),
        F.concat_ws(" · ", F.coalesce(F.nullif(F.col("organization_type"), F.lit("")), F.lit("Healthcare Facility")),
                    F.when(has_value("numberDoctors"), F.concat(F.col("numberDoctors"), F.lit(" doctors"))),
                    F.when(has_value("capacity"), F.concat(F.lit("capacity "), F.col("capacity")))).alias("meta"),
        _display_place().alias("place"),
        F.round("distance_km", 1).alias("distance_km"),
        confidence_label().alias("confidence_label"),
        strength_label().alias("strength"),
        contact().alias("contact"),
        F.transform("evidence", lambda e: F.substring(e, 1, dims.EVIDENCE_DISPLAY_CHARS)).alias("evidence"),
        "relevance_score",
    )
    made = broadcast_if_small(handoff.store(top, "cards"))
    cards = r["searches"].select("search_id", "plan_id", "preferences").join(made, "plan_id")
    return cards.select(
        "search_id", "rank", "unique_id", "name", "meta", "place", "distance_km", "confidence_label",
        F.when(wants_strength(F.col("preferences")) & (F.col("strength") != ""),
               F.concat(F.lit("larger facility signal: "), F.col("strength"))).alias("strength_badge"),
        "contact", "evidence", "relevance_score",
    )
