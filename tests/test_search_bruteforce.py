"""J6 against a brute force over every (plan, facility) pair, on a skewed fixture:
a third of the facilities share one point (one hot grid cell) and a third of the
searches share one text (one hot plan)."""

import math

from pyspark.sql import functions as F

from carelocus.operators import plan as pl
from carelocus.operators import search as sr
from carelocus.plans.registry import facility_index
from carelocus.sources import dims
from carelocus.sources import fixtures as fx

from conftest import SF01

HOT_POINT = (28.65, 77.25)


def km(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def present(v):
    return v is not None and str(v).strip() != "" and str(v).strip().lower() not in dims.MISSING_MARKERS


def score(row, need, keywords):
    text = " ".join((row[f] or "").lower() for f in dims.SEARCH_TEXT_FIELDS)
    intent = " ".join([need or ""] + keywords).lower()
    if any(t in intent for t in dims.ORTHOPEDIC_INTENT_TERMS):
        s = sum(p for terms, p in dims.ORTHOPEDIC_SCORE_RULES if any(t in text for t in terms))
        if any(t in text for t in dims.DENTAL_TERMS) and s < 8:
            s -= dims.DENTAL_PENALTY
        ortho = True
    else:
        s, ortho = sum(1 for k in keywords if k.lower() in text), False
    return s + present(row["numberDoctors"]) + present(row["capacity"]), ortho


def brute_top(plan, rows):
    lat, lon, r = plan["latitude"], plan["longitude"], plan["radius_km"]
    dlat, dlon = r / 111.0, r / max(111.0 * math.cos(math.radians(lat)), 1)
    out = []
    for f in rows:
        fl, fo = f["facility_latitude"], f["facility_longitude"]
        if fl is None or fo is None:
            continue
        if not (round(lat - dlat, 6) <= fl <= round(lat + dlat, 6) and round(lon - dlon, 6) <= fo <= round(lon + dlon, 6)):
            continue
        fields = [(f[c] or "").lower() for c in ("specialties", "standardized_services", "parsed_capability", "description")]
        if not any(k in x for k in plan["keywords"] for x in fields):
            continue
        d = km(lat, lon, fl, fo)
        if d > r:
            continue
        s, ortho = score(f, plan["care_need"], plan["keywords"])
        if ortho and s < dims.ORTHOPEDIC_MIN_SCORE:
            continue
        out.append((-s, d, f["unique_id"]))
    return [u for _, _, u in sorted(out)[: dims.TOP_K]]


def test_search_top_equals_brute_force_under_skew(spark):
    index = facility_index(spark, SF01)
    k = F.regexp_extract("unique_id", "[0-9]+", 0).cast("int")
    hot = k % 3 == 0
    index = (index.withColumn("facility_latitude", F.when(hot, F.lit(HOT_POINT[0])).otherwise(F.col("facility_latitude")))
             .withColumn("facility_longitude", F.when(hot, F.lit(HOT_POINT[1])).otherwise(F.col("facility_longitude"))))
    searches = fx.searches(spark, SF01).withColumn(
        "query", F.when(F.col("search_id") % 3 == 0, F.lit("dialysis near Delhi")).otherwise(F.col("query")))
    plans = pl.with_status(pl.fallback_plan(searches)).cache()
    got = {}
    for r in sr.search_top(plans, index).select("search_id", "rank", "unique_id").collect():
        got.setdefault(r["search_id"], []).append((r["rank"], r["unique_id"]))
    rows = [r.asDict() for r in index.collect()]
    cache = {}
    checked = 0
    for p in plans.filter("status = 'ok'").collect():
        key = (p["latitude"], p["longitude"], p["radius_km"], p["care_need"], tuple(p["keywords"]))
        if key not in cache:
            cache[key] = brute_top(p.asDict(), rows)
        want = cache[key]
        assert [u for _, u in sorted(got.get(p["search_id"], []))] == want, p["query"]
        checked += 1
    assert checked > 3000 and len(cache) > 10
