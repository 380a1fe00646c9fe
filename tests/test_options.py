"""Optional fixes of SURVEY section 1.5 (defaults keep the reference behaviour)."""

from pyspark.sql import functions as F

from carelocus.operators import index as idx
from carelocus.operators import pincode as pc
from carelocus.operators import plan as pl
from carelocus.operators import search as sr


def test_paired_only_means(spark):
    d = spark.createDataFrame([("1", "A", "S", "10.0", "NA"), ("1", "A", "S", "20.0", "30.0")],
                              "pincode string, district string, statename string, latitude string, longitude string")
    default = pc.build_pincode_lookup(d).first()
    paired = pc.build_pincode_lookup(d, paired_only=True).first()
    assert (default.latitude, default.longitude) == (15.0, 30.0)
    assert (paired.latitude, paired.longitude) == (20.0, 30.0)


def test_word_matching(spark):
    s = spark.createDataFrame([(1, "dialysis near visakhapatnam"), (2, "eye care in chandigarh")],
                              "search_id long, query string")
    sub = {r.search_id: r for r in pl.fallback_plan(s).collect()}
    word = {r.search_id: r for r in pl.fallback_plan(s, match="word").collect()}
    assert sub[1].city == "Patna" and word[1].city == "Visakhapatnam"
    assert sub[2].care_need == "orthopedic" and word[2].care_need == "eye"


def _one_facility(spark, specialties, services, equipment):
    row = {c: None for c in idx.INDEX_COLUMNS}
    row.update(unique_id="F1", name="n", facility_latitude=28.6, facility_longitude=77.2,
               specialties=specialties, standardized_services=services, standardized_equipment=equipment)
    schema = ", ".join(f"{c} {'double' if c in ('facility_latitude', 'facility_longitude', 'coord_nearest_pin_distance_km') else 'string'}"
                       for c in idx.INDEX_COLUMNS)
    return spark.createDataFrame([tuple(row[c] for c in idx.INDEX_COLUMNS)], schema)


def _hits(spark, index, keywords, opts=sr.DEFAULT_MATCH):
    plans = spark.createDataFrame([(1, 28.6139, 77.2090, 50, "x", keywords, "ok")],
                                  "search_id long, latitude double, longitude double, radius_km int, "
                                  "care_need string, keywords array<string>, status string")
    return sr.search_candidates(sr.distinct_plans(plans), index, opts=opts).count()


def test_match_options(spark):
    index = _one_facility(spark, '["criticalCareMedicine"]', '["Hemodialysis|Surgery"]',
                          '["CT Scanner|Imaging Equipment"]')
    assert _hits(spark, index, ["critical care"]) == 0
    assert _hits(spark, index, ["critical care"], sr.MatchOptions(humanize_specialties=True)) == 1
    assert _hits(spark, index, ["surgery"]) == 1
    assert _hits(spark, index, ["surgery"], sr.MatchOptions(strip_service_category=True)) == 0
    assert _hits(spark, index, ["ct scanner"]) == 0
    assert _hits(spark, index, ["ct scanner"], sr.MatchOptions(search_equipment=True)) == 1


def test_keyword_limit(spark):
    words = [f"{a}{b}therapy" for a in "abcde" for b in "klmno"]
    s = spark.createDataFrame([(1, "surgery " + " ".join(words) + " in jaipur"), (2, "dialysis in jaipur")], "search_id long, query string")
    responses = spark.createDataFrame([(2, '{"keywords": ["%s"]}' % '", "'.join(words))], "search_id long, response string")
    sizes = {}
    for limit in (4, 16, 40):
        rules = {r.search_id: r.keywords for r in pl.fallback_plan(s, keyword_limit=limit).collect()}
        plans = pl.with_status(pl.merge_plans(s, responses, keyword_limit=limit))
        merged = {r.search_id: r for r in plans.collect()}
        terms = {r.plan_id: r.search_terms for r in sr.distinct_plans(plans, limit).collect()}
        assert len(rules[1]) == len(merged[1].keywords) and terms[2] == merged[2].keywords
        assert merged[2].keywords[:4] == words[:4]
        sizes[limit] = (len(rules[1]), len(merged[2].keywords))
    assert sizes[4] == (4, 4) and sizes[16] == (16, 16) and min(sizes[40]) >= 25
    assert [r.keywords for r in pl.fallback_plan(s).orderBy("search_id").collect()] == [r.keywords for r in pl.fallback_plan(s, keyword_limit=16).orderBy("search_id").collect()]
