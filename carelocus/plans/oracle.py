"""DuckDB SQL that recomputes each registered query from the raw driver tables.

Written independently of the Spark code (window functions where Spark uses
min_by, the literal three-valued CASE where Spark uses a simplified class,
band predicates where Spark uses exploded cells), so agreement is evidence.
Fixture tables are CTEs over ``orders``, ``customer`` and ``events``.
"""

from __future__ import annotations

from carelocus.sources.fixtures import DMS_FRAGMENT, SEARCH_CITIES, SEARCH_TEXTS, VOCAB


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def dec(m: str) -> str:
    return f"((({m}) // 1000)::VARCHAR || '.' || lpad((({m}) % 1000)::VARCHAR, 3, '0'))"


_NUM_RE = r"\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*"


def coord(x: str, limit: float) -> str:
    return (f"(CASE WHEN regexp_full_match({x}, '{_NUM_RE}') AND abs(try_cast({x} AS DOUBLE)) <= {limit} "
            f"THEN try_cast({x} AS DOUBLE) END)")


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + "
         f"cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))")
    return f"(12742.0::DOUBLE * asin(sqrt(CASE WHEN {h} > 1.0 THEN 1.0::DOUBLE ELSE {h} END)))"


SPEC = sql_list([v[0] for v in VOCAB])
SVC = sql_list([v[1] for v in VOCAB])
CAP = sql_list([v[2] for v in VOCAB])

# name -> (sql body, dependencies)
CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (body, deps)


# ---------------------------------------------------------------- fixtures
cte("postal_directory", [], f"""
SELECT (110000 + p)::VARCHAR AS pincode,
  CASE WHEN p % 50 = 2 THEN NULL WHEN j % 3 = 0 THEN upper(dn) WHEN j % 3 = 1 THEN dn
       ELSE ' ' || lower(dn) || ' ' END AS district,
  CASE WHEN p % 10 = 3 AND j >= 4 THEN 'State ' || ((dno + 1) % 6)::VARCHAR
       ELSE 'State ' || (dno % 6)::VARCHAR END AS statename,
  CASE WHEN p % 25 = 7 OR (p + j) % 13 = 0 THEN 'NA'
       WHEN p % 20 = 5 AND j = 3 THEN {q(DMS_FRAGMENT)}
       ELSE {dec('25000 + (p * 7919) % 4993 + j')} END AS latitude,
  CASE WHEN p % 25 = 7 OR (p + j) % 13 = 0 OR (p % 30 = 11 AND j = 2) THEN 'NA'
       ELSE {dec('74000 + (p * 104729) % 4999 + 2 * j')} END AS longitude
FROM (
  SELECT p, j, dno, 'District ' || dno::VARCHAR AS dn FROM (
    SELECT p, j, CASE WHEN (p % 10 = 0 AND j >= 6) OR (p % 10 = 1 AND j >= 4)
                      THEN ((p * 31) % 40 + 1) % 40 ELSE (p * 31) % 40 END AS dno
    FROM (SELECT o_orderkey // 8 AS p, o_orderkey % 8 AS j FROM orders)))""")

cte("facilities", [], f"""
SELECT 'F' || k::VARCHAR AS unique_id,
  c_name AS name,
  CASE WHEN k % 6 = 0 THEN NULL ELSE c_mktsegment END AS organization_type,
  CASE WHEN k % 2 = 0 THEN NULL ELSE 'call us' END AS phone_numbers,
  CASE WHEN k % 3 = 0 THEN 'unknown' ELSE '+91 98765 ' || lpad((k % 100000)::VARCHAR, 5, '0') || ' (desk)' END
    AS officialPhone,
  'f' || k::VARCHAR || '@clinic.example.org' AS email,
  CASE WHEN k % 4 = 2 THEN NULL ELSE '["https://f' || k::VARCHAR || '.example.org"]' END AS websites,
  CASE WHEN k % 5 = 3 THEN NULL ELSE 'https://f' || k::VARCHAR || '.example.org' END AS officialWebsite,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'unknown' ELSE (k % 50 + 1)::VARCHAR END AS numberDoctors,
  CASE WHEN k % 3 = 0 THEN NULL ELSE (k % 300)::VARCHAR END AS capacity,
  CASE WHEN k % 5 = 0 THEN NULL ELSE {CAP}[k % 12 + 1] || ' in nation ' || c_nationkey::VARCHAR
       || ', segment ' || lower(c_mktsegment) END AS description,
  'Plot ' || (k % 97 + 1)::VARCHAR || ', Main Road' AS address_line1,
  CASE WHEN k % 2 = 0 THEN NULL ELSE 'Near bus stand' END AS address_line2,
  CASE WHEN k % 7 = 0 THEN '' ELSE 'City ' || (k % 40)::VARCHAR END AS address_city,
  CASE WHEN k % 14 = 0 THEN '' ELSE 'State ' || (k % 6)::VARCHAR END AS address_stateOrRegion,
  CASE WHEN k % 10 <= 5 THEN (110000 + p)::VARCHAR WHEN k % 10 = 6 THEN NULL
       WHEN k % 10 = 7 THEN (110001 + p)::VARCHAR WHEN k % 10 = 8 THEN '999999'
       ELSE ' ' || (110000 + p)::VARCHAR END AS address_zipOrPostcode,
  'India' AS address_country,
  '["' || {SPEC}[k % 12 + 1] || '","' || {SPEC}[(k * 5 + 1) % 12 + 1] || '"]' AS specialties,
  CASE WHEN k % 17 = 0 THEN 'NA' WHEN k % 19 = 1 THEN {dec('10000 + k % 1000')}
       ELSE {dec('25000 + (p * 7919) % 4993 + k % 7')} END AS latitude,
  CASE WHEN k % 17 = 0 THEN 'NA' WHEN k % 19 = 1 THEN {dec('70000 + k % 1000')}
       ELSE {dec('74000 + (p * 104729) % 4999 + k % 11')} END AS longitude
FROM (SELECT c.c_custkey AS k, c.c_name, c.c_nationkey, c.c_mktsegment, o.p
      FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderkey) // 8 AS p FROM orders GROUP BY o_custkey) o
      ON c.c_custkey = o.o_custkey)""")

cte("services", [], f"""
SELECT 'F' || c_custkey::VARCHAR AS unique_id,
  '["' || {SVC}[c_custkey % 12 + 1] || '","' || {SVC}[(c_custkey * 5 + 1) % 12 + 1] || '"]' AS standardized_services
FROM customer WHERE c_custkey % 9 <> 0""")

cte("equipment", [], """
SELECT 'F' || c_custkey::VARCHAR AS unique_id,
  CASE WHEN c_custkey % 2 = 0 THEN '["CT Scanner|Imaging Equipment"]'
       ELSE '["Ventilator|Life Support Equipment"]' END AS standardized_equipment
FROM customer WHERE c_custkey % 10 <> 0""")

cte("capabilities", [], f"""
SELECT 'F' || c_custkey::VARCHAR AS unique_id,
  '{{"capabilities": [{{"capability_name": "' || {CAP}[c_custkey % 12 + 1] || '"}}], "primary_focus": "'
    || {CAP}[(c_custkey * 5 + 1) % 12 + 1] || '"}}' AS parsed_capability
FROM customer WHERE c_custkey % 11 <> 0""")

cte("searches", [], f"""
SELECT event_id AS search_id,
  CASE WHEN {sql_list(SEARCH_CITIES)}[user_id % 8 + 1] = '' THEN {sql_list(SEARCH_TEXTS)}[event_id % 12 + 1]
       ELSE {sql_list(SEARCH_TEXTS)}[event_id % 12 + 1] || ' near ' || {sql_list(SEARCH_CITIES)}[user_id % 8 + 1]
  END AS query
FROM events""")

# ---------------------------------------------------------------- J1
cte("pin_norm", ["postal_directory"], f"""
SELECT CAST(pincode AS VARCHAR) AS pincode, trim(upper(district)) AS district_norm,
  trim(upper(statename)) AS statename_norm,
  {coord('latitude', 90)} AS latitude, {coord('longitude', 180)} AS longitude
FROM postal_directory""")

cte("pin_counts", ["pin_norm"], """
SELECT pincode, district_norm, statename_norm, count(*) AS office_count_for_district
FROM pin_norm GROUP BY pincode, district_norm, statename_norm""")

cte("pin_modal", ["pin_counts"], """
SELECT pincode, district_norm AS district, statename_norm AS statename FROM (
  SELECT *, row_number() OVER (PARTITION BY pincode ORDER BY office_count_for_district DESC,
    district_norm ASC NULLS FIRST, statename_norm ASC NULLS FIRST) AS rn FROM pin_counts) WHERE rn = 1""")

cte("pin_amb", ["pin_norm"], """
SELECT pincode, count(DISTINCT district_norm) AS district_match_count FROM pin_norm GROUP BY pincode""")

cte("pin_coords", ["pin_norm"], """
SELECT pincode, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude,
  bool_or(latitude IS NOT NULL AND longitude IS NOT NULL) AS has_coordinates, count(*) AS office_count
FROM pin_norm GROUP BY pincode""")

cte("pincode_lookup", ["pin_modal", "pin_amb", "pin_coords"], """
SELECT m.pincode, m.district, m.statename, a.district_match_count, c.latitude, c.longitude,
  c.has_coordinates, c.office_count
FROM pin_modal m LEFT JOIN pin_amb a ON m.pincode = a.pincode LEFT JOIN pin_coords c ON m.pincode = c.pincode""")

# ---------------------------------------------------------------- J2
cte("fac_points", ["facilities"], """
SELECT facility_id, latitude, longitude,
  CAST(floor(latitude / 0.1::DOUBLE) AS BIGINT) AS cell_lat, CAST(floor(longitude / 0.1::DOUBLE) AS BIGINT) AS cell_lon
FROM (SELECT unique_id AS facility_id, """ + coord("latitude", 90) + " AS latitude, " + coord("longitude", 180)
    + """ AS longitude FROM facilities) WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")

cte("pin_points", ["pincode_lookup"], """
SELECT pincode, district, statename, latitude AS pin_latitude, longitude AS pin_longitude,
  CAST(floor(latitude / 0.1::DOUBLE) AS BIGINT) AS pin_cell_lat,
  CAST(floor(longitude / 0.1::DOUBLE) AS BIGINT) AS pin_cell_lon
FROM pincode_lookup WHERE has_coordinates AND latitude IS NOT NULL AND longitude IS NOT NULL""")

cte("grid_cands", ["fac_points", "pin_points"], f"""
SELECT f.facility_id, f.latitude, f.longitude, f.cell_lat, f.cell_lon, p.pincode, p.district, p.statename,
  p.pin_latitude, p.pin_longitude, {hav('f.latitude', 'f.longitude', 'p.pin_latitude', 'p.pin_longitude')} AS distance_km
FROM fac_points f JOIN pin_points p
  ON abs(f.cell_lat - p.pin_cell_lat) <= 1 AND abs(f.cell_lon - p.pin_cell_lon) <= 1""")

cte("nearest", ["grid_cands"], """
SELECT facility_id, district AS coord_nearest_pin_district, statename AS coord_nearest_pin_state,
  pincode AS coord_nearest_pincode, round(distance_km, 2) AS coord_nearest_pin_distance_km
FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY distance_km, pincode) AS rn FROM grid_cands)
WHERE rn = 1""")

cte("unmatched", ["fac_points", "nearest"], """
SELECT facility_id FROM fac_points WHERE facility_id NOT IN (SELECT facility_id FROM nearest)""")

cte("nearest_complete", ["nearest", "unmatched"], """
SELECT * FROM nearest
UNION ALL
SELECT facility_id, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE FROM unmatched""")

# ---------------------------------------------------------------- J3
cte("with_signals", ["facilities", "pincode_lookup", "nearest_complete"], f"""
SELECT f.unique_id AS facility_id, {coord('f.latitude', 90)} AS latitude, {coord('f.longitude', 180)} AS longitude,
  f.address_zipOrPostcode AS postcode, l.district AS pin_district, l.statename AS pin_state,
  l.district_match_count AS pin_district_match_count, n.coord_nearest_pin_district, n.coord_nearest_pin_state,
  n.coord_nearest_pin_distance_km
FROM facilities f LEFT JOIN pincode_lookup l ON f.address_zipOrPostcode = l.pincode
LEFT JOIN nearest_complete n ON f.unique_id = n.facility_id""")

cte("location", ["with_signals"], """
SELECT facility_id, latitude, longitude, postcode, pin_district, pin_state, pin_district_match_count,
  coord_nearest_pin_district, coord_nearest_pin_state, coord_nearest_pin_distance_km,
  CASE WHEN cls IN ('confirmed', 'coordinate_based') THEN coord_nearest_pin_district
       WHEN cls = 'ambiguous_pin' THEN pin_district END AS district,
  CASE WHEN cls IN ('confirmed', 'coordinate_based') THEN coord_nearest_pin_state
       WHEN cls = 'ambiguous_pin' THEN pin_state END AS state,
  cls AS location_confidence
FROM (SELECT *, CASE
  WHEN postcode IS NOT NULL AND pin_district IS NOT NULL AND pin_district_match_count = 1
       AND (coord_nearest_pin_district IS NOT NULL AND coord_nearest_pin_distance_km <= 50.0)
       AND upper(trim(pin_district)) = upper(trim(coord_nearest_pin_district)) THEN 'confirmed'
  WHEN (coord_nearest_pin_district IS NOT NULL AND coord_nearest_pin_distance_km <= 50.0)
       AND (NOT (postcode IS NOT NULL) OR NOT (pin_district IS NOT NULL) OR NOT (pin_district_match_count = 1)
            OR NOT (upper(trim(pin_district)) = upper(trim(coord_nearest_pin_district)))) THEN 'coordinate_based'
  WHEN postcode IS NOT NULL AND pin_district IS NOT NULL AND NOT (pin_district_match_count = 1) THEN 'ambiguous_pin'
  ELSE 'unresolved' END AS cls FROM with_signals)""")

# ---------------------------------------------------------------- J4
cte("facility_index", ["facilities", "services", "equipment", "capabilities", "location"], f"""
SELECT f.unique_id, f.name, f.organization_type, f.phone_numbers, f.officialPhone, f.email, f.websites,
  f.officialWebsite, f.address_line1, f.address_line2, f.address_city, f.address_stateOrRegion,
  f.address_zipOrPostcode, f.address_country,
  {coord('f.latitude', 90)} AS facility_latitude, {coord('f.longitude', 180)} AS facility_longitude,
  l.district, l.state, l.location_confidence, l.coord_nearest_pin_distance_km, l.postcode AS verified_postcode,
  f.numberDoctors, f.capacity, f.description, f.specialties, s.standardized_services, e.standardized_equipment,
  c.parsed_capability
FROM facilities f
LEFT JOIN services s ON f.unique_id = s.unique_id
LEFT JOIN equipment e ON f.unique_id = e.unique_id
LEFT JOIN capabilities c ON f.unique_id = c.unique_id
LEFT JOIN location l ON f.unique_id = l.facility_id""")


def with_ctes(final_sql: str, *names: str) -> str:
    """Prefix `final_sql` with the CTEs it needs, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][0].strip()})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + final_sql.strip()


# ---------------------------------------------------------------- final queries
ORACLE: dict[str, str] = {}
_FINAL: dict[str, str] = {}


def register(key: str, final_sql: str, *names: str) -> None:
    _FINAL[key] = final_sql
    ORACLE[key] = with_ctes(final_sql, *names)


register("pin_normalize", "SELECT * FROM pin_norm", "pin_norm")
register("pin_district_counts", "SELECT * FROM pin_counts", "pin_counts")
register("pin_ambiguity", "SELECT * FROM pin_amb", "pin_amb")
register("pin_coords", "SELECT * FROM pin_coords", "pin_coords")
register("pin_modal_district", "SELECT * FROM pin_modal", "pin_modal")
register("pincode_lookup", "SELECT * FROM pincode_lookup", "pincode_lookup")
register("pincode_report", """
SELECT count(*) AS total_pincodes, count(*) FILTER (WHERE district_match_count > 1) AS ambiguous_pincodes,
  count(*) FILTER (WHERE NOT has_coordinates) AS pincodes_without_coordinates,
  count(*) FILTER (WHERE district IS NULL) AS pincodes_null_district FROM pincode_lookup""", "pincode_lookup")
register("facility_grid", "SELECT * FROM fac_points", "fac_points")
register("neighborhood_expand", """
SELECT p.pincode, p.pin_cell_lat + dy.v AS cell_lat, p.pin_cell_lon + dx.v AS cell_lon
FROM pin_points p, (SELECT unnest([-1, 0, 1]) AS v) dy, (SELECT unnest([-1, 0, 1]) AS v) dx""", "pin_points")
register("grid_candidates", """
SELECT facility_id, pincode, round(distance_km, 6) AS distance_km FROM grid_cands""", "grid_cands")
register("haversine_pairs", f"""
SELECT facility_id, pincode, round({hav('lat', 'lon', 'plat', 'plon')}, 6) AS distance_km FROM (
  SELECT f.unique_id AS facility_id, l.pincode, {coord('f.latitude', 90)} AS lat, {coord('f.longitude', 180)} AS lon,
    l.latitude AS plat, l.longitude AS plon
  FROM facilities f JOIN pincode_lookup l ON f.address_zipOrPostcode = l.pincode)
WHERE lat IS NOT NULL AND lon IS NOT NULL AND plat IS NOT NULL AND plon IS NOT NULL""",
         "facilities", "pincode_lookup")
register("nearest_pin", "SELECT * FROM nearest", "nearest")
register("unmatched_facilities", "SELECT * FROM unmatched", "unmatched")
register("nearest_pin_complete", "SELECT * FROM nearest_complete", "nearest_complete")
register("nearest_pin_exact", f"""
SELECT facility_id, district AS coord_nearest_pin_district, statename AS coord_nearest_pin_state,
  pincode AS coord_nearest_pincode, round(distance_km, 2) AS coord_nearest_pin_distance_km
FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY distance_km, pincode) AS rn FROM (
  SELECT f.facility_id, p.pincode, p.district, p.statename,
    {hav('f.latitude', 'f.longitude', 'p.pin_latitude', 'p.pin_longitude')} AS distance_km
  FROM fac_points f LEFT JOIN pin_points p ON true)) WHERE rn = 1""", "fac_points", "pin_points")
register("nearest_report", """
SELECT count(*) AS facilities_with_coordinates, count(coord_nearest_pincode) AS matched,
  count(*) - count(coord_nearest_pincode) AS unmatched,
  round(max(coord_nearest_pin_distance_km), 2) AS max_distance_km,
  (SELECT count(*) FROM (SELECT facility_id FROM nearest_complete GROUP BY facility_id HAVING count(*) > 1)) AS duplicate_ids
FROM nearest_complete""", "nearest_complete")
register("postcode_join", """
SELECT facility_id, latitude, longitude, postcode, pin_district, pin_state, pin_district_match_count
FROM with_signals""", "with_signals")
register("location_confidence", """
SELECT facility_id, location_confidence FROM location""", "location")
register("facility_location", "SELECT * FROM location", "location")
register("confidence_distribution", """
SELECT location_confidence, count(*) AS facility_count,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
FROM location GROUP BY location_confidence""", "location")
register("gold_base_projection", f"""
SELECT unique_id, name, organization_type, phone_numbers, officialPhone, email, websites, officialWebsite,
  numberDoctors, capacity, description, address_line1, address_line2, address_city, address_stateOrRegion,
  address_zipOrPostcode, address_country, specialties,
  {coord('latitude', 90)} AS facility_latitude, {coord('longitude', 180)} AS facility_longitude
FROM facilities""", "facilities")
register("facility_index", "SELECT * FROM facility_index", "facility_index")
register("index_report", """
SELECT count(*) AS total_rows, count(DISTINCT unique_id) AS distinct_ids,
  count(*) FILTER (WHERE district IS NULL) AS null_district,
  count(*) FILTER (WHERE standardized_services IS NULL) AS null_services FROM facility_index""", "facility_index")


# ---------------------------------------------------------------- J5 (search planning)
from carelocus.sources import dims  # noqa: E402


def _fx_templates():
    from carelocus.sources.fixtures import RESPONSE_TEMPLATES
    return RESPONSE_TEMPLATES

GAZ = "[" + ", ".join(
    f"{{'name': {q(n)}, 'title': {q(n.title())}, 'lat': {lat}::DOUBLE, 'lon': {lon}::DOUBLE}}"
    for n, lat, lon in dims.GAZETTEER) + "]"
NEEDS = "[" + ", ".join(f"{{'need': {q(n)}, 'kws': {sql_list(k)}}}" for n, k in dims.CARE_NEEDS) + "]"
STOP = sql_list(dims.STOPWORDS)


def any_in(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def clean_sql(expr: str, limit: int) -> str:
    cleaned = (f"list_filter(list_transform({expr}, lambda t: regexp_replace(trim(regexp_replace("
               f"lower(coalesce(t, 'None')), '\\s+', ' ', 'g')), '[^a-z0-9 /+-]', '', 'g')), "
               f"lambda t: length(t) >= 3)")
    return f"list_slice(list_filter({cleaned}, lambda x, i: list_position({cleaned}, x) = i), 1, {limit})"


PREFS = "list_filter([" + ", ".join(
    f"CASE WHEN {any_in('ql', trig)} THEN {q(label)} END" for label, trig in dims.PREFERENCE_RULES
) + "], lambda x: x IS NOT NULL)"

cte("plan_b", ["searches"], f"""
SELECT search_id, query, ql,
  list_filter({GAZ}, lambda g: contains(ql, g.name)) AS gm,
  list_filter({NEEDS}, lambda n: contains(ql, n.need) OR len(list_filter(n.kws, lambda k: contains(ql, k))) > 0) AS nm
FROM (SELECT search_id, query, lower(query) AS ql FROM searches)""")

cte("plan_c", ["plan_b"], f"""
SELECT *, gm[1].title AS city, gm[1].lat AS latitude, gm[1].lon AS longitude, nm[1].need AS need0,
  coalesce(nm[1].kws, []::VARCHAR[]) AS mapped,
  list_filter(regexp_extract_all(ql, '[a-z][a-z0-9+-]{{2,}}'), lambda t: NOT list_contains({STOP}, t)
    AND NOT list_contains(flatten(list_transform(gm, lambda g: string_split(g.name, ' '))), t)) AS toks
FROM plan_b""")

cte("plan_d", ["plan_c"], f"""
SELECT *, {clean_sql('list_concat(mapped, toks)', dims.KEYWORD_LIMIT)} AS kw0,
  ({any_in('ql', dims.INJURY_WORDS)} AND {any_in('ql', dims.LIMB_WORDS)}) AS inj,
  {any_in('ql', dims.SURGERY_TRIGGERS)} AS surg
FROM plan_c""")

cte("plan_e", ["plan_d"], f"""
SELECT *,
  CASE WHEN inj THEN {clean_sql('list_concat(' + sql_list(dims.ORTHOPEDIC_PLAN_KEYWORDS) + ', kw0)', dims.KEYWORD_LIMIT)}
       WHEN surg THEN {clean_sql('list_concat(' + sql_list(dims.SURGICAL_KEYWORDS) + ', kw0)', dims.KEYWORD_LIMIT)}
       ELSE kw0 END AS keywords,
  CASE WHEN inj THEN {q(dims.ORTHOPEDIC_NEED)} WHEN surg THEN coalesce(nullif(need0, ''), {q(dims.SURGICAL_NEED)})
       ELSE need0 END AS need1,
  {PREFS} AS preferences
FROM plan_d""")

cte("plans", ["plan_e"], f"""
SELECT search_id, query, city, latitude, longitude,
  coalesce(nullif(need1, ''), nullif(array_to_string(list_slice(keywords, 1, 3), ' '), ''), {q(dims.DEFAULT_NEED)})
    AS care_need,
  keywords, preferences, {dims.RADIUS_DEFAULT_KM} AS radius_km, 'keyword fallback' AS source,
  CASE WHEN city IS NULL OR latitude IS NULL OR longitude IS NULL THEN 'no_city'
       WHEN len(keywords) = 0 THEN 'no_keywords' ELSE 'ok' END AS status
FROM plan_e""")

_resp_sql = ", ".join("NULL" if t is None else q(t) for t in _fx_templates())

cte("planner_responses", [], f"""
SELECT event_id AS search_id,
  replace(replace(replace([{_resp_sql}][(event_id // 4) % {len(_fx_templates())} + 1], '{{C}}', c), '{{c}}', lower(c)),
    '{{T}}', t) AS response
FROM (SELECT event_id, {sql_list(SEARCH_CITIES)}[user_id % 8 + 1] AS c, {sql_list(SEARCH_TEXTS)}[event_id % 12 + 1] AS t
      FROM events)""")

def truthy_sql(j: str, path: str = "$") -> str:
    """A JSON value as text unless it is null, false, zero or empty; the oracle's own rule, by JSON type."""
    x, kind = f"json_extract_string({j}, '{path}')", f"json_type({j}, '{path}')"
    return (f"CASE WHEN {kind} IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN CASE WHEN {x}::DOUBLE <> 0 THEN {x} END "
            f"WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {x} = 'true' THEN {x} END "
            f"WHEN {kind} = 'ARRAY' THEN CASE WHEN json_array_length({j}, '{path}') > 0 THEN {x} END "
            f"WHEN {kind} = 'OBJECT' THEN CASE WHEN len(json_keys({j}, '{path}')) > 0 THEN {x} END ELSE nullif({x}, '') END")


def last_keys_sql(j: str) -> str:
    """The object with the last value of each repeated key alone."""
    keys, values = f"json_keys({j})", f"json_extract({j}, '$.*')"
    kept = (f"list_transform(list_filter(range(1, len({keys}) + 1), lambda i: NOT list_contains({keys}[i + 1:], {keys}[i])), "
            f"lambda i: to_json({keys}[i])::VARCHAR || ':' || {values}[i]::VARCHAR)")
    return f"CASE WHEN json_type({j}) = 'OBJECT' THEN ('{{' || array_to_string({kept}, ',') || '}}')::JSON ELSE {j} END"


cte("resp", ["resp_raw"], f"""
SELECT search_id, j, json_type(j, '$.radius_km') AS rtype, json_extract_string(j, '$.radius_km') AS rtext
FROM (SELECT search_id, {last_keys_sql('j')} AS j FROM resp_raw)""")

cte("resp_raw", ["planner_responses"], r"""
SELECT search_id, j FROM (SELECT search_id, CASE WHEN content IS NULL THEN j0 WHEN cand1 <> '' AND json_valid(cand1) THEN cand1::JSON END AS j
      FROM (SELECT *, regexp_extract(content, '(?s)\{.*\}', 0) AS cand1
            FROM (SELECT *, coalesce(nullif(json_extract_string(j0, '$.choices[0].message.content'), ''),
                    nullif(json_extract_string(j0, '$.content'), ''), nullif(json_extract_string(j0, '$.text'), ''),
                    nullif(json_extract_string(j0, '$.output_text'), '')) AS content
                  FROM (SELECT search_id, CASE WHEN cand <> '' AND json_valid(cand) THEN cand::JSON END AS j0
                        FROM (SELECT search_id, regexp_extract(coalesce(response, ''), '(?s)\{.*\}', 0) AS cand
                              FROM (SELECT search_id, min(response) AS response FROM planner_responses GROUP BY search_id))))))""")

cte("resp_parsed", ["resp"], r"""
SELECT search_id, j,
  CASE WHEN rtype = 'VARCHAR' THEN CASE WHEN regexp_full_match(rtext, '\s*[+-]?[0-9]+\s*') THEN trim(rtext)::DOUBLE END
       WHEN rtype = 'BOOLEAN' THEN CASE WHEN rtext = 'true' THEN 1.0 ELSE 0.0 END
       WHEN rtype IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN trunc(rtext::DOUBLE) END AS radius_value
FROM resp""")


def _jlist(path: str) -> str:
    return f"""CASE json_type(r.j, '$.{path}') WHEN 'OBJECT' THEN json_keys(r.j, '$.{path}')
      WHEN 'VARCHAR' THEN list_filter(string_split(json_extract_string(r.j, '$.{path}'), ''), lambda c: c <> '')
      ELSE coalesce(json_extract_string(r.j, '$.{path}[*]'), []::VARCHAR[]) END"""


def _no_list(path: str) -> str:
    return (f"(json_type(r.j, '$.{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') "
            f"AND json_extract_string(r.j, '$.{path}') NOT IN ('0', '0.0', '-0.0', 'false'))")


cte("merged", ["plans", "resp_parsed"], f"""
SELECT search_id, query,
  CASE WHEN usable AND take_given THEN given ELSE city END AS city,
  CASE WHEN usable AND take_given THEN known.lat ELSE latitude END AS latitude,
  CASE WHEN usable AND take_given THEN known.lon ELSE longitude END AS longitude,
  CASE WHEN usable THEN coalesce({truthy_sql('j', '$.care_need')}, care_need) ELSE care_need END
    AS care_need,
  CASE WHEN usable THEN m_keywords ELSE keywords END AS keywords,
  CASE WHEN usable THEN m_prefs ELSE preferences END AS preferences,
  CASE WHEN usable THEN CAST(least(greatest(coalesce(radius_value, {dims.RADIUS_DEFAULT_KM}.0), 5.0), 500.0) AS INTEGER)
       ELSE radius_km END AS radius_km,
  CASE WHEN usable THEN 'model planner' ELSE source END AS source
FROM (
  SELECT p.*, r.j, r.radius_value, r.j IS NOT NULL AND NOT coalesce({' OR '.join('coalesce(' + _no_list(x) + ', false)' for x in ('keywords', 'must_have', 'nice_to_have', 'preferences'))}, false) AS usable,
    {truthy_sql('r.j', '$.city')} AS given,
    list_filter({GAZ}, lambda g: g.name = lower({truthy_sql('r.j', '$.city')}))[1] AS known,
    {truthy_sql('r.j', '$.city')} IS NOT NULL
      AND list_filter({GAZ}, lambda g: g.name = lower({truthy_sql('r.j', '$.city')}))[1] IS NOT NULL
      AS take_given,
    {clean_sql('list_concat(' + _jlist('keywords') + ', ' + _jlist('must_have') + ', ' + _jlist('nice_to_have')
               + ', p.keywords)', dims.KEYWORD_LIMIT)} AS m_keywords,
    {clean_sql('list_concat(' + _jlist('preferences') + ', p.preferences)', dims.PREFERENCE_LIMIT)} AS m_prefs
  FROM plans p LEFT JOIN resp_parsed r ON p.search_id = r.search_id)""")

cte("merged_plans", ["merged"], """
SELECT *, CASE WHEN city IS NULL OR latitude IS NULL OR longitude IS NULL THEN 'no_city'
       WHEN len(keywords) = 0 THEN 'no_keywords' ELSE 'ok' END AS status FROM merged""")

_PLAN_VIEW = """SELECT search_id, city, latitude, longitude, care_need, array_to_string(keywords, ' | ') AS keywords,
  array_to_string(preferences, ' | ') AS preferences, radius_km, source, status FROM {src}"""

register("resolve_city", "SELECT search_id, gm[1].title AS city, gm[1].lat AS city_lat, gm[1].lon AS city_lon FROM plan_b",
         "plan_b")
register("resolve_care_need", """
SELECT search_id, nm[1].need AS care_need, array_to_string(nm[1].kws, ' | ') AS mapped_keywords FROM plan_b""", "plan_b")
register("query_tokens", "SELECT search_id, array_to_string(toks, ' | ') AS tokens FROM plan_c", "plan_c")
register("clean_terms", "SELECT search_id, array_to_string(kw0, ' | ') AS keywords FROM plan_d", "plan_d")
register("infer_intent", "SELECT search_id, care_need, array_to_string(keywords, ' | ') AS keywords FROM plans", "plans")
register("search_preferences", "SELECT search_id, array_to_string(preferences, ' | ') AS preferences FROM plans",
         "plans")
register("search_plan", _PLAN_VIEW.format(src="plans"), "plans")
register("search_status", "SELECT search_id, status FROM plans", "plans")
register("plan_response_parse", """
SELECT r.search_id, r.j IS NOT NULL AS readable, json_extract_string(r.j, '$.city') AS city,
  json_extract_string(r.j, '$.care_need') AS care_need,
  CASE WHEN json_type(r.j, '$.keywords') = 'ARRAY' THEN array_to_string(json_extract_string(r.j, '$.keywords[*]'), ' | ')
  END AS keywords,
  CAST(r.radius_value AS BIGINT) AS radius_value
FROM resp_parsed r""", "resp_parsed")
register("merge_plans", _PLAN_VIEW.format(src="merged_plans"), "merged_plans")


# ---------------------------------------------------------------- J6 (search execution, evidence, cards)
def bind(expr: str, var: str, body: str) -> str:
    """Evaluate `body` with `var` bound to `expr` once (single-element list trick)."""
    return f"list_transform([{expr}], lambda {var}: {body})[1]"


def clean_ev(x: str) -> str:
    s = f"trim(regexp_replace(coalesce(({x})::VARCHAR, ''), '\\s+', ' ', 'g'))"
    s = f"""regexp_replace({s}, '^["'']?\\w+["'']?\\s*:\\s*["'']?', '')"""
    for word, label in [("capability_name", "Capability"), ("standardized_service_name", "Service"),
                        ("specialty_name", "Specialty")]:
        s = f"regexp_replace({s}, '\\b{word}\\b', '{label}', 'gi')"
    s = f"regexp_replace({s}, '^[\\[\\]{{}}()]+|[\\[\\]{{}}()]+$', '', 'g')"
    s = f"""regexp_replace({s}, '^[,;:."'']+|[,;:."'']+$', '', 'g')"""
    h = f"regexp_replace({s}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    return bind(h, "hz", "upper(left(hz, 1)) || substr(hz, 2)")


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def has_value_sql(x: str) -> str:
    s = strip_sql(f"({x})::VARCHAR")
    return (f"coalesce(length({s}) > 0 AND lower({s}) NOT IN "
            f"({', '.join(q(m) for m in dims.MISSING_MARKERS)}), false)")


def _first_key(j: str) -> str:
    return bind(last_keys_sql(j), "lk", "coalesce(" + ", ".join(truthy_sql("lk", f"$.{k}") for k in dims.EVIDENCE_NAME_KEYS) + ")")


def _dict_like(t: str) -> str:
    n = f"replace(replace({t}, '&#x27;', ''''), '&quot;', '\"')"
    pats = []
    for k in dims.EVIDENCE_NAME_KEYS:
        pats += [f"""nullif(regexp_extract({n}, '(?i)"{k}"\\s*:\\s*"([^"]+)"', 1), '')""",
                 f"""nullif(regexp_extract({n}, '(?i)''{k}''\\s*:\\s*''([^'']+)''', 1), '')""",
                 f"""nullif(regexp_extract({n}, '(?i){k}\\s*:\\s*([^,}}]+)', 1), '')"""]
    return clean_ev("coalesce(" + ", ".join(pats) + ")")


def ev_items(x: str) -> str:
    body = f"""CASE WHEN t = '' THEN []::VARCHAR[]
  WHEN json_valid(t) AND json_type(t::JSON) = 'ARRAY' THEN list_filter(list_transform(json_extract(t::JSON, '$[*]'),
       lambda e: {clean_ev(f"CASE WHEN json_type(e) = 'OBJECT' THEN {_first_key('e')} ELSE {truthy_sql('e')} END")}),
       lambda s: s <> '')
  WHEN json_valid(t) AND json_type(t::JSON) = 'OBJECT' THEN list_filter([{clean_ev(_first_key('t::JSON'))}], lambda s: s <> '')
  WHEN {_dict_like('t')} <> '' THEN [{_dict_like('t')}]
  ELSE list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '^[\\[\\]]+|[\\[\\]]+$', '', 'g'),
       '["'']?\\s*,\\s*["'']?'), lambda p: {clean_ev('p')}), lambda s: s <> '') END"""
    return bind(strip_sql(f"coalesce(({x})::VARCHAR, '')"), "t", body)


def excerpt_sql(v: str, k: str) -> str:
    inner = bind(f"{{'s': greatest(0, p - {dims.EXCERPT_BEFORE}), 'e': least(length({v}), p + {dims.EXCERPT_AFTER})}}", "w",
                 f"CASE WHEN w.s > 0 THEN '...' ELSE '' END || {clean_ev(f'substring({v}, w.s + 1, w.e - w.s)')}"
                 f" || CASE WHEN w.e < length({v}) THEN '...' ELSE '' END")
    return bind(f"instr(lower({v}), lower({k})) - 1", "p", inner)


def field_ev_sql(v: str, items: str | None, kws: str, label: str) -> str:
    if items is None:
        text = excerpt_sql(v, "k")
    else:
        text = bind(f"list_filter({items}, lambda it: contains(lower(it), lower(k)))", "m",
                    f"CASE WHEN len(m) > 0 THEN array_to_string(list_slice(m, 1, {dims.STRUCTURED_MATCHES}), ', ') "
                    f"ELSE {excerpt_sql(v, 'k')} END")
    pairs = (f"list_transform(list_filter({kws}, lambda k: contains(lower({v}), lower(k))), "
             f"lambda k: {bind(text, 'ex', "{'e': ex, 'n': regexp_replace(lower(ex), '\\W+', '', 'g')}")})")
    kept = ("list_filter(ps, lambda x, i: x.e <> '' AND "
            "len(list_filter(list_slice(ps, 1, i - 1), lambda y: y.e <> '' AND y.n = x.n)) = 0)")
    return bind(pairs, "ps", f"list_transform({kept}, lambda x: {q(label + ': ')} || x.e)")


_ORTHO_TEXT = "lower(concat_ws(' ', coalesce(care_need, ''), array_to_string(keywords, ' ')))"

cte("dplans", ["plans"], f"""
SELECT *, {clean_sql('keywords', dims.KEYWORD_LIMIT)} AS search_terms,
  {any_in(_ORTHO_TEXT, dims.ORTHOPEDIC_INTENT_TERMS)} AS orthopedic,
  round(latitude - radius_km / 111.0, 6) AS min_lat, round(latitude + radius_km / 111.0, 6) AS max_lat,
  round(longitude - radius_km / greatest(111.0 * cos(radians(latitude)), 1.0), 6) AS min_lon,
  round(longitude + radius_km / greatest(111.0 * cos(radians(latitude)), 1.0), 6) AS max_lon
FROM (SELECT latitude, longitude, radius_km, care_need, keywords, min(search_id) AS plan_id
      FROM plans WHERE status = 'ok' GROUP BY latitude, longitude, radius_km, care_need, keywords)""")

cte("sidx", ["facility_index"], f"""
SELECT *, lower(concat_ws(' ', {', '.join(f"coalesce({c}, '')" for c in dims.SEARCH_TEXT_FIELDS)})) AS search_text,
  {has_value_sql('numberDoctors')} AS has_doctors, {has_value_sql('capacity')} AS has_capacity
FROM facility_index WHERE facility_latitude IS NOT NULL AND facility_longitude IS NOT NULL""")

cte("cands", ["dplans", "sidx"], """
SELECT p.*, i.* FROM dplans p JOIN sidx i
  ON i.facility_latitude BETWEEN p.min_lat AND p.max_lat AND i.facility_longitude BETWEEN p.min_lon AND p.max_lon
WHERE len(list_filter(p.search_terms, lambda k: contains(lower(i.specialties), k)
  OR contains(lower(i.standardized_services), k) OR contains(lower(i.parsed_capability), k)
  OR contains(lower(i.description), k))) > 0""")

_ORTHO_SUM = " + ".join(f"CASE WHEN {any_in('search_text', terms)} THEN {pts} ELSE 0 END"
                        for terms, pts in dims.ORTHOPEDIC_SCORE_RULES)

cte("scored", ["cands"], f"""
SELECT *, CAST(CASE WHEN orthopedic THEN
    (CASE WHEN {any_in('search_text', dims.DENTAL_TERMS)} AND o < 8 THEN o - {dims.DENTAL_PENALTY} ELSE o END)
    ELSE len(list_filter(keywords, lambda k: contains(search_text, lower(k)))) END
  + CAST(has_doctors AS INTEGER) + CAST(has_capacity AS INTEGER) AS INTEGER) AS relevance_score
FROM (SELECT *, {hav('latitude', 'longitude', 'facility_latitude', 'facility_longitude')} AS distance_km,
        {_ORTHO_SUM} AS o FROM cands)
WHERE distance_km <= radius_km""")

cte("top5", ["scored"], f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY relevance_score DESC, distance_km,
  unique_id) AS INTEGER) AS rank FROM scored WHERE NOT orthopedic OR relevance_score >= {dims.ORTHOPEDIC_MIN_SCORE})
WHERE rank <= {dims.TOP_K}""")

cte("search_map", ["plans", "dplans"], """
SELECT p.search_id, p.preferences, d.plan_id FROM plans p JOIN dplans d
  ON p.latitude = d.latitude AND p.longitude = d.longitude AND p.radius_km = d.radius_km
  AND p.care_need = d.care_need AND p.keywords = d.keywords
WHERE p.status = 'ok'""")

_EV_KW = f"CASE WHEN orthopedic THEN {sql_list(dims.ORTHOPEDIC_EVIDENCE_KEYWORDS)} ELSE keywords END"

cte("top5_items", ["top5"], f"""
SELECT *, {ev_items('specialties')} AS it_spec, {ev_items('standardized_services')} AS it_svc,
  {ev_items('parsed_capability')} AS it_cap, {_EV_KW} AS ev_kw FROM top5""")

_LABELS = dict(dims.EVIDENCE_FIELDS)

cte("top5_ev", ["top5_items"], f"""
SELECT *, list_slice(list_concat(
  {field_ev_sql("coalesce(specialties, '')", 'it_spec', 'ev_kw', _LABELS['specialties'])},
  {field_ev_sql("coalesce(standardized_services, '')", 'it_svc', 'ev_kw', _LABELS['standardized_services'])},
  {field_ev_sql("coalesce(parsed_capability, '')", 'it_cap', 'ev_kw', _LABELS['parsed_capability'])},
  {field_ev_sql("coalesce(description, '')", None, 'ev_kw', _LABELS['description'])}), 1, {dims.EVIDENCE_PER_RESULT})
  AS evidence FROM top5_items""")

_PHONE_RE = r"\+?\d[\d\s().-]{7,}\d"


def clean_phone_sql(x: str) -> str:
    found = f"regexp_extract(ph, '{_PHONE_RE}', 0)"
    return bind(strip_sql(f"coalesce(({x})::VARCHAR, '')"), "ph",
                f"CASE WHEN {found} <> '' THEN {strip_sql(found)} ELSE left(ph, {dims.CONTACT_FALLBACK_CHARS}) END")


_CONTACT = ("CASE " + " ".join(f"WHEN {has_value_sql(c)} THEN {clean_phone_sql(c)}"
                               for c in ["officialPhone", "phone_numbers", "email"]) + " END")
_STRENGTH = (f"concat_ws(', ', CASE WHEN {has_value_sql('numberDoctors')} THEN numberDoctors || ' doctors' END, "
             f"CASE WHEN {has_value_sql('capacity')} THEN 'capacity ' || capacity END)")
_PLACE = ("coalesce(nullif(concat_ws(', ', coalesce(nullif(district, ''), nullif(address_city, '')), "
          "coalesce(nullif(state, ''), nullif(address_stateOrRegion, ''))), ''), 'Location on file')")
_CONF = ("CASE " + " ".join(f"WHEN location_confidence = {q(a)} THEN {q(b)}" for a, b in dims.CONFIDENCE_LABELS)
         + f" ELSE {q(dims.UNKNOWN_CONFIDENCE_LABEL)} END")
_META = (f"concat_ws(' · ', coalesce(nullif(organization_type, ''), 'Healthcare Facility'), "
         f"CASE WHEN {has_value_sql('numberDoctors')} THEN numberDoctors || ' doctors' END, "
         f"CASE WHEN {has_value_sql('capacity')} THEN 'capacity ' || capacity END)")
_WANTS = any_in("lower(array_to_string(coalesce(preferences, []::VARCHAR[]), ' '))", dims.STRENGTH_WISH_TERMS)

register("search_bbox", """
SELECT plan_id, round(min_lat, 6) AS min_lat, round(max_lat, 6) AS max_lat, round(min_lon, 6) AS min_lon,
  round(max_lon, 6) AS max_lon FROM dplans""", "dplans")
register("facility_text", "SELECT unique_id, " + "lower(concat_ws(' ', " + ", ".join(
    f"coalesce({c}, '')" for c in dims.SEARCH_TEXT_FIELDS) + ")) AS search_text FROM facility_index", "facility_index")
register("search_candidates", "SELECT plan_id, unique_id FROM cands", "cands")
register("search_within_radius", "SELECT plan_id, unique_id, round(distance_km, 6) AS distance_km FROM scored",
         "scored")
register("relevance_score", "SELECT plan_id, unique_id, orthopedic, relevance_score FROM scored", "scored")
register("search_top5", """
SELECT m.search_id, t.rank, t.unique_id, t.relevance_score, round(t.distance_km, 6) AS distance_km
FROM search_map m JOIN top5 t ON m.plan_id = t.plan_id""", "search_map", "top5")
register("search_counts", f"""
SELECT p.search_id, p.status, coalesce(c.n, 0)::BIGINT AS result_count, least(coalesce(c.n, 0), {dims.TOP_K})::BIGINT
  AS shown_count
FROM plans p LEFT JOIN (SELECT m.search_id, r.n FROM search_map m JOIN (
    SELECT plan_id, count(*) AS n FROM scored WHERE NOT orthopedic OR relevance_score >= {dims.ORTHOPEDIC_MIN_SCORE}
    GROUP BY plan_id) r ON m.plan_id = r.plan_id) c ON p.search_id = c.search_id""", "plans", "search_map", "scored")
register("search_evidence", """
SELECT plan_id, rank, unique_id, array_to_string(evidence, ' | ') AS evidence FROM top5_ev""", "top5_ev")
register("result_cards", f"""
SELECT m.search_id, t.rank, t.unique_id, coalesce(t.name, '') AS name, {_META} AS meta, {_PLACE} AS place,
  round(t.distance_km, 1) AS distance_km, {_CONF} AS confidence_label,
  CASE WHEN {_WANTS} AND {_STRENGTH} <> '' THEN 'larger facility signal: ' || {_STRENGTH} END AS strength_badge,
  {_CONTACT} AS contact,
  array_to_string(list_transform(t.evidence, lambda e: substring(e, 1, {dims.EVIDENCE_DISPLAY_CHARS})), ' | ') AS evidence,
  t.relevance_score
FROM search_map m JOIN top5_ev t ON m.plan_id = t.plan_id""", "search_map", "top5_ev")


def on_merged_plans(sql: str) -> str:
    """The same SQL over the plans that planner responses changed, wherever searches are run."""
    for table in ("dplans", "search_map"):
        body = CTES[table][0].strip()
        sql = sql.replace(body, body.replace("FROM plans", "FROM merged_plans"))
    return sql


for _key, _names in (("search_top5", ("search_map", "top5")), ("search_counts", ("plans", "search_map", "scored")), ("result_cards", ("search_map", "top5_ev"))):
    register(_key + "_merged", _FINAL[_key].replace("FROM plans", "FROM merged_plans"), "merged_plans", *_names)
    ORACLE[_key + "_merged"] = on_merged_plans(ORACLE[_key + "_merged"])
register("has_value_flags", "SELECT unique_id, " + ", ".join(
    f"{has_value_sql(c)} AS has_{c}" for c in
    ["numberDoctors", "capacity", "officialPhone", "phone_numbers", "email", "organization_type"]) + " FROM facilities",
         "facilities")
register("contact_pick", f"SELECT unique_id, {_CONTACT} AS contact, {_STRENGTH} AS strength FROM facilities",
         "facilities")
register("clean_phone", "SELECT unique_id, " + ", ".join(
    f"{clean_phone_sql(c)} AS {c}" for c in ["officialPhone", "phone_numbers", "email"]) + " FROM facilities",
         "facilities")
register("clean_evidence", "SELECT unique_id, " + ", ".join(
    f"{clean_ev(c)} AS {c}" for c in ["specialties", "standardized_services", "parsed_capability", "description"])
    + " FROM facility_index", "facility_index")
register("evidence_items", "SELECT unique_id, " + ", ".join(
    f"array_to_string({ev_items(c)}, ' | ') AS {c}" for c in
    ["specialties", "standardized_services", "parsed_capability", "standardized_equipment"])
    + " FROM facility_index", "facility_index")


# ---------------------------------------------------------------- S1-S6 (enrichment)
from carelocus.operators import enrich as en  # noqa: E402
from carelocus.sources import fixtures as _fx  # noqa: E402

cte("evidence_shapes", [], f"""
SELECT c_custkey AS k, replace({sql_list(_fx.EVIDENCE_SHAPES)}[c_custkey % {len(_fx.EVIDENCE_SHAPES)} + 1], '{{T}}',
  {sql_list(_fx.RAW_PROCEDURES)}[c_custkey % {len(_fx.RAW_PROCEDURES)} + 1]) AS value FROM customer""")
register("evidence_shapes", f"SELECT k, array_to_string({ev_items('value')}, ' | ') AS items FROM evidence_shapes", "evidence_shapes")



def _pick_sql(values, idx: str) -> str:
    return f"{sql_list(values)}[({idx}) % {len(values)} + 1]"


def _json_list_sql(values, k: str) -> str:
    parts = [_pick_sql(values, f"{k} * {m} + {a}") for m, a in [(1, 0), (7, 3), (11, 5)]]
    return "'[\"' || " + " || '\", \"' || ".join(parts) + " || '\"]'"


_RC, _CC, _CL, _SL = _fx.RAW_CAPABILITY_NAMES, _fx.CAPABILITY_CATEGORIES, _fx.COMPLEXITY_LEVELS, _fx.SPECIALIZATION_LEVELS
_CAP_OBJ = (
    f"""'{{"capabilities": [{{"capability_name": "' || {_pick_sql(_RC, 'k')} || '", "category": "' || {_pick_sql(_CC, 'k')}"""
    f""" || '", "description": "Provides ' || lower({_pick_sql(_RC, 'k')}) || ' services", "complexity_level": "'"""
    f""" || {_pick_sql(_CL, 'k * 3')} || '", "ai_agent_tags": ["tag' || (k % 4)::VARCHAR || '", "care"]}}, """
    f"""{{"capability_name": "' || {_pick_sql(_RC, 'k + 2')} || '", "category": "Clinical"}}], "primary_focus": "'"""
    f""" || {_pick_sql(_RC, 'k + 1')} || '", "specialization_level": "' || {_pick_sql(_SL, 'k')} || '", "summary": "'"""
    f""" || repeat('Facility with broad services. ', CAST(k % 8 AS INTEGER)) || '"}}'"""
)

cte("raw_terms", [], f"""
SELECT 'F' || k::VARCHAR AS unique_id,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 13 = 0 THEN '["Nephrology", '
       ELSE {_json_list_sql(_fx.RAW_SPECIALTIES, 'k')} END AS specialties,
  CASE WHEN k % 19 = 0 THEN NULL ELSE {_json_list_sql(_fx.RAW_PROCEDURES, 'k')} END AS procedure,
  CASE WHEN k % 23 = 0 THEN '[]' ELSE {_json_list_sql(_fx.RAW_EQUIPMENT, 'k')} END AS equipment,
  CASE WHEN k % 7 = 0 THEN '{{"capabilities": [{{"capability_name": "broken"' WHEN k % 29 = 0 THEN NULL
       ELSE {_CAP_OBJ} END AS capability
FROM (SELECT c_custkey AS k FROM customer)""")

cte("enrich_requests", ["raw_terms"], "\nUNION ALL\n".join(
    f"SELECT unique_id, {q(kind)} AS kind, {q(before)} || {col} || {q(after)} AS prompt FROM raw_terms"
    for kind, (col, before, after) in en.PROMPTS.items()))


def _dict_sql(mapping: dict) -> str:
    return "[" + ", ".join(f"{{'k': {q(a)}, 'v': {q(b)}}}" for a, b in mapping.items()) + "]"


def _lookup_sql(mapping: dict, key: str) -> str:
    return f"list_filter({_dict_sql(mapping)}, lambda d: d.k = {key})[1].v"


def _initcap(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


def _camel(x: str) -> str:
    return (f"(lower(string_split({x}, ' ')[1]) || array_to_string(list_transform(string_split({x}, ' ')[2:], "
            f"lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ''))")


def _norm_sql(t: str) -> str:
    return f"lower(trim(regexp_replace({t}, '\\s+', ' ', 'g')))"


def _cat_sql(x: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_in(x, words)} THEN {q(cat)}" for words, cat in rules) + f" ELSE {q(default)} END"


def _finish_sql(items: str) -> str:
    kept = f"list_filter({items}, lambda x: x IS NOT NULL AND x <> '')"
    return f"CAST(to_json(list_filter({kept}, lambda x, i: list_position({kept}, x) = i)) AS VARCHAR)"


def _json_strings_sql(x: str) -> str:
    return f"CASE WHEN json_valid({x}) AND json_type({x}::JSON) = 'ARRAY' THEN json_extract_string({x}::JSON, '$[*]') END"


_SPEC_ONE = bind(_norm_sql("regexp_replace(t, '([a-z])([A-Z])', '\\1 \\2', 'g')"), "n", f"coalesce({_lookup_sql(en.SPECIALTY_SYNONYMS, 'n')}, {_camel('n')})")
_SVC_ONE = bind(bind(_norm_sql("t"), "n", "CASE WHEN n IN ('robotic surgery', 'robotic-assisted surgery') THEN n "
                     "ELSE regexp_replace(n, '^robotic(-assisted)? ', '') END"), "b",
                bind(f"coalesce({_lookup_sql(en.SERVICE_SYNONYMS, 'b')}, b)", "m",
                     f"CASE WHEN m <> '' THEN coalesce({_lookup_sql(en.SERVICE_NAMES, 'm')}, {_initcap('m')}) || '|' || "
                     f"{_cat_sql('m', en.SERVICE_CATEGORY_RULES, 'Treatment')} END"))
_EQ_ONE = bind(_norm_sql("t"), "n", bind(
    f"trim(regexp_replace(CASE WHEN regexp_matches(n, '{en.SPECIFICATION}') THEN n "
    "ELSE regexp_replace(n, '^[0-9]+ ', '') END, ' x ?[0-9]+$', ''))", "b",
    bind(f"coalesce({_lookup_sql(en.EQUIPMENT_SYNONYMS, 'b')}, b)", "m",
         f"CASE WHEN m <> '' AND NOT regexp_matches(n, '{en.EXCLUDED_WORDS}') "
         f"AND b NOT IN ({', '.join(q(x) for x in en.EQUIPMENT_EXCLUDE_TERMS)}) THEN "
         f"coalesce({_lookup_sql(en.EQUIPMENT_NAMES, 'm')}, {_initcap('m')}) || '|' || "
         f"{_cat_sql('m', en.EQUIPMENT_CATEGORY_RULES, en.EQUIPMENT_DEFAULT_CATEGORY)} END")))

register("enrichment_requests", "SELECT * FROM enrich_requests", "enrich_requests")
register("enrichment_apply", """
SELECT unique_id, kind, 'ok:' || length(prompt)::VARCHAR AS response FROM enrich_requests""", "enrich_requests")
register("enrichment_store", """
SELECT unique_id, kind, CASE WHEN kind = 'services' THEN '' ELSE 'again ' END || 'ok:' || length(prompt)::VARCHAR AS response
FROM enrich_requests""", "enrich_requests")
register("standardize_specialties", f"""
SELECT unique_id, {_finish_sql(f"list_transform({_json_strings_sql('specialties')}, lambda t: {_SPEC_ONE})")}
  AS standardized_specialties FROM raw_terms""", "raw_terms")
register("standardize_services", f"""
SELECT unique_id, {_finish_sql(f"list_transform({_json_strings_sql('procedure')}, lambda t: {_SVC_ONE})")}
  AS standardized_services FROM raw_terms""", "raw_terms")
register("standardize_equipment", f"""
SELECT unique_id, {_finish_sql(f"list_transform({_json_strings_sql('equipment')}, lambda t: {_EQ_ONE})")}
  AS standardized_equipment FROM raw_terms""", "raw_terms")
cte("dictionary_rows", [], """
  SELECT lower(p_name) AS g, upper(p_name) || '|' || min(p_type) AS name, false AS excluded FROM part GROUP BY p_name
  UNION ALL
  SELECT DISTINCT lower(string_split(p_name, ' ')[-1]), upper(string_split(p_name, ' ')[-1]), string_split(p_name, ' ')[-1] = 'bolt' FROM part""")
cte("dictionary_terms", [], """
  SELECT p_partkey, unnest([0, 1, 2, 3]) AS pos, lower(unnest([p_name || ' unit', p_type, 'Spare ' || string_split(p_name, ' ')[-1], 'old ' || p_name])) AS term
  FROM part""")
cte("dictionary_matches", ["dictionary_rows", "dictionary_terms"], """
  SELECT p_partkey, pos, term, name, excluded, row_number() OVER (PARTITION BY p_partkey, pos ORDER BY
    len(string_split(g, ' ')) DESC NULLS LAST, instr(' ' || term || ' ', ' ' || g || ' '), g) AS rn
  FROM dictionary_terms LEFT JOIN dictionary_rows ON contains(' ' || term || ' ', ' ' || g || ' ')""")
cte("dictionary_names", ["dictionary_matches"], """
  SELECT p_partkey, coalesce(name, upper(term)) AS name, min(pos) AS pos FROM dictionary_matches
  WHERE rn = 1 AND NOT coalesce(excluded, false) GROUP BY ALL""")
register("standardize_dictionary", """
SELECT CAST(p_partkey AS VARCHAR) AS unique_id, coalesce(names, '[]') AS names
FROM part LEFT JOIN (SELECT p_partkey, to_json(list(name ORDER BY pos))::VARCHAR AS names FROM dictionary_names GROUP BY p_partkey) USING (p_partkey)""", "dictionary_names")
cte("enriched", ["raw_terms"], "SELECT a.*, b.standardized_services AS svc, c.standardized_equipment AS eq, CASE WHEN json_valid(r.capability) THEN r.capability END AS cap "
    "FROM (" + _FINAL["standardize_specialties"] + ") a JOIN (" + _FINAL["standardize_services"] + ") b USING (unique_id) JOIN ("
    + _FINAL["standardize_equipment"] + ") c USING (unique_id) JOIN raw_terms r USING (unique_id)")
register("enriched_index", """
SELECT i.* REPLACE (coalesce(e.standardized_specialties, i.specialties) AS specialties, e.svc AS standardized_services,
  e.eq AS standardized_equipment, e.cap AS parsed_capability)
FROM facility_index i LEFT JOIN enriched e USING (unique_id)""", "facility_index", "enriched")


def _enum_sql(x: str, allowed) -> str:
    return f"CASE WHEN {x} IN ({', '.join(q(a) for a in allowed)}) THEN {x} END"


register("capability_explode", f"""
SELECT unique_id, parse_ok, CAST(i - 1 AS INTEGER) AS cap_pos,
  json_extract_string(c, '$.capability_name') AS capability_name,
  {_enum_sql("json_extract_string(c, '$.category')", en.CAPABILITY_CATEGORY)} AS category,
  json_extract_string(c, '$.description') AS description,
  {_enum_sql("json_extract_string(c, '$.complexity_level')", en.COMPLEXITY)} AS complexity_level,
  CASE WHEN json_type(c, '$.ai_agent_tags') = 'ARRAY'
       THEN array_to_string(json_extract_string(c, '$.ai_agent_tags[*]'), ', ') END AS ai_agent_tags,
  json_extract_string(j, '$.primary_focus') AS primary_focus,
  {_enum_sql("json_extract_string(j, '$.specialization_level')", en.SPECIALIZATION)} AS specialization_level,
  substring(json_extract_string(j, '$.summary'), 1, {en.SUMMARY_CHARS}) AS summary
FROM (
  SELECT unique_id, parse_ok, j, i, cl[i] AS c FROM (
    SELECT unique_id, parse_ok, j, cl,
      unnest(CASE WHEN len(cl) > 0 THEN range(1, len(cl) + 1) ELSE [NULL::BIGINT] END) AS i
    FROM (SELECT unique_id, parse_ok, j,
            CASE WHEN json_type(j, '$.capabilities') = 'ARRAY' THEN json_extract(j, '$.capabilities[*]') END AS cl
          FROM (SELECT unique_id, coalesce(json_valid(capability), false) AS parse_ok,
                  CASE WHEN json_valid(capability) THEN capability::JSON END AS j FROM raw_terms))))""", "raw_terms")
