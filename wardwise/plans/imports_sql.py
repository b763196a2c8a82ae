"""The queries of ``imports`` in SQL: what must become of the rows."""

from __future__ import annotations

from .sql import q

_HAVERSINE = "2 * 6371000::DOUBLE * asin(least(1, sqrt(pow(cos(radians(s.lat)) * sin(radians(0.001::DOUBLE * (s.id % 5)) / 2), 2))))"
_TOWN = "upper(town[1]) || lower(town[2:])"

SQL = {
    "matched_stops": q(f"""SELECT 's' || p.id AS stop_id, m.station FROM station p JOIN (SELECT id, CASE WHEN id % 11 = 5 THEN id + 1 WHEN id % 7 <> 3 AND {_HAVERSINE} <= 300 THEN id END AS station FROM station s) m ON m.id = CASE WHEN p.id % 3 = 1 THEN p.id - 1 ELSE p.id END"""),
    "mapped_routes": q("SELECT CASE WHEN id % 4 = 0 THEN 'L' || id % 20 ELSE 'r' || id END AS route_id, CASE WHEN id % 4 < 3 THEN 'L' || id % 20 END AS line FROM station"),
    "resolved_names": f"""WITH t AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS town FROM customer)
      SELECT 'w' || n AS ward_ja, town AS town_ja, CASE WHEN n % 4 = 0 THEN {_TOWN} WHEN n % 4 = 1 THEN {_TOWN} || CASE WHEN n % 5 = 0 THEN '!' ELSE '' END WHEN n % 4 = 3 AND n % 3 = 0 THEN 'Own ' || {_TOWN} END AS town_en,
        CASE WHEN n % 4 = 2 THEN 'ambiguous' WHEN n % 4 = 3 AND n % 3 <> 0 THEN 'missing' WHEN n % 4 = 1 AND n % 5 = 0 THEN 'invalid' END AS problem FROM t
      UNION ALL SELECT 'nowhere', r_name, NULL, 'unused' FROM region""",
    "preferred_names": "SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 6 <> 0 OR p_name = p_brand) THEN p_name ELSE p_type END AS name, CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 6 <> 0 OR p_name = p_brand) THEN 'a' ELSE 'b' END AS source FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0",
    "cube_read": q("""SELECT (n_nationkey + 13101)::VARCHAR AS area, CASE WHEN n_nationkey % 8 <> 7 AND n_nationkey % 9 <> 4 THEN rent_per_sqm END AS rent, CASE WHEN s.ward IS NOT NULL AND n_nationkey % 8 <> 7 THEN CASE WHEN n_nationkey % 3 <> 0 THEN fee ELSE 0 END END AS fee,
      CASE WHEN s.ward IS NULL OR n_nationkey % 8 = 7 THEN 'missing' WHEN n_nationkey % 9 = 4 THEN 'value' END AS problem FROM nation LEFT JOIN (SELECT * FROM stat WHERE source = 'estat' AND period = '1995') s ON s.ward = n_nationkey"""),
    "zones": """SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 6 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'industrial' WHEN 3 THEN 'low-rise' END AS category,
      CASE WHEN n_nationkey % 12 = 1 THEN true WHEN n_nationkey % 6 IN (0, 3) THEN true WHEN n_nationkey % 6 IN (1, 2) THEN false END AS is_residential,
      CASE n_nationkey % 6 WHEN 4 THEN 'unknown category' WHEN 5 THEN 'no category' END AS reason FROM nation""",
    "rail_modes": """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 17 BETWEEN 13 AND 16 OR s_suppkey % 5 = 2 THEN 'monorail' WHEN s_suppkey % 5 IN (0, 3) THEN 'subway' WHEN s_suppkey % 7 IN (1, 2) OR s_suppkey % 5 = 1 THEN 'commuter_rail' ELSE 'local_rail' END AS mode,
      CASE WHEN s_suppkey % 4 = 3 THEN '商業地' ELSE 'residential' END AS use FROM supplier""",
    "name_keys": "SELECT s_suppkey AS id, lower(s_name) AS station, '霞ケ' || s_name AS ward, CASE greatest(s_suppkey % 3 - s_suppkey % 2, 0) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, '¥' || format('{:,}', s_suppkey * 1234) AS price FROM supplier",
    "price_tables": q("""SELECT ward, concat_ws(',', CASE WHEN NOT price > 0 THEN 'price' END, CASE WHEN use <> 'residential' THEN 'use' END, CASE WHEN NOT (lat BETWEEN 35.5 AND 35.82 AND lon BETWEEN 139.56 AND 139.92) THEN 'place' END) AS reasons, count(*) AS n FROM price GROUP BY 1, 2"""),
}
SQL["import_health"] = q(f"""SELECT label, bad, n, round(bad / n, 6) AS share, bad / n <= most AS passed FROM (
  SELECT 'unmatched stops' AS label, count(*) FILTER (station IS NULL) AS bad, count(*) AS n, 0.5 AS most FROM (SELECT p.id, m.station FROM station p JOIN (SELECT id, CASE WHEN id % 11 = 5 THEN id + 1 WHEN id % 7 <> 3 AND {_HAVERSINE} <= 300 THEN id END AS station FROM station s) m ON m.id = CASE WHEN p.id % 3 = 1 THEN p.id - 1 ELSE p.id END)
  UNION ALL SELECT 'stations without rides', count(*) FILTER (id NOT IN (SELECT f FROM edge)), count(*), 0.1 FROM halt
  UNION ALL SELECT 'rents without near prices', count(*) FILTER (NOT usable), count(*), 0.25 FROM mult)""")
