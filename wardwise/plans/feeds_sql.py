"""The queries of ``feeds`` in SQL: what must come back from the files."""

from __future__ import annotations

from .sql import _at, q

_CODE = "(s.ward + 13101)::VARCHAR"

SQL = {
    "stations_read": q("SELECT id::VARCHAR AS id, name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM station WHERE lat BETWEEN 35.5 AND 35.82 AND lon BETWEEN 139.56 AND 139.92"),
    "map_elements_read": q(f"""SELECT CASE WHEN id % 9 = 0 THEN 'unplaced' ELSE 'poi' END AS kind, id, category, CASE WHEN id % 9 <> 0 THEN round(lon, 6) END AS lon, CASE WHEN id % 9 <> 0 THEN round(lat, 6) END AS lat FROM (
        SELECT c_custkey AS id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'supermarket' WHEN 'BUILDING' THEN 'grocery' WHEN 'MACHINERY' THEN 'cafe' WHEN 'HOUSEHOLD' THEN 'health' END AS category, {_at('c_custkey')} FROM customer) WHERE category IS NOT NULL
      UNION ALL SELECT 'road', region_id, 'primary', round(x1, 6), round(y1, 6) FROM box UNION ALL SELECT 'green', region_id, 'park', round(x1, 6), round(y1, 6) FROM box"""),
    "rents_read": q(f"""SELECT CASE WHEN s.ward % 3 <> 0 OR s.ward % 6 <> 3 THEN {_CODE} END AS ward_code, CASE WHEN s.ward % 6 <> 3 THEN n_name ELSE 'elsewhere' END AS area, period || 'Q' || s.ward % 5 AS period, round(rent_per_sqm, 6) AS rent, round(fee, 6) AS fee,
      CASE WHEN s.ward % 5 = 0 THEN 'period' WHEN s.ward % 6 = 3 THEN 'ward' WHEN rent_per_sqm NOT BETWEEN 1000 AND 20000 THEN 'rent' WHEN fee NOT BETWEEN 0 AND 50000 THEN 'fee' END AS reason FROM stat s JOIN nation ON n_nationkey = s.ward WHERE source = 'reins'"""),
    "feed_read": q("SELECT trip_id, stop, seq, round(m, 6) AS arrival FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ts, event_id) AS seq FROM stop) WHERE split_part(trip_id, '-', 1)::BIGINT % 3 <> 1"),
}
