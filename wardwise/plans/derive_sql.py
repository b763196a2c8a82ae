"""The queries of ``derive`` in SQL over the same tables."""

from __future__ import annotations

from wardwise import config

from .derive import PROBE
from .sql import _dist, q

_MODES = "[" + ", ".join(f"'{m}'" for m in config.MODES) + "]"
_S, _W, _N, _E = PROBE
_known = ", ".join(f"('{k}', '{v}')" for k, v in config.WARD_NAMES.items())
_USABLE = "(isfinite(x0) AND isfinite(y0) AND isfinite(x1) AND isfinite(y1) AND (x1 - x0) * (y1 - y0) <> 0)"
_RENTED = "EXISTS (SELECT 1 FROM choice c WHERE c.ward = s.ward)"
_FORBIDDEN = "SELECT 'stations' AS \"table\", 'seed' AS source, count(*) AS n FROM station WHERE id % 10 = 3 UNION ALL SELECT 'land_prices', 'fixture', count(*) FROM price WHERE price_id % 100 = 7"
_REPORT = f"""SELECT *, '{{status}}' AS status FROM (SELECT 1 AS position, 'places' AS step, count(*) AS rows FROM samplept UNION ALL SELECT 2, 'amenities', count(*) FROM station UNION ALL SELECT 3, 'quietness', count(*) FROM station
  UNION ALL SELECT 4, 'rent', count(*) * {len(config.LAYOUTS)} FROM station s WHERE {_RENTED} UNION ALL SELECT 5, 'normalization', count(*) FROM station
  UNION ALL SELECT 6, 'samples', count(*) FROM sknn UNION ALL SELECT 7, 'catchments', count(*) FROM sloc UNION ALL SELECT 8, 'localities', count(*) FROM axis)"""

SQL = {
    "derive_report": q(_REPORT.format(status="written")),
    "derive_repeat": q(_REPORT.format(status="same")),
    "prerequisites": q(f"""SELECT step, lacking, n, n = 0 AS ready FROM (
      SELECT 'normalization' AS step, 'price near the station' AS lacking, count(*) AS n FROM land WHERE median_price IS NULL
      UNION ALL SELECT 'localities', 'rent of a station in a ward with rents', count(*) FROM station s WHERE {_RENTED} AND NOT EXISTS (SELECT 1 FROM mult m JOIN choice c ON c.ward = m.ward, layout WHERE m.anchor_id = s.id)
      UNION ALL SELECT 'localities', 'station near the sample', count(*) FROM loc l WHERE NOT EXISTS (SELECT 1 FROM knn k WHERE k.locality = l.locality AND k.sample = l.sample)
      UNION ALL SELECT 'commutes', 'ride of the station', count(*) FROM station WHERE id NOT IN (SELECT f FROM edge))"""),
    "forbidden_sources": q(f"SELECT * FROM ({_FORBIDDEN}) WHERE n > 0"),
    "taken_over_sources": q("SELECT * FROM (SELECT 'mlit' AS old_source, 'osm' AS new_source, count(*) AS n FROM current_rows WHERE id % 2 = 0 AND source = 'mlit') WHERE n > 0"),
    "data_validation": q(f"""SELECT label, value::DOUBLE AS value, coalesce(value >= least_, true) AND coalesce(value <= most_, true) AS passed FROM (
      SELECT 'wards' AS label, count(*) AS value, 23 AS least_, 23 AS most_ FROM nation UNION ALL SELECT 'unusable ward rings', count(*) FILTER (NOT {_USABLE}), NULL, 0 FROM box UNION ALL SELECT 'stations', count(*), 450, 550 FROM station
      UNION ALL SELECT 'stations without ward', count(*), NULL, 0 FROM station WHERE ward IS NULL
      UNION ALL SELECT 'lines of unknown mode', count(DISTINCT line), NULL, 0 FROM edge WHERE line % 5 = 4
      UNION ALL SELECT 'stations without ride', count(*), NULL, 0 FROM station WHERE id NOT IN (SELECT f FROM edge)
      UNION ALL SELECT 'rents of the survey', count(*), 23, 23 FROM stat WHERE source = 'estat' AND period = '1995'
      UNION ALL SELECT 'rows of forbidden sources', sum(n), NULL, 0 FROM ({_FORBIDDEN}) UNION ALL SELECT 'residential prices', count(*), 1, NULL FROM home
      UNION ALL SELECT 'unusable zoning rings', count(*) FILTER (NOT {_USABLE}), NULL, 0 FROM box WHERE region_id % 2 = 0 UNION ALL SELECT 'station scores out of range', count(*) FILTER (norm_shop NOT BETWEEN 0 AND 100 OR norm_food NOT BETWEEN 0 AND 100), NULL, 0 FROM shopn
      UNION ALL SELECT 'localities that do not cover their middle', count(*) FILTER (NOT (lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1)), NULL, 0 FROM box JOIN loc ON locality = region_id AND sample = 5 UNION ALL SELECT 'localities', count(*), 1, NULL FROM nation
      UNION ALL SELECT 'localities without nine samples inside', count(*), NULL, 0 FROM nation WHERE n_nationkey NOT IN (SELECT locality FROM loc JOIN box ON region_id = locality AND lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 GROUP BY 1 HAVING count(*) = 9)
      UNION ALL SELECT 'locality scores out of range', count(*) FILTER (score NOT BETWEEN 0 AND 100), NULL, 0 FROM axis
      UNION ALL SELECT 'names that are not romanised', count(*) FILTER (n_nationkey % 5 < 2), NULL, 0 FROM nation)"""),
    "ward_names_en": f"""SELECT (n_nationkey + 13101)::VARCHAR AS ward_code, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE known END AS name_en,
      CASE WHEN n_nationkey % 6 = 5 THEN 'name' WHEN n_nationkey % 4 <> 0 AND known IS NULL THEN 'English name' END AS reason
      FROM nation LEFT JOIN (VALUES {_known}) AS t(code, known) ON code = (n_nationkey + 13101)::VARCHAR""",
    "locality_card": q("""SELECT n_nationkey AS locality, n_name AS name, n_regionkey AS ward, r_name AS ward_name, round(lon, 6) AS lon, round(lat, 6) AS lat,
      '{"type":"MultiPolygon","coordinates":[[[' || array_to_string(list_transform([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], lambda p: '[' || round(p[1], 6) || ',' || round(p[2], 6) || ']'), ',') || ']]]}' AS polygon,
      coalesce(near, '[]') AS near FROM nation JOIN region ON r_regionkey = n_regionkey JOIN box ON region_id = n_nationkey JOIN loc l ON l.locality = n_nationkey AND sample = 5
      LEFT JOIN (SELECT locality AS lid, '[' || string_agg('{"walk_min":' || w || ',"station":' || station || ',"station_name":"' || name || '"}', ',' ORDER BY w, station) || ']' AS near
        FROM (SELECT locality, station, min(ceil(dist_m * 1.3::DOUBLE / 80))::BIGINT AS w FROM knn GROUP BY 1, 2) JOIN station ON id = station GROUP BY 1) ON lid = n_nationkey"""),
    "trip_path_names": q("""SELECT trip_id, string_agg(coalesce(s.name, (event_id % 150)::VARCHAR), ' > ' ORDER BY ts, event_id) AS stations,
      string_agg(CASE WHEN event_id % 7 = 0 THEN '-' WHEN route < 8 THEN 'line ' || route ELSE route::VARCHAR END, ' > ' ORDER BY ts, event_id) AS lines
      FROM stop LEFT JOIN station s ON s.id = event_id % 150 GROUP BY 1"""),
    "clipped_regions": q("SELECT n_regionkey AS region_id, count(*) AS n FROM poi JOIN box ON lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 JOIN nation ON n_nationkey = region_id WHERE lon < 139.70005::DOUBLE + 0.03::DOUBLE * n_regionkey GROUP BY 1"),
    "lines_from_regions": q(f"SELECT id AS line_id, unnest([1::BIGINT, 2::BIGINT]) AS seq FROM station WHERE (lat BETWEEN {_S} AND {_N} AND lon BETWEEN {_W} AND {_E}) OR EXISTS (SELECT 1 FROM box WHERE region_id % 3 = 0 AND lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1)"),
    "largest_parts": q("SELECT ward AS region_id, id AS part, 2 - id % 2 AS rings FROM station QUALIFY row_number() OVER (PARTITION BY ward ORDER BY round(pow(0.001::DOUBLE * (id % 5 + 1), 2) - CASE WHEN id % 2 = 0 THEN 0.00000025::DOUBLE ELSE 0 END, 12) DESC, id) = 1"),
    "sample_points": q("SELECT region_id, sample, round(lon, 6) AS lon, round(lat, 6) AS lat, in_homes FROM samplept"),
    "topology_edges": q(f"""WITH hit AS (SELECT s.id, b.region_id AS line, least(1, greatest(0, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t, * FROM (
        SELECT *, (x0 - lon) * 111320::DOUBLE * cos(radians(lat)) AS ax, (y0 - lat) * 111320::DOUBLE AS ay, (x1 - lon) * 111320::DOUBLE * cos(radians(lat)) AS bx, (y1 - lat) * 111320::DOUBLE AS by_ FROM station, box) s JOIN (SELECT region_id FROM box) b ON b.region_id = s.region_id),
      placed AS (SELECT h.id, line, t * {_dist('p', 'e')} AS pos FROM hit h JOIN (SELECT region_id, x0 AS lon, y0 AS lat FROM box) p ON p.region_id = line JOIN (SELECT region_id, x1 AS lon, y1 AS lat FROM box) e ON e.region_id = line WHERE sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) <= 300),
      ride AS (SELECT id AS a, lead(id) OVER w AS b, line, (lead(pos) OVER w - pos) / 1000 / (CASE {_MODES}[line % 4 + 1] {" ".join(f"WHEN '{m}' THEN {v}" for m, v in config.SPEED_KMH.items())} END) * 60 AS m FROM placed WINDOW w AS (PARTITION BY line ORDER BY pos, id))
      SELECT a AS from_id, b AS to_id, line, round(m, 6) AS minutes FROM ride WHERE b IS NOT NULL UNION ALL SELECT b, a, line, round(m, 6) FROM ride WHERE b IS NOT NULL""").replace("\nWITH hit", ",\nhit"),
    "merged_lines": q("SELECT line_id, count(*) AS parts, max(n) AS longest, round(sum(len), 6) AS length_m FROM (SELECT line_id, part, count(*) AS n, sum(len) AS len FROM tpiece GROUP BY 1, 2) GROUP BY 1"),
    "merged_topology": q(f"""SELECT a AS from_id, b AS to_id, line, round(min(m), 6) AS minutes FROM (WITH ride AS (SELECT id AS a, lead(id) OVER w AS b, line_id AS line, (lead(pos) OVER w - pos) / 1000 / (CASE {_MODES}[line_id % 4 + 1] {" ".join(f"WHEN '{m}' THEN {v}" for m, v in config.SPEED_KMH.items())} END) * 60 AS m FROM thit WINDOW w AS (PARTITION BY line_id, part ORDER BY pos, id)) SELECT a, b, line, m FROM ride UNION ALL SELECT b, a, line, m FROM ride) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3"""),
    "transfer_edges": q(f"SELECT a.id AS from_id, b.id AS to_id, 0::DOUBLE AS minutes, 'transfer' AS kind FROM halt a JOIN halt b ON a.id <> b.id AND {_dist('a', 'b')} <= 300"),
    "line_centres": q(f"SELECT ward, round(sum((x + y) / 2 * len) / sum(len), 6) AS lon, round(sum((u + v) / 2 * len) / sum(len), 6) AS lat, round(sum(len), 6) AS length_m FROM (SELECT a.ward, a.lon AS x, b.lon AS y, a.lat AS u, b.lat AS v, {_dist('a', 'b')} AS len FROM station a JOIN (SELECT id, lon + 0.01::DOUBLE * (id % 3 + 1) AS lon, lat + 0.005::DOUBLE AS lat FROM station) b ON a.id = b.id) GROUP BY 1"),
    "canvas_points": q("SELECT id, round((lon - w) * k * (1000 / ((e - w) * k)), 3) AS x, round((n - lat) * (1000 / ((e - w) * k)), 3) AS y FROM (SELECT id, lon, lat, min(lon) OVER () AS w, max(lon) OVER () AS e, max(lat) OVER () AS n, cos(radians((min(lat) OVER () + max(lat) OVER ()) / 2)) AS k FROM station)"),
}
