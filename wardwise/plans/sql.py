"""The registered queries in SQL over the same tables."""

from __future__ import annotations

from wardwise import config

from .adapters import HOMES, REQUESTS

YEAR = 2003
_LON = "139.56::DOUBLE + (({k} * 7919) % 3600) / 10000::DOUBLE"
_LAT = "35.50::DOUBLE + (({k} * 104729) % 3200) / 10000::DOUBLE"


def _at(k: str) -> str:
    return f"{_LON.format(k=k)} AS lon, {_LAT.format(k=k)} AS lat"


def _metres(x1: str, y1: str, x2: str, y2: str) -> str:
    """Metres on the spheroid between two points."""
    m = f"radians(({y1} + {y2}) / 2)"
    w = f"(1 - 0.0066943799901413165::DOUBLE * pow(sin({m}), 2))"
    n = f"(6378137::DOUBLE * (1 - 0.0066943799901413165::DOUBLE)) / pow({w}, 1.5) * radians({y2} - {y1})"
    e = f"6378137::DOUBLE / sqrt({w}) * cos({m}) * radians({x2} - {x1})"
    return f"sqrt(pow({n}, 2) + pow({e}, 2))"


def _dist(a: str, b: str) -> str:
    """The same between two aliases with lon and lat."""
    return _metres(f"{a}.lon", f"{a}.lat", f"{b}.lon", f"{b}.lat")


def _pick(pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {other} END"


VIEWS = {
    "station": f"SELECT s_suppkey AS id, s_name AS name, s_nationkey AS ward, {_at('s_suppkey')} FROM supplier",
    "halt": "SELECT id, name, lon, lat FROM station UNION ALL SELECT id + 1000000, name || ' halt', lon + 0.0011::DOUBLE, lat + 0.0012::DOUBLE * (1 + id % 3) FROM station WHERE id % 7 = 2",
    "poi": f"""SELECT 'c' || c_custkey AS poi_id, c_name AS name,
        CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'supermarket' WHEN 'BUILDING' THEN 'convenience' WHEN 'FURNITURE' THEN 'bar' WHEN 'MACHINERY' THEN 'cafe' ELSE 'health' END AS category,
        NULL::VARCHAR AS cuisine, NULL::VARCHAR AS opening_hours, {_at('c_custkey')} FROM customer
      UNION ALL SELECT 'p' || p_partkey, p_name, CASE WHEN p_size % 5 = 0 THEN 'grocery' ELSE 'restaurant' END, p_brand,
        CASE p_size % 4 WHEN 0 THEN '24/7' WHEN 1 THEN 'Mo-Su 10:00-23:30' WHEN 2 THEN 'Mo-Fri 09:00-18:00; Sa off' END, {_at('(p_partkey + 7)')} FROM part""",
    "late": "SELECT *, (category IN ('restaurant', 'cafe', 'bar')) AS food, NOT regexp_matches(opening_hours, '(?i)\\boff\\b') AND (opening_hours = '24/7' OR regexp_matches(opening_hours, '-2[3-9]:[0-5][0-9]')) AS late FROM poi",
    "near_poi": f"SELECT s.id AS anchor_id, p.* FROM station s JOIN late p ON {_dist('s', 'p')} <= 800",
    "counts": """SELECT s.id AS anchor_id, s.name, count(*) FILTER (category = 'supermarket') AS n_supermarket, count(*) FILTER (category = 'grocery') AS n_grocery, count(*) FILTER (category = 'convenience') AS n_convenience,
        count(*) FILTER (category = 'restaurant') AS n_restaurant, count(*) FILTER (category = 'cafe') AS n_cafe, count(*) FILTER (category = 'bar') AS n_bar, count(*) FILTER (category = 'health') AS n_health,
        count(DISTINCT CASE WHEN food THEN cuisine END) AS n_cuisines, count(*) FILTER (food AND late) AS n_late
      FROM station s LEFT JOIN near_poi p ON p.anchor_id = s.id GROUP BY s.id, s.name""",
    "shop": "SELECT *, n_supermarket * 1.0::DOUBLE + n_grocery * 0.5::DOUBLE + n_convenience * 0.25::DOUBLE AS shop, (n_restaurant + n_cafe)::DOUBLE AS food FROM counts",
    "shopn": "SELECT *, CASE WHEN max(shop) OVER () = min(shop) OVER () THEN 50 ELSE 100 * (shop - min(shop) OVER ()) / (max(shop) OVER () - min(shop) OVER ()) END AS norm_shop, CASE WHEN max(food) OVER () = min(food) OVER () THEN 50 ELSE 100 * (food - min(food) OVER ()) / (max(food) OVER () - min(food) OVER ()) END AS norm_food FROM shop",
    "ward": "SELECT n_nationkey AS region_id, 139.56::DOUBLE + 0.072::DOUBLE * (n_nationkey % 5) AS x0, 35.50::DOUBLE + 0.064::DOUBLE * (n_nationkey // 5) AS y0 FROM nation",
    "box": "SELECT *, x0 + 0.072::DOUBLE AS x1, y0 + 0.064::DOUBLE AS y1 FROM ward",
    "lattice": """SELECT id AS anchor_id, i, lat + sqrt((i + 0.5::DOUBLE) / 1024) * sin(i * 2.399963229728653::DOUBLE) * (800 / 111320::DOUBLE) AS plat,
        lon + sqrt((i + 0.5::DOUBLE) / 1024) * cos(i * 2.399963229728653::DOUBLE) * (800 / 111320::DOUBLE) / cos(radians(lat)) AS plon FROM station, range(1024) AS r(i)""",
    "covered": "SELECT id AS anchor_id, coalesce(n, 0) / 1024::DOUBLE AS share FROM station LEFT JOIN (SELECT anchor_id, count(DISTINCT i) AS n FROM lattice, box WHERE region_id % 2 = 0 AND plon >= x0 AND plon < x1 AND plat >= y0 AND plat < y1 GROUP BY 1) ON anchor_id = id",
    "ldist": """SELECT anchor_id, i, region_id, (x0 - plon) * 111320::DOUBLE * cos(radians(plat)) AS ax, (y0 - plat) * 111320::DOUBLE AS ay, (x1 - plon) * 111320::DOUBLE * cos(radians(plat)) AS bx, (y1 - plat) * 111320::DOUBLE AS by_ FROM lattice JOIN box ON x0 - 0.01 < plon AND plon < x1 + 0.01 AND y0 - 0.01 < plat AND plat < y1 + 0.01""",
    "island": " UNION ALL ".join(f"SELECT region_id, '{g}' AS piece, x0 + {a}::DOUBLE AS a0, y0 + {b}::DOUBLE AS b0, x0 + {c}::DOUBLE AS a1, y0 + {e}::DOUBLE AS b1 FROM ward WHERE region_id % 8 = {m}" for m, boxes in HOMES.items() for g, a, b, c, e in boxes),
    "bound0": "SELECT region_id, min(a0) AS w, min(b0) AS s, max(a1) AS e, max(b1) AS t FROM island GROUP BY 1",
    "cell0": "SELECT b.*, gx, gy, piece FROM bound0 b, range(32) AS u(gx), range(32) AS v(gy), island i WHERE i.region_id = b.region_id AND w + (e - w) * (gx + 0.5::DOUBLE) / 32 BETWEEN a0 AND a1 AND s + (t - s) * (gy + 0.5::DOUBLE) / 32 BETWEEN b0 AND b1",
    "piece0": "SELECT region_id, w, s, e, t, piece, greatest(0, min(gx) - 1) AS p, least(32, max(gx) + 2) AS q, greatest(0, min(gy) - 1) AS u, least(32, max(gy) + 2) AS v FROM cell0 GROUP BY 1, 2, 3, 4, 5, 6 QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY count(DISTINCT gx * 32 + gy) DESC, min(gx * 32 + gy)) = 1",
    "bound1": "SELECT region_id, w + (e - w) * p / 32 AS w, s + (t - s) * u / 32 AS s, w + (e - w) * q / 32 AS e, s + (t - s) * v / 32 AS t FROM piece0",
    "cell1": """SELECT DISTINCT b.region_id, gx, gy, piece, w + (e - w) * (gx + 0.5::DOUBLE) / 32 AS lon, s + (t - s) * (gy + 0.5::DOUBLE) / 32 AS lat, true AS in_homes FROM bound1 b, range(32) AS u(gx), range(32) AS v(gy), island i WHERE i.region_id = b.region_id AND w + (e - w) * (gx + 0.5::DOUBLE) / 32 BETWEEN a0 AND a1 AND s + (t - s) * (gy + 0.5::DOUBLE) / 32 BETWEEN b0 AND b1
      UNION ALL SELECT region_id, gx, gy, '', x0 + (x1 - x0) * (gx + 0.5::DOUBLE) / 32, y0 + (y1 - y0) * (gy + 0.5::DOUBLE) / 32, false FROM box, range(32) AS u(gx), range(32) AS v(gy) WHERE region_id NOT IN (SELECT region_id FROM island)""",
    "zcell": "SELECT *, count(*) OVER (PARTITION BY region_id) AS m, row_number() OVER (PARTITION BY region_id ORDER BY " + " + ".join(f"(((gx >> {b}) & 1) << {2 * b}) + (((gy >> {b}) & 1) << {2 * b + 1})" for b in range(5)) + ") - 1 AS r FROM cell1 WHERE (region_id, piece) IN (SELECT region_id, first(piece ORDER BY n DESC, f) FROM (SELECT region_id, piece, count(*) AS n, min(gx * 32 + gy) AS f FROM cell1 GROUP BY 1, 2) GROUP BY 1)",
    "samplept": "SELECT region_id, row_number() OVER (PARTITION BY region_id ORDER BY lon, lat) AS sample, lon, lat, in_homes FROM zcell WHERE list_contains(list_transform(range(9), lambda k: (2 * k + 1) * m // 18), r)",
    "track": """SELECT a.id AS k, a.id // 20 AS line_id, CASE WHEN (a.id // 20) % 3 = 1 AND a.id % 20 >= 6 THEN 2 ELSE 1 END AS part, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by_ FROM station a JOIN station b ON b.id = a.id + 1 WHERE a.id % 20 <> 19
      UNION ALL SELECT id + 1000000, id // 20, 3, lon, lat, lon + 0.0101::DOUBLE, lat + 0.0132::DOUBLE FROM station WHERE id % 20 = 6 AND (id // 20) % 3 = 1""",
    "tpiece": f"""SELECT *, {_metres("x1", "y1", "x2", "y2")} AS len FROM (SELECT line_id, part, 2 * k AS seq, ax AS x1, ay AS y1, CASE WHEN k % 4 = 0 THEN (ax + bx) / 2 ELSE bx END AS x2, CASE WHEN k % 4 = 0 THEN (ay + by_) / 2 ELSE by_ END AS y2 FROM track
      UNION ALL SELECT line_id, part, 2 * k + 1, (ax + bx) / 2, (ay + by_) / 2, bx, by_ FROM track WHERE k % 4 = 0)""",
    "tpos": "SELECT *, coalesce(sum(len) OVER (PARTITION BY line_id, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tpiece",
    "thit": """SELECT line_id, part, id, first(before + t * len ORDER BY d, seq) AS pos FROM (SELECT *, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) AS d FROM (
      SELECT *, least(1, greatest(0, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM (
      SELECT *, (x1 - lon) * 111320::DOUBLE * cos(radians(lat)) AS ax, (y1 - lat) * 111320::DOUBLE AS ay, (x2 - lon) * 111320::DOUBLE * cos(radians(lat)) AS bx, (y2 - lat) * 111320::DOUBLE AS by_ FROM station, tpos))) WHERE d <= 300 GROUP BY 1, 2, 3""",
    "sloc": "SELECT region_id AS locality, sample, lon, lat FROM samplept",
    "lined": "SELECT *, least(1, greatest(0, -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM ldist",
    "exposed": "SELECT id AS anchor_id, coalesce(n, 0) / 1024::DOUBLE AS share FROM station LEFT JOIN (SELECT anchor_id, count(DISTINCT i) AS n FROM lined WHERE sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) <= 100 GROUP BY 1) ON anchor_id = id",
    "price": f"""SELECT o_orderkey AS price_id, c_nationkey AS ward, {_at('o_orderkey')}, o_totalprice AS price, year(o_orderdate) AS year,
        CASE o_orderstatus WHEN 'O' THEN 'residential' WHEN 'F' THEN 'commercial' ELSE 'industrial' END AS use FROM orders JOIN customer ON c_custkey = o_custkey""",
    "home": "SELECT * FROM price WHERE use = 'residential'",
    "land": f"SELECT s.id AS anchor_id, s.ward, quantile_cont(h.price, 0.5) AS median_price, count(h.price) AS points, max(h.year) AS newest, min(h.year) AS oldest FROM station s LEFT JOIN home h ON {_dist('s', 'h')} <= 800 GROUP BY 1, 2",
    "wland": "SELECT ward, quantile_cont(price, 0.5) AS median_price, count(*) AS points FROM home GROUP BY 1",
    "mult": "SELECT l.anchor_id, l.ward, coalesce(l.points >= 3 AND l.median_price > 0 AND w.median_price > 0, false) AS usable, CASE WHEN coalesce(l.points >= 3 AND l.median_price > 0 AND w.median_price > 0, false) THEN least(1.15, greatest(0.85, pow(round(l.median_price, 6) / round(w.median_price, 6), 0.25)))::DOUBLE ELSE 1::DOUBLE END AS multiplier FROM land l LEFT JOIN wland w ON w.ward = l.ward",
    "loc": "SELECT n_nationkey AS locality, s + 1 AS sample, 139.56::DOUBLE + 0.072::DOUBLE * (n_nationkey % 5) + 0.036::DOUBLE + (s % 3 - 1) * 0.02::DOUBLE AS lon, 35.50::DOUBLE + 0.064::DOUBLE * (n_nationkey // 5) + 0.032::DOUBLE + (s // 3 - 1) * 0.02::DOUBLE AS lat FROM nation, range(9) AS r(s)",
    "inner_median": f"SELECT locality, sample, quantile_cont(price, 0.5) AS m, count(price) AS n FROM loc l JOIN home h ON {_dist('l', 'h')} <= 1500 GROUP BY 1, 2",
    "two": "SELECT locality, round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median_count FROM inner_median GROUP BY 1",
    "knn": f"SELECT * FROM (SELECT locality, sample, s.id AS station, round({_dist('l', 's')}, 3) AS dist_m, row_number() OVER (PARTITION BY locality, sample ORDER BY pow(l.lat - s.lat, 2) + pow(l.lon - s.lon, 2), s.id) AS rank FROM loc l JOIN station s ON {_dist('l', 's')} <= 1500) WHERE rank <= 3",
    "sknn": f"SELECT * FROM (SELECT locality, sample, s.id AS station, round({_dist('l', 's')}, 3) AS dist_m, row_number() OVER (PARTITION BY locality, sample ORDER BY pow(l.lat - s.lat, 2) + pow(l.lon - s.lon, 2), s.id) AS rank FROM sloc l JOIN station s ON {_dist('l', 's')} <= 1500) WHERE rank <= 3",
    "run": "SELECT event_id, event_type AS source, ts AS started_at, CASE WHEN (props->>'$.k')::BIGINT % 3 = 0 THEN 'failed' ELSE 'success' END AS status, value AS rows FROM events",
    "stat": "SELECT ward, source, period, 1000 + (floor(avg(o_totalprice))::BIGINT % 19000)::DOUBLE AS rent_per_sqm, (count(*) % 20000)::DOUBLE AS fee FROM (SELECT c_nationkey AS ward, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'reins' ELSE 'estat' END AS source, year(o_orderdate)::VARCHAR AS period, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey) GROUP BY 1, 2, 3",
    "choice": f"SELECT * EXCLUDE (r), CASE WHEN source = 'reins' THEN 2 WHEN {YEAR} - left(period, 4)::INT > 5 THEN 0 ELSE 1 END AS base_confidence FROM (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY source = 'reins' DESC, period DESC) AS r FROM stat WHERE source = 'estat' OR {YEAR} - left(period, 4)::INT <= 2) WHERE r = 1",
    "layout": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in config.LAYOUTS.items()) + ") AS t(layout, lo, hi, mid)",
    "stop": "SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS trip_id, user_id % 10 AS route, event_type AS stop, ts, event_id, hour(ts) * 60::DOUBLE + minute(ts) + second(ts) / 60::DOUBLE AS m FROM events",
    "leg": "SELECT *, lead(stop) OVER w AS next_stop, lead(m) OVER w - m AS minutes, first(stop) OVER w AS first_stop, CASE WHEN m >= 450 AND m < 600 THEN 'peak' ELSE 'offpeak' END AS period, row_number() OVER w AS seq FROM stop WINDOW w AS (PARTITION BY trip_id ORDER BY ts, event_id)",
    "pair": "SELECT route, first_stop, stop, next_stop, period, quantile_cont(minutes, 0.5) AS median_minutes, count(*) AS n FROM leg WHERE next_stop <> stop AND minutes >= 0 GROUP BY ALL",
    "gap": "SELECT route, first_stop, period, count(*) AS n, CASE WHEN count(*) >= 2 THEN (max(m) - min(m)) / (count(*) - 1) END AS headway FROM leg WHERE seq = 1 GROUP BY ALL",
    "edge0": "SELECT id AS a, (id + 1) % (SELECT count(*) FROM supplier) AS b, id // 20 AS line FROM station UNION ALL SELECT id, (id * 7 + 3) % (SELECT count(*) FROM supplier), 1000 + id % 3 FROM station",
    "edge1": "SELECT a, b, line, floor(1::DOUBLE + 100::DOUBLE * (abs(x.lon - y.lon) + abs(x.lat - y.lat))) AS m FROM edge0 JOIN station x ON x.id = a JOIN station y ON y.id = b WHERE a <> b",
    "edge": "SELECT a AS f, b AS t, line, min(m) AS m, CASE WHEN line % 4 > 0 THEN line % 4 ELSE 4 END::DOUBLE AS wait FROM (SELECT a, b, line, m FROM edge1 UNION ALL SELECT b, a, line, m FROM edge1) GROUP BY 1, 2, 3",
    "best": "SELECT dest, node, min(total) AS total FROM s GROUP BY 1, 2",
    "transit": "SELECT locality, sample, dest, min(total + ceil(dist_m * 1.3::DOUBLE / 80)) AS minutes FROM knn JOIN best ON node = station GROUP BY 1, 2, 3",
    "via": "SELECT locality, sample, dest, station, total + ceil(dist_m * 1.3::DOUBLE / 80) AS minutes FROM knn JOIN best ON node = station QUALIFY row_number() OVER (PARTITION BY locality, sample, dest ORDER BY minutes, station) = 1",
    "middle": "SELECT locality, dest, station FROM (SELECT *, row_number() OVER (PARTITION BY locality, dest ORDER BY minutes, sample) AS r, count(*) OVER (PARTITION BY locality, dest) AS n FROM via) WHERE r = n // 2 + 1",
    "commute": "SELECT locality, dest, max(minutes) FILTER (r = n // 2 + 1) AS minutes, quantile_cont(minutes, 0.25) AS low, quantile_cont(minutes, 0.75) AS high FROM (SELECT *, row_number() OVER (PARTITION BY locality, dest ORDER BY minutes, sample) AS r, count(*) OVER (PARTITION BY locality, dest) AS n FROM transit) GROUP BY 1, 2",
    "sample_counts": f"""SELECT locality, sample, count(*) FILTER (category = 'supermarket') + 0.5 * count(*) FILTER (category = 'grocery') + 0.25 * count(*) FILTER (category = 'convenience') AS supermarkets,
        count(*) FILTER (category IN ('restaurant', 'cafe')) AS restaurants, count(*) FILTER (category = 'convenience') AS konbini, count(DISTINCT CASE WHEN food THEN cuisine END) AS cuisine_variety, count(*) FILTER (food AND late) AS late_night, count(*) FILTER (category = 'health') AS health, count(*) FILTER (category = 'bar') AS bars
      FROM (SELECT l.locality, l.sample, p.* FROM sloc l LEFT JOIN late p ON {_dist('l', 'p')} <= 800) GROUP BY 1, 2""",
    "medians": "SELECT locality, " + ", ".join(f"quantile_cont({k}::DOUBLE, 0.5) AS {k}" for k in ("supermarkets", "restaurants", "konbini", "cuisine_variety", "late_night", "health", "bars")) + " FROM sample_counts GROUP BY 1",
    "slattice": """SELECT locality, sample, i, lat + sqrt((i + 0.5::DOUBLE) / 1024) * sin(i * 2.399963229728653::DOUBLE) * (800 / 111320::DOUBLE) AS plat,
        lon + sqrt((i + 0.5::DOUBLE) / 1024) * cos(i * 2.399963229728653::DOUBLE) * (800 / 111320::DOUBLE) / cos(radians(lat)) AS plon FROM sloc, range(1024) AS r(i)""",
    "sldist": "SELECT locality, sample, i, (x0 - plon) * 111320::DOUBLE * cos(radians(plat)) AS ax, (y0 - plat) * 111320::DOUBLE AS ay, (x1 - plon) * 111320::DOUBLE * cos(radians(plat)) AS bx, (y1 - plat) * 111320::DOUBLE AS by_ FROM slattice JOIN box ON x0 - 0.01 < plon AND plon < x1 + 0.01 AND y0 - 0.01 < plat AND plat < y1 + 0.01",
    "slined": "SELECT *, least(1, greatest(0, -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM sldist",
    "sresidential": "SELECT locality, sample, count(DISTINCT i) AS n FROM slattice JOIN box ON plon >= x0 AND plon < x1 AND plat >= y0 AND plat < y1 WHERE region_id % 2 = 0 GROUP BY 1, 2",
    "sgreen": "SELECT locality, sample, count(DISTINCT i) AS n FROM slattice JOIN box ON plon >= x0 AND plon < x1 AND plat >= y0 AND plat < y1 WHERE region_id % 3 = 0 GROUP BY 1, 2",
    "sexposed": "SELECT locality, sample, count(DISTINCT i) AS n FROM slined WHERE sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) <= 100 GROUP BY 1, 2",
    "lshare": """SELECT l.locality, quantile_cont(coalesce(r.n, 0) / 1024::DOUBLE, 0.5) AS residential, quantile_cont(coalesce(e.n, 0) / 1024::DOUBLE, 0.5) AS exposure, quantile_cont(coalesce(g.n, 0) / 1024::DOUBLE, 0.5) AS green
      FROM sloc l LEFT JOIN sresidential r ON r.locality = l.locality AND r.sample = l.sample LEFT JOIN sexposed e ON e.locality = l.locality AND e.sample = l.sample LEFT JOIN sgreen g ON g.locality = l.locality AND g.sample = l.sample GROUP BY 1""",
    "axis": " UNION ALL ".join(f"SELECT locality, '{k}' AS axis, least(100, 100 * ln(1 + {k}) / ln(1 + {config.TARGETS[k]}::DOUBLE)) AS score FROM medians" for k in ("supermarkets", "restaurants", "konbini", "cuisine_variety", "late_night", "health"))
    + " UNION ALL SELECT locality, 'quietness', 100 * (0.5 * residential + 0.3 * (1 - exposure) + 0.2 * (1 - least(1, ln(1 + bars) / ln(7::DOUBLE)))) FROM medians JOIN lshare USING (locality) UNION ALL SELECT locality, 'green_space', least(100, 100 * ln(1 + green) / ln(1.15::DOUBLE)) FROM lshare",
    "request": "SELECT * FROM (VALUES " + ", ".join(f"({r}, {t}, {c}, {b}, '{lay}')" for r, t, c, b, lay, _ in REQUESTS) + ") AS t(request_id, dest, max_commute, budget, layout)",
    "preference": "SELECT * FROM (VALUES " + ", ".join(f"({r}, '{a}', {config.IMPORTANCE[i]})" for r, *_, p in REQUESTS for a, i in p.items()) + ") AS t(request_id, axis, v)",
    "lmult": "SELECT n_nationkey AS locality, CASE WHEN coalesce(median_count >= 3 AND median > 0 AND median_price > 0, false) THEN least(1.15, greatest(0.85, pow(median / round(median_price, 6), 0.25)))::DOUBLE ELSE 1::DOUBLE END AS multiplier FROM nation LEFT JOIN two ON two.locality = n_nationkey LEFT JOIN wland ON wland.ward = n_nationkey",
    "lrent": "SELECT locality, layout, floor(rent_per_sqm * mid * multiplier + fee + 0.5)::BIGINT AS rent FROM lmult JOIN choice ON ward = locality, layout",
    "candidate": "SELECT r.request_id, l.locality, l.rent, c.minutes AS commute, r.budget::DOUBLE AS budget, r.max_commute::DOUBLE AS max_commute, CASE WHEN c.minutes IS NULL THEN 'disconnected' WHEN c.minutes > max_commute THEN 'commute' WHEN rent > budget THEN 'rent' END AS reason FROM request r JOIN lrent l ON l.layout = r.layout LEFT JOIN commute c ON c.locality = l.locality AND c.dest = r.dest",
    "diag": "SELECT request_id, count(*) AS considered, count(*) FILTER (reason = 'disconnected') AS excluded_disconnected, count(*) FILTER (reason = 'commute') AS excluded_commute, count(*) FILTER (reason = 'rent') AS excluded_rent, count(*) FILTER (reason IS NULL) AS feasible, quantile_cont(commute, 0.25) FILTER (reason = 'commute') AS qc, quantile_cont(rent, 0.25) FILTER (reason = 'rent') AS qr FROM candidate GROUP BY 1",
    "feasible": "SELECT * FROM candidate WHERE reason IS NULL",
    "factor0": """SELECT request_id, locality, 'affordability' AS key, CASE WHEN rent <= budget * 0.8::DOUBLE THEN 100 WHEN rent >= budget THEN 0 ELSE 100 * (budget - rent) / (budget - budget * 0.8::DOUBLE) END::DOUBLE AS component, 0.3::DOUBLE AS weight FROM feasible
      UNION ALL SELECT request_id, locality, 'commute', CASE WHEN commute <= 15 THEN 100 WHEN commute >= max_commute THEN 0 ELSE 100 * (max_commute - commute) / (max_commute - 15) END::DOUBLE, 0.3::DOUBLE FROM feasible
      UNION ALL SELECT f.request_id, f.locality, p.axis, a.score, 0.4::DOUBLE * (p.v / sum(p.v) OVER (PARTITION BY f.request_id, f.locality)) FROM feasible f JOIN preference p ON p.request_id = f.request_id JOIN axis a ON a.locality = f.locality AND a.axis = p.axis""",
    "factor": "SELECT *, floor(component * weight * 10 + 0.5) / 10 AS points, CASE WHEN component > 66 THEN 'positive' WHEN component < 34 THEN 'negative' ELSE 'neutral' END AS direction FROM factor0",
    "short": "SELECT * FROM (SELECT f.request_id, f.locality, overall, commute, rent, row_number() OVER (PARTITION BY f.request_id ORDER BY overall DESC, commute, rent, f.locality) AS rank FROM feasible f JOIN (SELECT request_id, locality, least(100, floor(round(sum(points), 6) * 10 + 0.5) / 10) AS overall FROM factor GROUP BY 1, 2) s ON s.request_id = f.request_id AND s.locality = f.locality) WHERE rank <= 20",
    "place": "SELECT 'p' || p_partkey AS place_id, 'poi' AS kind, p_name AS name, [p_brand, p_type] AS aliases FROM part UNION ALL SELECT 's' || s_suppkey, 'station', s_name, []::VARCHAR[] FROM supplier",
    "current_rows": "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'osm' ELSE 'mlit' END AS source, p_size AS v FROM part WHERE p_partkey % 3 <> 0",
    "incoming": "SELECT p_partkey AS id, 'osm' AS source, p_size + 100 AS v FROM part WHERE p_partkey % 2 = 0 AND p_size % 2 = 0",
}
_MATRIX = """s(dest, node, line, total) USING KEY (dest, node, line) AS (
    SELECT id, id, -1::BIGINT, 0::DOUBLE FROM station WHERE id IN (0, 25, 50, 75)
    UNION SELECT dest, node, line, min(total) FROM (
      SELECT s.dest, e.f AS node, e.line::BIGINT AS line, s.total + e.m + CASE WHEN s.line = e.line THEN 0 ELSE e.wait + CASE WHEN s.line = -1 THEN 0 ELSE 5 END END AS total FROM s JOIN edge e ON e.t = s.node) n
    WHERE NOT EXISTS (SELECT 1 FROM recurring.s r WHERE r.dest = n.dest AND r.node = n.node AND r.line = n.line AND r.total <= n.total) GROUP BY 1, 2, 3)"""
#: States with time, changes and hops as one number; and where each goes on to.
_LABELS = """lab(dest, node, line, label) USING KEY (dest, node, line) AS (
    SELECT id, id, -1::BIGINT, 0::BIGINT FROM station WHERE id IN (0, 25, 50, 75)
    UNION SELECT dest, node, line, min(label) FROM (
      SELECT lab.dest, e.f AS node, e.line::BIGINT AS line, lab.label + ((e.m + CASE WHEN lab.line = e.line THEN 0 ELSE e.wait + CASE WHEN lab.line = -1 THEN 0 ELSE 5 END END) * 1000000 + CASE WHEN lab.line NOT IN (-1, e.line) THEN 1001 ELSE 1 END)::BIGINT AS label FROM lab JOIN edge e ON e.t = lab.node) n
    WHERE NOT EXISTS (SELECT 1 FROM recurring.lab r WHERE r.dest = n.dest AND r.node = n.node AND r.line = n.line AND r.label <= n.label) GROUP BY 1, 2, 3)"""
VIEWS["onward"] = """SELECT * FROM (SELECT n.dest, n.node, n.line, e.t AS next_node, p.line AS next_line, e.m AS minutes, CASE WHEN p.line = e.line THEN 0 ELSE e.wait END AS board, CASE WHEN e.line >= 1000 THEN 1 ELSE 2 END AS sure, row_number() OVER (PARTITION BY n.dest, n.node, n.line ORDER BY e.t, p.line) AS r
    FROM lab n JOIN edge e ON e.f = n.node AND e.line = n.line JOIN lab p ON p.dest = n.dest AND p.node = e.t AND n.label = p.label + ((e.m + CASE WHEN p.line = e.line THEN 0 ELSE e.wait + CASE WHEN p.line = -1 THEN 0 ELSE 5 END END) * 1000000 + CASE WHEN p.line NOT IN (-1, e.line) THEN 1001 ELSE 1 END)::BIGINT) WHERE r = 1"""
VIEWS["bestlab"] = "SELECT * FROM lab QUALIFY row_number() OVER (PARTITION BY dest, node ORDER BY label // 1000, line) = 1"
#: Every best way of a station, hop by hop: place 0 is the station itself.
_WALK = """(WITH RECURSIVE walk AS (SELECT dest, node AS start, line AS start_line, 0 AS pos, node, line, NULL::BIGINT AS via FROM {chosen}
    UNION ALL SELECT w.dest, w.start, w.start_line, w.pos + 1, o.next_node, o.next_line, w.line FROM walk w JOIN onward o ON o.dest = w.dest AND o.node = w.node AND o.line = w.line) SELECT w.*, st.name AS station_name, CASE WHEN via < 1000 THEN 'line ' || via ELSE via::VARCHAR END AS line_name FROM walk w LEFT JOIN station st ON st.id = w.node)"""
_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIM = "coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


def _sim(x: str, y: str) -> str:
    return _SIM.format(a=_GRAMS.format(x=x), b=_GRAMS.format(x=y))


VIEWS["fedge"] = "SELECT f, t, line, m, CASE WHEN line % 4 > 0 THEN line % 4 ELSE 4 END::DOUBLE AS wait, (f * 31 + t * 17 + line) % 23 AS k FROM edge"
_FAULTY = """fs(dest, node, line, total) USING KEY (dest, node, line) AS (
    SELECT id, id, -1::BIGINT, 2::DOUBLE FROM station WHERE id % 20 = 0 AND id % 13 NOT IN (1, 2, 3, 4, 5)
    UNION SELECT dest, node, line, min(total) FROM (
      SELECT fs.dest, e.f AS node, CASE WHEN k IN (6, 7) THEN -1 ELSE e.line END::BIGINT AS line, fs.total + e.m + CASE WHEN k IN (6, 7) THEN 5 WHEN fs.line = e.line THEN 0 ELSE e.wait + CASE WHEN fs.line = -1 THEN 0 ELSE 5 END END AS total FROM fs JOIN fedge e ON e.t = fs.node WHERE k NOT IN (1, 2, 3, 4, 5, 8, 9)) n
    WHERE NOT EXISTS (SELECT 1 FROM recurring.fs r WHERE r.dest = n.dest AND r.node = n.node AND r.line = n.line AND r.total <= n.total) GROUP BY 1, 2, 3)"""
_LOOPS = {"s": _MATRIX, "lab": _LABELS, "fs": _FAULTY}
_REFUSED = {101: "destination", 102: "preferences", 103: "preferences", 104: "budget", 105: "max_commute", 106: "arrival_time", 107: "layout", 108: "destination"}


def q(body: str) -> str:
    """The body after the views that it needs, in order."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for name in [*VIEWS, *_LOOPS]:
            if name in _LOOPS:
                if re.search(rf"(\bFROM|\bJOIN) {name}\b", text) and text is not _LOOPS[name] and name not in need:
                    add(_LOOPS[name])
                    need.append(name)
            elif re.search(rf"(\bFROM|\bJOIN|,)\s*{name}\b", text) and name not in need:
                add(VIEWS[name])
                need.append(name)

    add(body)
    parts = [_LOOPS[n] if n in _LOOPS else f"{n} AS ({VIEWS[n]})" for n in need]
    return (f"WITH {'RECURSIVE ' if set(_LOOPS) & set(need) else ''}" + ",\n".join(parts) + "\n" if parts else "") + body


_T = config.TARGETS
_suff = lambda x, t: f"round(least(100, 100 * ln(1 + {x}) / ln(1 + {t}::DOUBLE)), 6)"

SQL = {
    "amenity_score_top20": q("SELECT anchor_id, name, round(norm_shop, 6) AS score, row_number() OVER (ORDER BY round(norm_shop, 6) DESC, anchor_id) AS rank FROM shopn QUALIFY rank <= 20"),
    "amenity_counts_800m": q("SELECT anchor_id, n_supermarket, n_grocery, n_convenience, n_restaurant, n_cafe, n_bar, n_health FROM counts"),
    "cuisine_variety": q("SELECT anchor_id, n_cuisines FROM counts"),
    "late_night_count": q("SELECT anchor_id, n_late FROM counts"),
    "minmax_norm": q("SELECT anchor_id, round(norm_shop, 6) AS norm_shop, round(norm_food, 6) AS norm_food, 50::DOUBLE AS norm_constant FROM shopn"),
    "sufficiency_scores": q(f"SELECT anchor_id, {_suff('shop', _T['supermarkets'])} AS supermarkets, {_suff('food', _T['restaurants'])} AS restaurants, {_suff('n_convenience', _T['konbini'])} AS konbini, {_suff('n_cuisines', _T['cuisine_variety'])} AS cuisine_variety, {_suff('n_late', _T['late_night'])} AS late_night, {_suff('n_health', _T['health'])} AS health FROM shop"),
    "coverage_share": q("SELECT anchor_id, round(share, 6) AS share FROM covered"),
    "near_line_share": q("SELECT anchor_id, round(share, 6) AS share FROM exposed"),
    "quietness_proxy": q("SELECT c.anchor_id, round(0.5 * v.share + 0.3 * (1 - e.share) + 0.2 * (1 - CASE WHEN max(n_bar) OVER () = min(n_bar) OVER () THEN 0.5 ELSE (n_bar - min(n_bar) OVER ()) / (max(n_bar) OVER () - min(n_bar) OVER ()) END), 6) AS quietness FROM counts c JOIN covered v ON v.anchor_id = c.anchor_id JOIN exposed e ON e.anchor_id = c.anchor_id"),
    "catchment_land_median": q("SELECT anchor_id, round(median_price, 6) AS median_price, points FROM land"),
    "ward_land_median": q("SELECT ward, round(median_price, 6) AS median_price, points FROM wland"),
    "land_multiplier": q("SELECT anchor_id, round(multiplier, 6) AS multiplier, NOT usable AS fallback FROM mult"),
    "two_level_median": q("SELECT * FROM two"),
    "price_quartiles": q("SELECT ward, round(quantile_cont(price, 0.25), 6) AS low, round(quantile_cont(price, 0.75), 6) AS high FROM home GROUP BY 1"),
    "ward_assignment": q("SELECT id AS point_id, region_id AS ward FROM station LEFT JOIN box ON lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1"),
    "points_in_any_region": q("SELECT DISTINCT poi_id AS point_id FROM poi JOIN box ON lon >= x0 AND lon < x1 AND lat >= y0 AND lat < y1 AND region_id % 3 = 0"),
    "knn_stations": q("SELECT locality, sample, station, rank, dist_m FROM knn"),
    "station_near_lines": q("SELECT point_id, line_id, round(d, 3) AS line_m FROM (SELECT point_id, line_id, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) AS d FROM (SELECT *, least(1, greatest(0, -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM (SELECT id AS point_id, region_id AS line_id, (x0 - lon) * 111320::DOUBLE * cos(radians(lat)) AS ax, (y0 - lat) * 111320::DOUBLE AS ay, (x1 - lon) * 111320::DOUBLE * cos(radians(lat)) AS bx, (y1 - lat) * 111320::DOUBLE AS by_ FROM station, box))) WHERE d <= 300"),
    "transfer_pairs": q(f"SELECT a.id AS a_id, b.id AS b_id, round({_dist('a', 'b')}, 6) AS dist_m FROM station a JOIN station b ON a.id <> b.id AND {_dist('a', 'b')} <= 1500"),
    "latest_run": q("SELECT source, event_id, status, round(rows, 6) AS rows FROM run QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, event_id DESC) = 1"),
    "latest_success": q("SELECT source, event_id, round(rows, 6) AS rows FROM run WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, event_id DESC) = 1"),
    "source_vintages": q("SELECT source, count(*) AS n, count(DISTINCT status) AS kinds, '{\"failed\":\"' || strftime(max(started_at) FILTER (status = 'failed'), '%Y-%m-%d') || '\",\"success\":\"' || strftime(max(started_at) FILTER (status = 'success'), '%Y-%m-%d') || '\"}' AS vintages FROM run GROUP BY 1"),
    "rent_choice": q("SELECT ward, source, period, round(rent_per_sqm, 6) AS rent_per_sqm, round(fee, 6) AS fee, base_confidence FROM choice"),
    "rent_by_layout": q(f"SELECT anchor_id, layout, floor(rent_per_sqm * lo * 0.9::DOUBLE * round(multiplier, 6) + fee + 0.5)::BIGINT AS low_yen, floor(rent_per_sqm * mid * round(multiplier, 6) + fee + 0.5)::BIGINT AS median_yen, floor(rent_per_sqm * hi * 1.1::DOUBLE * round(multiplier, 6) + fee + 0.5)::BIGINT AS high_yen, greatest(base_confidence - (NOT usable)::INT - ({YEAR} - left(period, 4)::INT > 2)::INT, 0)::BIGINT AS confidence FROM mult m JOIN choice c ON c.ward = m.ward, layout"),
    "pair_travel_medians": q("SELECT route, first_stop, stop, next_stop, period, round(median_minutes, 6) AS median_minutes, n FROM pair"),
    "headways": q("SELECT route, first_stop, period, n, round(headway, 6) AS headway FROM gap"),
    "timetable_edges": q("""SELECT * EXCLUDE (r) FROM (SELECT stop AS from_id, next_stop AS to_id, line, round(coalesce(p, o), 6) AS peak_minutes, round(coalesce(o, p), 6) AS offpeak_minutes, round(CASE WHEN pg IS NULL THEN 4 ELSE least(15, greatest(1, pg / 2)) END, 6) AS peak_wait, round(CASE WHEN og IS NULL THEN 6 ELSE least(15, greatest(1, og / 2)) END, 6) AS offpeak_wait,
        row_number() OVER (PARTITION BY stop, next_stop, line ORDER BY n DESC, l.first_stop, l.route) AS r FROM (SELECT route, first_stop, stop, next_stop, route % 3 AS line, max(median_minutes) FILTER (period = 'peak') AS p, max(median_minutes) FILTER (period = 'offpeak') AS o, sum(n) AS n FROM pair GROUP BY ALL) l LEFT JOIN (SELECT route, first_stop, max(headway) FILTER (period = 'peak') AS pg, max(headway) FILTER (period = 'offpeak') AS og FROM gap GROUP BY ALL) g ON g.route = l.route AND g.first_stop = l.first_stop) WHERE r = 1"""),
    "timetable_skips": q("""SELECT reason, count(*) AS legs, sum(n)::BIGINT AS runs FROM (SELECT *, CASE WHEN route % 4 = 1 THEN 'route without line' WHEN stop = 'error' OR next_stop = 'error' THEN 'stop without station' WHEN stop IN ('view', 'click') AND next_stop IN ('view', 'click') THEN 'one station' END AS reason FROM pair) WHERE reason IS NOT NULL GROUP BY 1"""),
    "station_lines": q("SELECT id, string_agg(name, ',' ORDER BY name) AS lines FROM (SELECT DISTINCT f AS id, 'line ' || line AS name FROM edge) GROUP BY 1"),
    "orphan_stations": q("SELECT id FROM halt WHERE id NOT IN (SELECT f FROM edge)"),
    "commute_matrix": q("SELECT dest, node, line, round(total, 6) AS total FROM s"),
    "commute_by_station": q("SELECT dest, node, round(total + 8, 6) AS minutes FROM best"),
    "locality_commute": q("SELECT locality, dest, round(minutes, 6) AS minutes, round(low, 6) AS low, round(high, 6) AS high FROM commute"),
    "locality_scores": q("SELECT locality, axis, round(score, 6) AS score FROM axis"),
    "hard_filter_counts": q("SELECT request_id, considered, excluded_disconnected, excluded_commute, excluded_rent, feasible FROM diag"),
    "suggestions": q("SELECT request_id, main_reason, (CASE main_reason WHEN 'commute' THEN floor(qc + 0.5) WHEN 'rent' THEN floor(qr / 1000 + 0.5) * 1000 END)::BIGINT AS try_value FROM (SELECT *, CASE WHEN excluded_disconnected >= excluded_commute AND excluded_disconnected >= excluded_rent THEN 'disconnected' WHEN excluded_commute >= excluded_rent THEN 'commute' ELSE 'rent' END AS main_reason FROM diag WHERE feasible = 0)"),
    "ranked_shortlist": q("SELECT request_id, rank, locality, round(overall, 6) AS overall, round(commute, 6) AS commute, rent FROM short"),
    "reasons_top3": q("SELECT request_id, locality, direction, place, key FROM (SELECT *, row_number() OVER (PARTITION BY request_id, locality, direction ORDER BY round(weight, 9) DESC, CASE WHEN direction = 'positive' THEN component ELSE -component END DESC, key) AS place FROM factor WHERE direction <> 'neutral') WHERE place <= 3"),
    "factor_extremes": q("SELECT request_id, locality, first(key ORDER BY c DESC, key DESC) AS strongest, first(key ORDER BY c, key) AS weakest, array_to_string(list(key ORDER BY c DESC, key DESC)[1:2], ' and ') AS descriptor FROM (SELECT *, round(component, 6) AS c FROM factor) GROUP BY 1, 2"),
    "shortlist_concentration": q("SELECT request_id, ward, n, total, CASE WHEN n * 4 >= total * 3 THEN 'three quarters' WHEN n * 2 > total THEN 'majority' ELSE 'spread' END AS kind FROM (SELECT *, sum(n) OVER (PARTITION BY request_id)::BIGINT AS total, row_number() OVER (PARTITION BY request_id ORDER BY n DESC, ward) AS place FROM (SELECT request_id, locality % 4 AS ward, count(*) AS n FROM short WHERE rank <= 8 GROUP BY 1, 2)) WHERE place = 1"),
    "standout_metrics": q("SELECT set_id, metric, member, value FROM (SELECT *, max(value) OVER w AS hi, min(value) OVER w AS lo FROM (SELECT anchor_id // 4 AS set_id, anchor_id AS member, unnest(['n_restaurant', 'n_supermarket', 'n_bar']) AS metric, unnest([n_restaurant, n_supermarket, n_bar]) AS value FROM counts) WINDOW w AS (PARTITION BY set_id, metric)) WHERE value = hi AND hi - lo >= 2 QUALIFY count(*) OVER (PARTITION BY set_id, metric) = 1"),
    "place_search": q("""SELECT query_id, rank, place_id, round(similarity, 6) AS similarity FROM (SELECT query_id, place_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY kind <> 'station', similarity DESC, name, place_id) AS rank FROM (
        SELECT *, greatest(""" + _sim("query", "name") + ", coalesce(list_max(list_transform(aliases, lambda al: " + _sim("query", "al") + """)), 0)) AS similarity FROM (VALUES (0, 'Supplier#00000001'), (1, 'small'), (2, 'Brand#1'), (3, 'ECONOMY'), (4, 'ring'), (5, 'zz')) AS t(query_id, query), place WHERE contains(lower(name), lower(query)) OR len(list_filter(aliases, lambda al: contains(lower(al), lower(query)))) > 0)) WHERE rank <= 10"""),
    "trigram_similarity": q("SELECT place_id, round(" + _sim("name", "'Supplier#000000012 west'") + ", 6) AS similarity FROM place WHERE kind = 'station'"),
    "similar_station_names": q("SELECT a_id, b_id, round(v, 6) AS similarity FROM (SELECT a.id AS a_id, b.n_nationkey AS b_id, " + _sim("a.name", "('Supplier ' || n_name || ' ' || lpad(n_nationkey::VARCHAR, 9, '0'))") + " AS v FROM station a, nation b) WHERE v >= 0.3"),
    "similar_part_names": "WITH g AS (SELECT p_partkey AS id, " + _GRAMS.format(x="(p_name || ' ' || p_brand || ' ' || p_partkey || ' ' || p_type)") + " AS t FROM part) SELECT a_id, b_id, round(k / (n - k), 6) AS similarity FROM (SELECT a.id AS a_id, b.id AS b_id, len(a.t) + len(b.t) AS n, len(list_intersect(a.t, b.t)) AS k FROM g a JOIN g b ON a.id < b.id) WHERE k / (n - k) >= 0.75",
    "sync_upsert": q("SELECT id, source, v FROM incoming UNION ALL SELECT id, source, v FROM current_rows WHERE source <> 'osm' AND id NOT IN (SELECT id FROM incoming)"),
    "plain_upsert": q("SELECT id, source, v FROM incoming UNION ALL SELECT id, source, v FROM current_rows WHERE id NOT IN (SELECT id FROM incoming)"),
    "replace_by_source": q("SELECT source, count(*) AS n, sum(v)::BIGINT AS v FROM (SELECT source, v FROM incoming UNION ALL SELECT source, v FROM current_rows WHERE source <> 'osm') GROUP BY 1"),
    "stale_keys": q("SELECT id FROM current_rows WHERE source = 'osm' AND id NOT IN (SELECT id FROM incoming)"),
    "period_sync": q("SELECT ward, source, period, round(rent_per_sqm, 6) AS rent_per_sqm, round(fee, 6) AS fee FROM (SELECT ward, source, period, rent_per_sqm, fee + 1 AS fee FROM stat WHERE period = '1995' AND ward % 2 = 0 UNION ALL SELECT ward, source, period, rent_per_sqm, fee FROM stat WHERE NOT (period = '1995' AND source IN (SELECT source FROM stat WHERE period = '1995' AND ward % 2 = 0)))"),
    "array_union_upsert": "SELECT id, array_to_string(list_sort(list_distinct(flatten(list(x)))), '|') AS aliases FROM (SELECT p_partkey AS id, [p_brand, p_type] AS x FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, [p_brand, p_size::VARCHAR] FROM part WHERE p_partkey % 2 = 0) GROUP BY 1",
    "reference_guard": q('SELECT \'stations\' AS "table", count(*) AS n FROM station WHERE ward % 5 = 0 UNION ALL SELECT \'customers\', count(*) FROM customer WHERE c_nationkey % 5 = 0'),
    "name_backfill": "SELECT count(*) AS considered, count(*) FILTER (n_nationkey % 3 = 0) AS updated, count(*) FILTER (n_nationkey % 3 <> 0) AS already FROM nation WHERE n_nationkey % 2 = 0",
    "one_per_name": "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey::VARCHAR), p_partkey) = 1",
    "dq_report": q("""SELECT label, value::DOUBLE AS value, coalesce(value >= least_, true) AND coalesce(value <= most_, true) AS passed FROM (
        SELECT 'stations' AS label, count(*) AS value, 50 AS least_, 5000 AS most_ FROM station UNION ALL SELECT 'stations outside the box', count(*) FILTER (NOT lat BETWEEN 35.5 AND 35.82), NULL, 0 FROM station
        UNION ALL SELECT 'rides', count(*), 1, NULL FROM edge UNION ALL SELECT 'rides without minutes', count(*) FILTER (NOT m > 0), NULL, 0 FROM edge UNION ALL SELECT 'orphans', count(*), NULL, 10 FROM station WHERE id NOT IN (SELECT f FROM edge)
        UNION ALL SELECT 'residential prices', count(*) FILTER (use = 'residential'), 1, NULL FROM price UNION ALL SELECT 'prices that are not positive', count(*) FILTER (NOT price > 0), NULL, 0 FROM price)"""),
    "ward_coverage": q("SELECT n_nationkey AS ward, 'missing' AS problem FROM nation WHERE n_nationkey NOT IN (SELECT ward FROM station WHERE ward <> 3) UNION ALL SELECT unnest([40, 41]), 'unknown'"),
    "name_audit": "SELECT p_brand, count(*) AS n, count(*) FILTER (p_partkey % 7 = 0) AS blank, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 5 = 0) AS unchanged, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 11 = 0) AS japanese FROM part GROUP BY 1",
    "reject_split": q("SELECT * FROM (SELECT 'price' AS rule, count(*) AS n FROM price WHERE NOT price > 50000 UNION ALL SELECT 'year', count(*) FROM price WHERE NOT year >= 1994 UNION ALL SELECT 'use', count(*) FROM price WHERE use = 'industrial') WHERE n > 0 UNION ALL SELECT 'kept', count(*) FROM price WHERE price > 50000 AND year >= 1994 AND use <> 'industrial'"),
    "fallback_share": q("SELECT count(*) FILTER (NOT usable) AS bad, count(*) AS n, round(count(*) FILTER (NOT usable) / count(*), 6) AS share FROM mult"),
    "weekday_services": "SELECT o_orderstatus AS service, count(*) FILTER (isodow(o_orderdate) < 6) AS workdays, count(*) AS n FROM orders GROUP BY 1",
    "name_match_cascade": "SELECT n_nationkey AS \"row\", CASE WHEN n_nationkey % 3 = 0 OR n_nationkey % 2 = 0 THEN n_nationkey END AS ward, CASE WHEN n_nationkey % 3 = 0 THEN 'code' WHEN n_nationkey % 2 = 0 THEN 'name' ELSE 'none' END AS how FROM nation",
    "price_vintages": q("SELECT anchor_id, newest::INT AS newest, oldest::INT AS oldest FROM land"),
    "evidence_counts": q("SELECT count(*) AS places, count(*) FILTER (food) AS food, count(DISTINCT cuisine) AS cuisines, count(*) FILTER (late) AS late, count(*) FILTER (category = 'health') AS health, (SELECT count(*) FROM station) AS stations, (SELECT count(DISTINCT line) FROM edge) AS lines, (SELECT count(*) FROM home) AS home_prices, (SELECT count(DISTINCT ward) FROM stat) AS rented_wards, (SELECT count(DISTINCT region_id) FROM island) AS localities_with_homes FROM late"),
    "nulled_references": q("SELECT CASE WHEN ward % 5 <> 0 THEN ward END AS ward, count(*) AS n FROM station GROUP BY 1"),
    "backfill_problems": "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 = 3 THEN 'unknown' WHEN n_nationkey % 4 = 2 THEN 'repeated' ELSE 'invalid' END AS problem FROM nation WHERE n_nationkey % 7 = 3 OR n_nationkey % 4 = 2 OR n_nationkey % 5 = 1",
    "nested_samples": q("SELECT locality, count(*) AS n, '[' || string_agg('{\"sample\":' || sample || ',\"stations\":[' || x || ']}', ',' ORDER BY sample) || ']' AS json FROM (SELECT locality, sample, string_agg('{\"rank\":' || rank || ',\"station\":' || station || '}', ',' ORDER BY rank) AS x FROM knn GROUP BY 1, 2) GROUP BY 1"),
    "nearby_stations": q("SELECT * FROM (SELECT locality, station, dist_m, row_number() OVER (PARTITION BY locality ORDER BY dist_m, station) AS rank FROM (SELECT locality, station, min(dist_m) AS dist_m FROM knn GROUP BY 1, 2)) WHERE rank <= 3"),
    "union_places": q("SELECT kind, count(*) AS n, count(DISTINCT name) AS names FROM place GROUP BY 1"),
    "walk_seeds": q(f"SELECT locality * 10 + sample AS dest, s.id AS node, ceil({_dist('l', 's')} * 1.3::DOUBLE / 80) AS walk FROM loc l JOIN station s ON {_dist('l', 's')} <= 1500"),
    "slug_ids": "SELECT n_nationkey AS id, 'the-' || replace(lower(n_name), '_', '-') || '-ward' AS slug, n_nationkey || ':' || left(sha256(n_name), 16) AS stable FROM nation",
    "roundings": "SELECT sum(floor(x + 0.5))::BIGINT AS half_up, sum(round_even(x, 0))::BIGINT AS half_even, round(sum(floor(x * 10 + 0.5) / 10), 4) AS one_decimal FROM (SELECT o_totalprice / 1000 AS x FROM orders)",
    "merged_stations": q(f"""WITH RECURSIVE m AS (SELECT substr(poi_id, 2)::BIGINT AS id, name, lon, lat FROM poi WHERE category = 'supermarket'),
      pairs AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.lat - b.lat) < 0.01 AND abs(a.lon - b.lon) < 0.01 WHERE 2 * 6371000::DOUBLE * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 300),
      reach AS (SELECT id, id AS other FROM m UNION SELECT r.id, p.b FROM reach r JOIN pairs p ON p.a = r.other)
      SELECT component, count(*) AS members, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, first(name ORDER BY id) AS name FROM (SELECT id, min(other) AS component FROM reach GROUP BY 1) JOIN m USING (id) GROUP BY 1""").replace("WITH poi AS", "WITH RECURSIVE poi AS").replace("\nWITH RECURSIVE m AS", ", m AS"),
    "station_search": q("SELECT query_id, rank, place_id, coalesce(lines, '') AS lines FROM (SELECT query_id, place_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, name, place_id) AS rank FROM (SELECT *, " + _sim("query", "name") + " AS similarity, substr(place_id, 2)::BIGINT AS id FROM (VALUES (0, 'Supplier#00000001'), (1, '9'), (2, 'none such')) AS t(query_id, query), place WHERE kind = 'station' AND contains(lower(name), lower(query)))) r LEFT JOIN (SELECT id AS sid, string_agg(name, ',' ORDER BY name) AS lines FROM (SELECT DISTINCT f AS id, 'line ' || line AS name FROM edge) GROUP BY 1) ON sid = id WHERE rank <= 10"),
    "shortlist_funnel": q("SELECT d.request_id, considered, feasible, coalesce(n, 0) AS shortlisted, top FROM diag d LEFT JOIN (SELECT request_id, count(*) AS n, first(locality ORDER BY rank) AS top FROM short GROUP BY 1) t ON t.request_id = d.request_id"),
    "neutral_card": q("SELECT locality, round(avg(s), 4) AS score, first(axis ORDER BY s DESC, axis DESC) AS best, first(axis ORDER BY s, axis) AS worst FROM (SELECT locality, axis, round(score, 6) AS s FROM axis) GROUP BY 1"),
    "nearby_last_sample": q("SELECT locality, station, first(dist_m ORDER BY sample DESC) AS dist_m, first(rank ORDER BY sample DESC) AS rank FROM knn GROUP BY 1, 2"),
    "graph_health": q("SELECT stations, orphans, rides, round(orphans / stations, 6) AS share, rides > 0 AND round(orphans / stations, 6) <= 0.1 AS healthy FROM (SELECT (SELECT count(*) FROM station) AS stations, (SELECT count(*) FROM station WHERE id NOT IN (SELECT f FROM edge)) AS orphans, (SELECT count(*) FROM edge) AS rides)"),
    "unusable_candidates": q("SELECT CASE WHEN rent_per_sqm IS NULL THEN 'rent' WHEN w.median_price IS NULL THEN 'ward prices' WHEN t.median IS NULL THEN 'near prices' ELSE 'none' END AS lacks, count(*) AS n FROM nation LEFT JOIN two t ON t.locality = n_nationkey LEFT JOIN wland w ON w.ward = n_nationkey LEFT JOIN choice c ON c.ward = n_nationkey GROUP BY 1"),
    "commute_legs": q("SELECT dest, node, floor(total + 8 + 0.5)::BIGINT AS total_min, floor(total + 8 + 0.5)::BIGINT AS sum_min FROM best"),
    "commute_parts": q("SELECT w.dest, start AS node, start_line AS line, max(pos)::BIGINT AS hops, (max(l.label) // 1000 % 1000)::BIGINT AS transfers, round(coalesce(sum(minutes), 0), 6) AS rail, round(coalesce(sum(board), 0), 6) AS waits, coalesce(min(sure), 2)::BIGINT AS confidence FROM " + _WALK.format(chosen="lab") + " w JOIN lab l ON l.dest = w.dest AND l.node = start AND l.line = start_line LEFT JOIN onward o ON o.dest = w.dest AND o.node = w.node AND o.line = w.line GROUP BY 1, 2, 3"),
    "graph_rejects": q("""SELECT input, reason, count(*) AS n FROM (SELECT 'edge' AS input, CASE k WHEN 9 THEN 'no station' WHEN 5 THEN 'unknown kind' WHEN 8 THEN 'ride without line' WHEN 2 THEN 'negative minutes' WHEN 1 THEN 'no minutes' WHEN 3 THEN 'no minutes' WHEN 4 THEN 'no minutes' END AS reason FROM fedge
      UNION ALL SELECT 'seed', CASE id % 13 WHEN 4 THEN 'no destination' WHEN 5 THEN 'no station' WHEN 2 THEN 'no walk' WHEN 3 THEN 'no walk' WHEN 1 THEN 'negative walk' END FROM station) WHERE reason IS NOT NULL GROUP BY 1, 2"""),
    "faulty_graph_matrix": q("SELECT dest, node, line, round(total, 6) AS total FROM fs"),
    "commute_paths": q("SELECT dest, start AS node, string_agg(station_name, ' > ' ORDER BY pos) AS stations, coalesce(string_agg(line_name, ' > ' ORDER BY pos) FILTER (pos > 0), '') AS lines FROM " + _WALK.format(chosen="bestlab") + " GROUP BY 1, 2"),
    "optimize_answers": q("""SELECT a.request_id, refused, considered, feasible, CASE WHEN refused IS NULL THEN coalesce(results, '[]') END AS results, vintages
      FROM (SELECT request_id, NULL::VARCHAR AS refused FROM request UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"({r}, '{w}')" for r, w in _REFUSED.items()) + """)) a LEFT JOIN diag d ON d.request_id = a.request_id
      LEFT JOIN (SELECT s.request_id, '[' || string_agg('{"rank":' || rank || ',"locality":' || s.locality || ',"overall":' || round(overall, 6)::DOUBLE || ',"commute":' || round(s.commute, 6)::DOUBLE || ',"rent":' || s.rent || coalesce(',"path":' || path, '') || '}', ',' ORDER BY rank) || ']' AS results
        FROM short s JOIN request r ON r.request_id = s.request_id JOIN middle m ON m.locality = s.locality AND m.dest = r.dest LEFT JOIN (
          SELECT dest, start, '[' || string_agg('{"station":"' || station_name || '"' || coalesce(',"line":"' || line_name || '"', '') || '}', ',' ORDER BY pos) || ']' AS path FROM """ + _WALK.format(chosen="bestlab") + """ GROUP BY 1, 2) p ON p.dest = r.dest AND p.start = m.station GROUP BY 1) t ON t.request_id = a.request_id,
      (SELECT '[' || string_agg('{"source":"' || source || '","imported":"' || strftime(started_at, '%Y-%m-%d') || '"}', ',' ORDER BY source) || ']' AS vintages FROM (SELECT source, max(started_at) AS started_at FROM run WHERE status = 'success' GROUP BY 1))"""),
}
