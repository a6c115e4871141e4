"""Queries of the filters, boxes and scalar functions over customers and suppliers as places, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkfield.functions import geo
from larkfield.operators import routes, search, spatial
from larkfield.operators.place_queries import _far
from larkfield.operators.querylog import with_query_count
from larkfield.sources.tables import ITEMS_SQL, PLACES_SQL, items, places, query_log, table, with_row_index

BASE = f"WITH p AS ({PLACES_SQL}), i AS ({ITEMS_SQL}) "


def _box(min_lng=139.02, min_lat=35.01, max_lng=139.08, max_lat=35.06):
    return geo.make_box(*(F.lit(x) for x in (min_lng, min_lat, max_lng, max_lat)))


def _own_box():
    return geo.make_box(F.col("lng") - 0.03, F.col("lat") - 0.02, F.col("lng") + 0.01, F.col("lat") + 0.05)


def _flat(df, box):
    return df.select("id", box.alias("b")).select("id", *(F.round(F.col(f"b.{c}"), 7).alias(c) for c in ("min_lng", "min_lat", "max_lng", "max_lat")))


def _kinds(spark, sf_dir):
    kind = F.when(F.col("id") % 5 != 0, F.array(F.concat(F.lit("c"), (F.col("id") % 6).cast("string")), F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))))
    return places(spark, sf_dir).select("id", (F.col("id") % 3).cast("string").alias("group"), kind.alias("poi_category"))


def _layers(spark, sf_dir):
    return items(spark, sf_dir).select("id", "name", "lat", "lng", F.when(F.col("id") % 2 == 0, "transit").otherwise("poi").alias("layer"), (F.col("id") % 3 == 0).alias("entrance"))


def _ring(spark):
    return spark.createDataFrame([(1, [(139.01, 35.01), (139.06, 35.02), (139.05, 35.07), (139.02, 35.06)])], "id int, ring array<struct<lng:double,lat:double>>")


def _lines(spark, sf_dir):
    end = lambda c: (F.col(c) + 0.004)
    return items(spark, sf_dir).select("id", F.array(F.struct("lng", "lat"), F.struct(end("lng").alias("lng"), end("lat").alias("lat"))).alias("line"))


QUERIES = {
    "filter_in_box": lambda s, d: places(s, d).where(geo.in_box(F.col("lat"), F.col("lng"), _box())).select("id"),
    "filter_in_scope": lambda s, d: search.in_scope(places(s, d), geo.in_box(F.col("lat"), F.col("lng"), _box())).select("id"),
    "filter_in_scope_fallback": lambda s, d: search.in_scope(places(s, d), geo.in_box(F.col("lat"), F.col("lng"), _box(1.0, 1.0, 2.0, 2.0))).select("id"),
    "filter_towards": lambda s, d: places(s, d).where(geo.towards(F.col("lat"), F.col("lng"), F.lit(35.05), F.lit(139.05), F.when(F.col("id") % 2 == 0, "north").otherwise("west"), strict=False)).select("id"),
    "filter_blocked": lambda s, d: search.drop_blocked(places(s, d), ["CUSTOMER#00000000", "customer#0000001"]).select("id"),
    "filter_building_names": lambda s, d: search.drop_building_names(places(s, d).withColumn("name", F.when(F.col("id") % 3 == 0, "森ビル").otherwise(F.col("name"))), "mansion").select("id"),
    "filter_categories": lambda s, d: search.drop_categories(_kinds(s, d), s.createDataFrame([("0", ["c0", "c1"]), ("1", ["c0", "c1", "c2", "c3", "c4", "c5"])], "group string, remove array<string>"), keep_null=False).select("id"),
    "filter_rate": lambda s, d: search.rate(places(s, d).select("id", "name"), places(s, d).where("id % 2 = 0").select("name", F.when(F.col("id") % 3 == 0, "no").when(F.col("id") % 3 == 1, "probably").otherwise("unknown").alias("relevance"))),
    "filter_rate_strict": lambda s, d: search.rate(places(s, d).select("id", "name"), places(s, d).where("id % 2 = 0").select("name", F.when(F.col("id") % 3 == 0, "no").when(F.col("id") % 3 == 1, "probably").otherwise("unknown").alias("relevance")), strict=True),
    "filter_floors_between": lambda s, d: places(s, d).withColumn("f", F.when(F.col("id") % 4 != 0, F.col("id") % 20)).where(search.floor_pass(F.col("f"), least=5, most=9, negate=True)).select("id"),
    "filter_resolve_category": lambda s, d: search.resolve_category(table(s, d, "part").select(F.col("p_type").alias("query")).distinct(), table(s, d, "part").select(F.col("p_type").alias("name"), F.when(F.col("p_type") == "ECONOMY", "x").otherwise(F.col("p_brand")).alias("id")).distinct()),
    "box_intersect": lambda s, d: _flat(places(s, d), geo.intersect_box(_own_box(), _box())),
    "box_cap": lambda s, d: _flat(places(s, d), geo.cap_box(_own_box(), 2000.0)),
    "box_expand": lambda s, d: _flat(places(s, d), geo.expand_box(_own_box(), 400.0)),
    "box_cut": lambda s, d: _flat(places(s, d), geo.cut_box(_own_box(), F.when(F.col("id") % 2 == 0, "north").otherwise("west"))),
    "scalar_snap": lambda s, d: places(s, d).select("id", F.round(geo.snap(F.col("lat"), 0.0025), 7).alias("lat")),
    "scalar_repair": lambda s, d: places(s, d).select("id", *(c.alias(n) for c, n in zip(geo.repair(F.when(F.col("id") % 2 == 0, F.col("lng")).otherwise(F.col("lat")), F.when(F.col("id") % 2 == 0, F.col("lat")).otherwise(F.col("lng"))), ("lat", "lng")))),
    "scalar_truncate": lambda s, d: places(s, d).select("id", geo.truncate_coordinate(F.concat(F.lit("35."), F.lpad((F.col("id") % 1000).cast("string"), 3, "0")), 2).alias("lat")),
    "scalar_distance_label": lambda s, d: places(s, d).select("id", geo.compact_distance((F.col("id") * 7).cast("double")).alias("label")),
    "scan_layer": lambda s, d: spatial.scan_layer(_layers(s, d), "transit", 35.05, 139.05, 6000.0, where=F.col("entrance")).select("id", "distance"),
    "scan_layer_by_place": lambda s, d: spatial.scan_layer(_layers(s, d), "poi", 35.05, 139.05, 6000.0, by_place=2).select("id"),
    "geo_inside_polygon": lambda s, d: spatial.split_by_polygons(places(s, d), _ring(s)).select("id", "inside"),
    "geo_nearest_line": lambda s, d: spatial.nearest_line(places(s, d), _lines(s, d), 400.0).select("id", F.round("nearest", 3).alias("nearest")),
    "geo_hex_grid": lambda s, d: spatial.hex_grid(s, 35.0, 139.0, 1000.0).select(F.round("lat", 9).alias("lat"), F.round("lng", 9).alias("lng")),
    "route_truncate": lambda s, d: routes.simplify(places(s, d), 2, "truncate").select("id", "lat2", "lng2"),
    "log_query_count": lambda s, d: with_query_count(query_log(s, d)).select("row_idx", "same_query_count"),
    "log_row_index": lambda s, d: with_row_index(table(s, d, "events").select("event_id")).select("event_id", "row_idx"),
}

_O = "SELECT id, lng - 0.03 AS a, lat - 0.02 AS b, lng + 0.01 AS c, lat + 0.05 AS d FROM p"
_OUT = "round({}, 7) AS min_lng, round({}, 7) AS min_lat, round({}, 7) AS max_lng, round({}, 7) AS max_lat"
_SCAN = BASE + f", o AS (SELECT 35.05::DOUBLE AS lat, 139.05::DOUBLE AS lng), x AS (SELECT i.id, i.lat, i.lng, {_far('o', 'i')} AS d FROM i, o) "
ORACLE = {
    "filter_in_box": BASE + "SELECT id FROM p WHERE lng BETWEEN 139.02 AND 139.08 AND lat BETWEEN 35.01 AND 35.06",
    "filter_in_scope": BASE + "SELECT id FROM p WHERE lng BETWEEN 139.02 AND 139.08 AND lat BETWEEN 35.01 AND 35.06",
    "filter_in_scope_fallback": BASE + "SELECT id FROM p",
    "filter_towards": BASE + "SELECT id FROM p WHERE CASE WHEN id % 2 = 0 THEN lat >= 35.05 ELSE lng <= 139.05 END",
    "filter_blocked": BASE + "SELECT id FROM p WHERE NOT (lower(name) LIKE 'customer#00000000%' OR lower(name) LIKE 'customer#0000001%')",
    "filter_building_names": BASE + "SELECT id FROM p WHERE id % 3 <> 0",
    "filter_categories": BASE + """, k AS (SELECT id, id % 3 AS g, id % 5 = 0 AS bare, id % 6 AS x, id % 4 AS y FROM p), m AS (SELECT id, g, CASE WHEN bare THEN true WHEN g = 0 THEN x IN (0, 1) OR y IN (0, 1) ELSE g = 1 END AS gone FROM k)
SELECT id FROM m WHERE NOT gone OR g NOT IN (SELECT g FROM m WHERE NOT gone)""",
    "filter_rate": BASE + "SELECT id, name, CASE WHEN id % 2 = 0 AND id % 3 = 1 THEN 'probably' ELSE 'unknown' END AS relevance FROM p WHERE NOT (id % 2 = 0 AND id % 3 = 0)",
    "filter_rate_strict": BASE + "SELECT id, name, 'probably' AS relevance FROM p WHERE id % 2 = 0 AND id % 3 = 1",
    "filter_floors_between": BASE + "SELECT id FROM p WHERE id % 4 = 0 OR NOT (id % 20 BETWEEN 5 AND 9)",
    "filter_resolve_category": "WITH t AS (SELECT DISTINCT p_type AS query, CASE WHEN p_type = 'ECONOMY' THEN 'x' ELSE p_brand END AS id FROM part) SELECT query, min(id) AS category FROM t GROUP BY 1 HAVING count(*) = 1",
    "box_intersect": BASE + f", o AS ({_O}), x AS (SELECT *, greatest(a, 139.02) AS e, greatest(b, 35.01) AS f, least(c, 139.08) AS g, least(d, 35.06) AS h FROM o), y AS (SELECT *, e <= g AND f <= h AS ok FROM x) SELECT id, {_OUT.format(*(f'CASE WHEN ok THEN {u} ELSE {v} END' for u, v in zip('efgh', 'abcd')))} FROM y",
    "box_cap": BASE + f", o AS ({_O}), x AS (SELECT *, (b + d) / 2 AS y, (a + c) / 2 AS x, 2000 / 110540.0::DOUBLE AS dy, 2000 / (111320.0::DOUBLE * cos(radians((b + d) / 2))) AS dx FROM o) SELECT id, {_OUT.format('greatest(a, x - dx)', 'greatest(b, y - dy)', 'least(c, x + dx)', 'least(d, y + dy)')} FROM x",
    "box_expand": BASE + f", o AS ({_O}), x AS (SELECT *, 400 / 111000.0::DOUBLE AS dy, 400 / (111000.0::DOUBLE * cos(radians((b + d) / 2))) AS dx FROM o) SELECT id, {_OUT.format('a - dx', 'b - dy', 'c + dx', 'd + dy')} FROM x",
    "box_cut": BASE + f", o AS ({_O}) SELECT id, {_OUT.format('a', 'CASE WHEN id % 2 = 0 THEN (b + d) / 2 ELSE b END', 'CASE WHEN id % 2 = 0 THEN c ELSE (a + c) / 2 END', 'd')} FROM o",
    "scalar_snap": BASE + "SELECT id, round(floor(lat / 0.0025::DOUBLE + 0.5) * 0.0025::DOUBLE, 7) AS lat FROM p",
    "scalar_repair": BASE + "SELECT id, lat, lng FROM p",
    "scalar_truncate": BASE + "SELECT id, ('35.' || substr(lpad((id % 1000)::VARCHAR, 3, '0'), 1, 2))::DOUBLE AS lat FROM p",
    "geo_inside_polygon": BASE + """, r(x1, y1, x2, y2) AS (VALUES (139.01, 35.01, 139.06, 35.02), (139.06, 35.02, 139.05, 35.07), (139.05, 35.07, 139.02, 35.06), (139.02, 35.06, 139.01, 35.01)), d AS (SELECT x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM r)
SELECT id, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lng < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1 AS inside FROM p, d GROUP BY id""",
    "log_query_count": "SELECT event_id AS row_idx, count(*) OVER (PARTITION BY props) AS same_query_count FROM events",
    "log_row_index": "SELECT event_id, event_id AS row_idx FROM events",
    "scalar_distance_label": BASE + "SELECT id, CASE WHEN id * 7 < 1000 THEN (id * 7) || ' m' ELSE printf('%.1f', id * 7 / 1000.0::DOUBLE) || ' km' END AS label FROM p",
    "scan_layer": _SCAN + "SELECT id, floor(d + 0.5)::BIGINT AS distance FROM x WHERE id % 2 = 0 AND id % 3 = 0 AND d <= 6000 ORDER BY d, id LIMIT 50",
    "scan_layer_by_place": _SCAN + "c AS (SELECT *, row_number() OVER (PARTITION BY floor(lat * 100 + 0.5), floor(lng * 100 + 0.5) ORDER BY d, id) AS r FROM x WHERE id % 2 = 1 AND d <= 6000) SELECT id FROM c WHERE r = 1 ORDER BY d, id LIMIT 50".replace("c AS", ", c AS", 1),
    "geo_nearest_line": BASE + """, s AS (SELECT p.id, 111320.0::DOUBLE * cos(radians(p.lat)) AS k, (i.lng - p.lng) AS x, (i.lat - p.lat) AS y FROM p JOIN i ON abs(p.lat - i.lat) < 0.02 AND abs(p.lng - i.lng) < 0.02),
m AS (SELECT id, x * k AS ax, y * 110540.0::DOUBLE AS ay, (x + 0.004::DOUBLE) * k AS bx, (y + 0.004::DOUBLE) * 110540.0::DOUBLE AS bq FROM s),
t AS (SELECT *, greatest(0, least(1, -(ax * (bx - ax) + ay * (bq - ay)) / (power(bx - ax, 2) + power(bq - ay, 2)))) AS t FROM m), d AS (SELECT id, sqrt(power(ax + t * (bx - ax), 2) + power(ay + t * (bq - ay), 2)) AS d FROM t)
SELECT id, round(min(d), 3) AS nearest FROM d WHERE d <= 400 GROUP BY 1""",
    "geo_hex_grid": """WITH k AS (SELECT 65 * sqrt(3) * 0.95::DOUBLE AS step, 65 * 1.5::DOUBLE * 0.95::DOUBLE AS rise), g AS (SELECT r, c, step, rise FROM k, range(-100, 101) a(r), range(-100, 101) b(c) WHERE abs(r) <= ceil(1000 / rise) + 1 AND abs(c) <= ceil(1000 / step) + 1)
SELECT round(35.0 + r * rise / 110540.0::DOUBLE, 9) AS lat, round(139.0 + (c + abs(r % 2) / 2.0::DOUBLE) * step / (111320.0::DOUBLE * cos(radians(35.0::DOUBLE))), 9) AS lng FROM g""",
    "route_truncate": BASE + "SELECT id, regexp_extract(lat::VARCHAR, '^[0-9]+(\\.[0-9]{1,2})?')::DOUBLE AS lat2, regexp_extract(lng::VARCHAR, '^[0-9]+(\\.[0-9]{1,2})?')::DOUBLE AS lng2 FROM p",
}
