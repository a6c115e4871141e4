"""Queries of what models are asked, with stand-ins for models whose answers SQL can state, and of reach areas, grids and categories."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from larkfield.operators import assistant, candidates, compare, search, spatial
from larkfield.operators.place_queries import _far, _two_sides
from larkfield.sources.tables import ITEMS_SQL, PLACES_SQL, items, places, query_log, table

BASE = f"WITH p AS ({PLACES_SQL}), i AS ({ITEMS_SQL}) "
#: The box and the ring of the scans, and the triangle left out.
BOX = (139.02, 35.02, 139.06, 35.05)
HOLE = [(139.03, 35.02), (139.05, 35.03), (139.03, 35.04)]


def _ring(corners):
    return F.array(*(F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in corners))


def parser(payload: str) -> str:
    """A stand-in: anchor and target are the parts before and after `の`; a text without it gets no JSON."""
    near, _, target = json.loads(payload)["text"].partition("の")
    return json.dumps({"prox": {"anc": [{"ty": "poi", "tx": near}]}, "tgt": {"tx": target}}) if target else "sorry"


def rater(payload: str) -> str:
    """A stand-in: by the last digit; a request with a name that ends in 77 fails."""
    names = json.loads(payload)["names"]
    if any(n.endswith("77") for n in names):
        raise ValueError("no answer")
    return json.dumps({"ratings": [("definitely", "probably", "no", "odd")[int(n[-1]) % 4] for n in names]})


def remover(payload: str) -> str:
    """A stand-in: removes the group's first category; has no answer for group 2."""
    asked = json.loads(payload)
    return "?" if asked["group"] == "2" else json.dumps({"remove": asked["categories"][:1]})


def merger(payload: str) -> str:
    """A stand-in: the first two rows of a group are one."""
    return json.dumps({"merge": [json.loads(payload)["positions"][:2]]})


def checker(payload: str) -> str:
    """A stand-in: the name is fine if it ends evenly, the tags get a verdict that there isn't."""
    even = int(json.loads(payload)["name"][-1]) % 2 == 0
    return json.dumps({"exists": {"verdict": "ok"}, "name_current": {"verdict": "ok" if even else "ng", "note": "x"}, "tags_correct": {"verdict": "maybe"}})


def _texts(s, d):
    said = F.when(F.col("id") % 3 == 0, "駅のカフェ").when(F.col("id") % 3 == 1, F.concat(F.lit("塔の店"), (F.col("id") % 5).cast("string"))).otherwise("なに")
    return places(s, d).select("id", said.alias("text"))


def _kinds(s, d):
    kind = F.when(F.col("id") % 5 != 0, F.array(F.concat(F.lit("c"), (F.col("id") % 6).cast("string")), F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))))
    return places(s, d).select("id", (F.col("id") % 3).cast("string").alias("group"), kind.alias("poi_category"))


def _rows_of_pages(s, d):
    mine, theirs = _two_sides(s, d)
    return mine.where("rank % 30 < 3").groupBy("query_id").agg(F.concat(F.lit("q"), F.first("query_id").cast("string")).alias("query"), F.array_sort(F.collect_list("name")).alias("mine"), F.array().cast("array<string>").alias("theirs"))


def diagnoser(payload: str) -> str:
    """A stand-in: by the number of the query."""
    n = int(json.loads(payload)["query"][1:])
    return json.dumps({"reason": ("poi coverage", "too ambiguous query", "strange")[n % 3]})


def _taxonomy(s):
    return s.createDataFrame([("丼もの", "food>丼もの"), ("病院", "medical>病院"), ("駅", "a>駅"), ("駅", "b>駅")], "name string, id string"), s.createDataFrame([("牛丼", "food>丼もの"), ("医院", "medical>病院"), ("店", "shop")], "synonym string, id string")


def _asked(s, d):
    word = F.element_at(F.array(*map(F.lit, ("牛丼屋", "病院", "駅", "牛丼店", "医院前", "丼もの", "公園"))), (F.col("id") % 7 + 1).cast("int"))
    return places(s, d).select("id", word.alias("query"))


def square(lat, lng, minutes):
    """A stand-in for a source of reach polygons: a thousandth of a degree a minute, its edges on no place."""
    m = minutes / 1000 + 0.00005
    return [(lng - m, lat - m), (lng + m, lat - m), (lng + m, lat + m), (lng - m, lat + m)]


def _area(minutes):
    return spatial.reach_area(35.05, 139.05, minutes, minutes * 2, 80.0, square)


def _boxes(s):
    areas = [(m, spatial.reach_area(35.05, 139.05, m, None, 80.0, square, (139.0, 35.0, 139.1, 35.1))) for m in (10, 50)]
    return s.createDataFrame([(m, round(a["box"][0], 6), round(a["box"][3], 6), a["too_large"]) for m, a in areas], "minutes int, west double, north double, too_large boolean")


def _labelled(s, d):
    requests = assistant.batch_requests(_texts(s, d).withColumnRenamed("text", "query"), 2)
    return assistant.batch_labels(requests, requests.select("custom_id", F.transform("queries", lambda q: F.when(F.contains(q, F.lit("塔")), "poi").otherwise("odd")).alias("labels")))


QUERIES = {
    "assist_parse": lambda s, d: assistant.parse_queries(_texts(s, d), parser).select("text", F.get_json_object("request", "$.proximity.anchors[0].text").alias("anchor"), F.get_json_object("request", "$.target.text").alias("target"), F.array_join("problems", ",").alias("problems")),
    "assist_refined": lambda s, d: s.createDataFrame([(c["text"], c["negate"]) for c in assistant.parse_refinement({"target": {"text": "店"}, "conditions": [{"type": "poi", "text": "a"}, {"type": "poi", "text": "b"}]}, "b is far", lambda _: json.dumps({"cond": [{"ty": "poi", "tx": "b", "ng": True}]}))["conditions"]], "text string, negate boolean"),
    "assist_categories": lambda s, d: assistant.filter_categories(_kinds(s, d), remover).select("id"),
    "assist_rate": lambda s, d: assistant.rate_names(places(s, d).select(F.lit("x").alias("intent"), "name"), rater, 1).select("name", "relevance"),
    "assist_merge": lambda s, d: assistant.merge_clusters(places(s, d).select(F.floor(F.col("id") / 4).alias("group"), (F.col("id") % 4).alias("pos"), "id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit(None).cast("double").alias("distance")), merger).select("id"),
    "assist_landmarks": lambda s, d: assistant.suggested(_texts(s, d), lambda p: json.dumps({"names": [json.loads(p)["text"][:1], "塔"]})),
    "assist_feedback": lambda s, d: assistant.classify_feedback(_texts(s, d), lambda p: json.dumps({"action": "narrow" if "駅" in json.loads(p)["text"] else "other"})),
    "assist_converse": lambda s, d: assistant.converse(table(s, d, "conversations"), lambda p: json.dumps({"reply": str(len(json.loads(p)["messages"]))}), 3),
    "assist_roles": lambda s, d: s.createDataFrame(list(assistant.column_roles(query_log(s, d).select("query", "proximity", "bbox", "near"), lambda _: json.dumps({"query": "q", "proximity": "proximity", "bbox": "box"})).items()), "column string, role string"),
    "assist_diagnosis": lambda s, d: assistant.diagnose(_rows_of_pages(s, d), compare.top_corroborated(*_two_sides(s, d)), diagnoser),
    "assist_checks": lambda s, d: assistant.check_places(places(s, d).select("id", "name", F.concat(F.lit("東京都港区1-"), (F.col("id") % 9).cast("string")).alias("address"), F.array(F.lit("cafe")).alias("tags"), F.when(F.col("id") % 3 == 0, "日本、東京都港区1-4").when(F.col("id") % 3 == 1, "").alias("found_address")), checker),
    "assist_batches": lambda s, d: assistant.batch_requests(query_log(s, d), 7, 3).select(F.size("queries").alias("n"), "job").groupBy("job").agg(F.count("*").alias("requests"), F.sum("n").alias("queries")),
    "assist_batch_labels": lambda s, d: _labelled(s, d),
    "geo_grid_scan": lambda s, d: spatial.grid_scan(places(s, d), *BOX, radius=400.0).select("id", "distance"),
    "geo_grid_hole": lambda s, d: spatial.grid_scan(places(s, d), *BOX, radius=400.0, hole=_ring(HOLE)).select("id"),
    "geo_reach_area": lambda s, d: spatial.in_area(places(s, d), _area(10)).select("id"),
    "geo_reach_box": lambda s, d: _boxes(s),
    "search_categories": lambda s, d: search.resolve_category(_asked(s, d), *_taxonomy(s)),
    "search_scope_slack": lambda s, d: search.in_scope(places(s, d), F.col("lat") > 90, F.col("lat") > 35.05).select("id"),
    "list_hull_of_one": lambda s, d: candidates.hulls(places(s, d).select("id", F.col("id").alias("group"), F.col("id").alias("pos"), "lat", "lng"), 100.0, 4).select("group", F.size("ring").alias("corners"), F.round(F.array_max(F.transform("ring", lambda p: p["lat"])), 7).alias("north")),
}

_SCAN = BASE + f", m AS (SELECT 35.035::DOUBLE AS lat, 139.04::DOUBLE AS lng), k AS (SELECT 400 * sqrt(3) * 0.95::DOUBLE AS step, 400 * 1.5::DOUBLE * 0.95::DOUBLE AS rise, 111320.0::DOUBLE * cos(radians(35.035::DOUBLE)) AS w), half AS (SELECT greatest((35.05::DOUBLE - 35.02::DOUBLE) * 110540.0::DOUBLE, (139.06::DOUBLE - 139.02::DOUBLE) * w) / 2 AS h FROM k), c AS (SELECT 35.035::DOUBLE + r * rise / 110540.0::DOUBLE AS lat, 139.04::DOUBLE + (c + abs(r % 2) / 2.0::DOUBLE) * step / w AS lng FROM k, half, range(-60, 61) a(r), range(-60, 61) b(c) WHERE abs(r) <= ceil(h / rise) + 1 AND abs(c) <= ceil(h / step) + 1), f AS (SELECT * FROM c WHERE lat BETWEEN 35.02::DOUBLE - 400 / 110540.0::DOUBLE AND 35.05::DOUBLE + 400 / 110540.0::DOUBLE), near AS (SELECT p.id, p.lat, p.lng, {_far('m', 'p')} AS d FROM p, m WHERE EXISTS (SELECT 1 FROM f WHERE abs(f.lat - p.lat) < 0.01 AND abs(f.lng - p.lng) < 0.01 AND {_far('p', 'f')} <= 400))"
_ONE = "one AS (SELECT *, row_number() OVER (PARTITION BY floor(lat * 1000 + 0.5), floor(lng * 1000 + 0.5) ORDER BY d, id) AS r FROM {})"
ORACLE = {
    "assist_parse": "WITH t AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN '駅のカフェ' WHEN 1 THEN '塔の店' || (c_custkey % 5) ELSE 'なに' END AS text FROM customer) SELECT text, CASE WHEN text <> 'なに' THEN substr(text, 1, 1) END AS anchor, CASE WHEN text <> 'なに' THEN substr(text, 3) END AS target, CASE WHEN text = 'なに' THEN 'no answer' ELSE '' END AS problems FROM t",
    "assist_refined": "SELECT * FROM (VALUES ('a', false), ('b', true)) t(text, negate)",
    "assist_categories": BASE + """, k AS (SELECT id, id % 3 AS g, id % 5 = 0 AS bare, 'c' || (id % 6) AS x, 'c' || (id % 4) AS y FROM p), f AS (SELECT g, least(min(x), min(y)) AS c FROM k WHERE NOT bare GROUP BY 1), m AS (SELECT id, k.g, NOT bare AND k.g <> 2 AND (x = c OR y = c) AS gone FROM k JOIN f ON f.g = k.g)
SELECT id FROM m WHERE NOT gone OR g NOT IN (SELECT g FROM m WHERE NOT gone)""",
    "assist_rate": "SELECT c_name AS name, CASE WHEN c_name LIKE '%77' THEN 'unknown' ELSE ['definitely', 'probably', 'no', 'unknown'][c_custkey % 10 % 4 + 1] END AS relevance FROM customer",
    "assist_merge": BASE + ", g AS (SELECT id, id // 4 AS g, row_number() OVER (PARTITION BY id // 4 ORDER BY id) AS k FROM p), b AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.g = b.g AND a.k = 1 AND b.k = 2) SELECT id FROM g WHERE id NOT IN (SELECT CASE WHEN length(a::VARCHAR) >= length(b::VARCHAR) THEN b ELSE a END FROM b)",
    "assist_landmarks": "WITH t AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN '駅のカフェ' WHEN 1 THEN '塔の店' || (c_custkey % 5) ELSE 'なに' END AS text FROM customer) SELECT text, 0 AS pos, substr(text, 1, 1) AS name FROM t UNION ALL SELECT text, 1, '塔' FROM t",
    "assist_feedback": "SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN '駅のカフェ' WHEN 1 THEN '塔の店' || (c_custkey % 5) ELSE 'なに' END AS text, CASE WHEN c_custkey % 3 = 0 THEN 'narrow' ELSE '' END AS action FROM customer",
    "assist_converse": "SELECT conv_id, least(count(*), 3)::VARCHAR AS reply FROM conversations GROUP BY 1",
    "assist_roles": "SELECT * FROM (VALUES ('query', 'q'), ('proximity', 'proximity'), ('bbox', '(none)'), ('near', '(none)')) t(\"column\", role)",
    "assist_diagnosis": BASE + """, q AS (SELECT DISTINCT id // 30 AS query_id FROM p WHERE id % 30 < 3), t AS (SELECT id // 2 AS q, arg_min(id % 30, id) AS n FROM i GROUP BY 1), sure AS (SELECT DISTINCT id // 30 AS q FROM p JOIN t ON id // 30 = q AND id % 30 = n)
SELECT query_id, CASE WHEN query_id IN (SELECT q FROM sure) THEN NULL WHEN query_id % 3 = 0 THEN 'poi coverage' WHEN query_id % 3 = 1 THEN 'too ambiguous query' END AS reason, CASE WHEN query_id IN (SELECT q FROM sure) THEN 'match' WHEN query_id % 3 = 1 THEN 'unclear' ELSE 'model' END AS step FROM q""",
    "assist_checks": BASE + "SELECT id, 'ok' AS exists, CASE WHEN id % 2 = 0 THEN 'ok' ELSE 'ng' END AS name_current, 'unknown' AS address_current, 'unknown' AS tags_correct, CASE WHEN id % 3 <> 0 THEN 'unknown' WHEN id % 9 = 4 THEN 'ok' ELSE 'ng' END AS coord_match FROM p",
    "assist_batches": "WITH d AS (SELECT count(DISTINCT props) AS n FROM events), r AS (SELECT k, least(7, n - 7 * k) AS q FROM d, range(0, 100000) t(k) WHERE 7 * k < n) SELECT k // 3 AS job, count(*) AS requests, sum(q)::BIGINT AS queries FROM r GROUP BY 1",
    "assist_batch_labels": "SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN '駅のカフェ' WHEN 1 THEN '塔の店' || (c_custkey % 5) ELSE 'なに' END AS query, CASE WHEN c_custkey % 3 = 1 THEN 'poi' ELSE 'others' END AS label FROM customer",
    "geo_grid_scan": _SCAN + ", " + _ONE.format("near") + " SELECT id, floor(d + 0.5)::BIGINT AS distance FROM one WHERE r = 1",
    "geo_grid_hole": _SCAN + """, e(x1, y1, x2, y2) AS (VALUES (139.03::DOUBLE, 35.02::DOUBLE, 139.05::DOUBLE, 35.03::DOUBLE), (139.05::DOUBLE, 35.03::DOUBLE, 139.03::DOUBLE, 35.04::DOUBLE), (139.03::DOUBLE, 35.04::DOUBLE, 139.03::DOUBLE, 35.02::DOUBLE)),
o AS (SELECT n.* FROM near n WHERE (SELECT count(*) FROM e WHERE (y1 > n.lat) <> (y2 > n.lat) AND n.lng < x1 + (n.lat - y1) * (x2 - x1) / (y2 - y1)) % 2 = 0), """ + _ONE.format("o") + " SELECT id FROM one WHERE r = 1",
    "geo_reach_area": BASE + "SELECT id FROM p WHERE abs(lat - 35.05::DOUBLE) < 0.02005::DOUBLE AND abs(lng - 139.05::DOUBLE) < 0.02005::DOUBLE AND NOT (abs(lat - 35.05::DOUBLE) < 0.01005::DOUBLE AND abs(lng - 139.05::DOUBLE) < 0.01005::DOUBLE)",
    "geo_reach_box": "SELECT * FROM (VALUES (10, 139.034925::DOUBLE, 35.065075::DOUBLE, false), (50, 139.0::DOUBLE, 35.1::DOUBLE, true)) t(minutes, west, north, too_large)",
    "search_categories": "SELECT * FROM (VALUES ('牛丼屋', 'food>丼もの'), ('病院', 'medical>病院'), ('医院前', 'medical>病院'), ('丼もの', 'food>丼もの')) t(query, category) WHERE (SELECT count(*) FROM customer) > 6",
    "search_scope_slack": BASE + "SELECT id FROM p WHERE lat > 35.05::DOUBLE",
    "list_hull_of_one": BASE + "SELECT id AS \"group\", 4 AS corners, round(lat + 100 / 110540.0::DOUBLE, 7) AS north FROM p",
}
