"""Queries of the feedback log, layer scans, labels and requests over the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkfield.functions import geo, text
from larkfield.operators import advisors, compare, feedback, labels, layers, models, querylog, routes, search
from larkfield.operators.place_queries import _bearing, _compass, _far, _turn, _two_sides
from larkfield.plans import schema, search_poi
from larkfield.sources.tables import ITEMS_SQL, LOG_SQL, PLACES_SQL, from_sql, items, places, query_log, table

BASE = f"WITH p AS ({PLACES_SQL}), i AS ({ITEMS_SQL}) "

#: Events as a feedback log; written once for both engines.
LOG = """SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'state' ELSE 'ticket' END AS type, CAST(user_id AS VARCHAR(20)) AS key,
  CASE WHEN event_id % 11 <> 0 THEN concat('r', CAST(event_id % 5 AS VARCHAR(9))) END AS roundId, concat('t', CAST(event_id AS VARCHAR(20))) AS id,
  CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'no_issue' ELSE 'out_of_scope' END END AS state, CASE WHEN event_id % 6 = 3 THEN 'unknown query' END AS reason,
  CASE WHEN event_id % 4 = 0 THEN 'search_engine' ELSE 'data' END AS problemType, CASE WHEN event_id % 4 = 1 THEN 'poi_missing' WHEN event_id % 4 = 2 THEN 'address_wrong' END AS dataIssue,
  CASE WHEN event_id % 8 = 1 THEN 'bus' WHEN event_id % 8 = 5 THEN 'general' END AS dataSubtype, CASE WHEN event_id % 4 = 1 THEN 'add' WHEN event_id % 4 = 2 THEN 'fix' END AS action,
  CASE WHEN event_id % 7 = 0 THEN ' slow ' END AS note, props AS query, CASE WHEN event_id % 2 = 0 THEN 'log.csv' END AS fileName, CASE WHEN event_id % 2 = 0 THEN event_id END AS rowIndex,
  CAST(ts AS VARCHAR(40)) AS timestamp, CASE WHEN event_id % 22 = 0 THEN 'good' WHEN event_id % 11 = 0 THEN 'unclear' END AS result, CASE WHEN event_id % 33 = 0 THEN 'yes' END AS googleOk FROM events"""
ROWS = "SELECT event_id AS row_idx, CAST(event_id % 2000 AS VARCHAR(20)) AS key, event_type AS query_type, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE concat(CAST(event_id % 50 AS VARCHAR(9)), ' times') END AS query_count, props AS query FROM events"


#: The same with few states, so that some keys have tickets only.
SPARSE = LOG.replace("event_id % 3 = 0 THEN 'state'", "event_id % 1009 = 0 THEN 'state'")


def _log(s, d, sql=LOG):
    return from_sql(s, d, sql, "events").withColumn("searchEngineIssues", F.when(F.col("problemType") == "search_engine", F.when(F.col("seq") % 8 == 0, F.array(F.lit("fuzzy"), F.lit("rank"))).otherwise(F.array(F.lit("rank")))))


def _features(s, d):
    """Items as features: four layers, classes and stop types by id."""
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int"))
    return items(s, d).select(
        "id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("n"), (F.col("id") % 9).cast("string"))).alias("name"), "lat", "lng", pick("road", "transit_stop_label", "natural_label", "poi_label").alias("layer"),
        F.when((F.col("id") % 8).isin(0, 3), "intersection").when(F.col("id") % 8 == 4, "traffic_signals").when(F.col("id") % 8 == 7, "building").otherwise("primary").alias("class"), F.when(F.col("id") % 3 == 0, "bus").otherwise("metro").alias("mode"),
        F.when(F.col("id") % 2 == 1, F.when(F.col("id") % 16 == 1, "entrance").otherwise("stop")).alias("stop_type"), F.when(F.col("id") % 16 == 5, "entrance").alias("maki"), F.when(F.col("id") % 3 == 0, "Mall").alias("type"),
    )


FEATURES = """f AS (SELECT id, CASE WHEN id % 5 <> 0 THEN 'n' || (id % 9) END AS name, lat, lng, CASE id % 4 WHEN 0 THEN 'road' WHEN 1 THEN 'transit_stop_label' WHEN 2 THEN 'natural_label' ELSE 'poi_label' END AS layer,
  CASE WHEN id % 8 IN (0, 3) THEN 'intersection' WHEN id % 8 = 4 THEN 'traffic_signals' WHEN id % 8 = 7 THEN 'building' ELSE 'primary' END AS class, CASE WHEN id % 3 = 0 THEN 'bus' ELSE 'metro' END AS mode,
  CASE WHEN id % 2 = 1 THEN CASE WHEN id % 16 = 1 THEN 'entrance' ELSE 'stop' END END AS stop_type, CASE WHEN id % 16 = 5 THEN 'entrance' END AS maki, CASE WHEN id % 3 = 0 THEN 'Mall' END AS type,
  power(sin((radians(lat) - radians(35.05::DOUBLE)) / 2), 2) + cos(radians(lat)) * cos(radians(35.05::DOUBLE)) * power(sin((radians(lng) - radians(139.05::DOUBLE)) / 2), 2) AS s FROM i),
g AS (SELECT *, 2 * 6371008.8::DOUBLE * atan2(sqrt(s), sqrt(1 - s)) AS d FROM f)"""

REQUEST = {
    "proximity": {"anchors": [{"text": "新宿駅"}], "within": {"maxMinutes": 5}, "bearing_filter": "north"},
    "target": {"text": "カフェ", "floors": {"min": 5}},
    "conditions": [{"type": "poi", "text": "a", "distance": {"level": "adjacent"}}, {"type": "road", "text": "b", "negate": True, "distance": {"minutes": 3}}, {"type": "poi", "text": "c", "distance": {"level": "same_building"}}],
}
ROLE_OF = {"row_idx": "(none)", "proximity": "proximity", "bbox": "bbox", "query": "q", "poi_category": "poi_category", "navigation_profile": "navigation_profile"}


def _wordings(s, d):
    word = F.element_at(F.array(*map(F.lit, ("東口バス停", "Bus Stop 3", "緑マンション", "ビジネスホテル", "指定緊急避難所", "荒川", "shop", "SHELTER a", "中央公園"))), (F.col("id") % 9 + 1).cast("int"))
    return places(s, d).select("id", word.alias("q"))


def _duplicated(s, d):
    listed = places(s, d).select((F.col("id") % 500).alias("group"), F.floor(F.col("id") / 500).alias("pos"), "id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("id") % 7).cast("double").alias("distance"))
    return search.merged(listed, s.sql("select explode(sequence(0L, 499L)) as group").select("group", F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for k, (a, b) in enumerate([(0, 1), (1, 2)])))).alias("m")).select("group", "m.*"))


def _guesses(s, d):
    """Nations as guessed places, some of one cell."""
    return table(s, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("text"), (35 + F.col("n_nationkey") % 7 / 100).alias("lat"), (139 + F.col("n_nationkey") % 3 / 100).alias("lng"))


def _said(s, d, *words):
    """Places with one of the words each, in turn."""
    return places(s, d).select("id", F.element_at(F.array(*map(F.lit, words)), (F.col("id") % len(words) + 1).cast("int")).alias("said"))


def _scored(s, d):
    return places(s, d).select("id", F.when(F.col("id") % 9 == 0, "partial").otherwise("none").alias("class"), "lat", "lng")


def _lines(s, d):
    """Four crossing routes as lines."""
    return s.createDataFrame([(k, [(139.0 + 0.01 * k, 35.0), (139.05, 35.05), (139.1 - 0.01 * k, 35.1)]) for k in range(4)], "id int, line array<struct<lng:double,lat:double>>")


def _with_roads(s, d):
    """Two streets a place, one of them through it."""
    line = lambda dy: F.array(F.struct((F.col("lng") - 0.001).alias("lng"), (F.col("lat") - dy).alias("lat")), F.struct((F.col("lng") + 0.001).alias("lng"), (F.col("lat") + dy).alias("lat")))
    both = F.explode(F.array(F.struct(F.lit("a").alias("road"), line(0.0).alias("line")), F.struct(F.lit("b").alias("road"), F.when(F.col("id") % 3 == 0, line(0.001)).otherwise(F.transform(line(0.001), lambda x: F.struct(x["lng"].alias("lng"), (x["lat"] + 0.01).alias("lat")))).alias("line"))))
    return places(s, d).select("id", "lat", "lng", both.alias("r")).select("id", "lat", "lng", "r.*")


def _routes(s, d):
    step = lambda name, kind: F.struct(F.array(F.lit(kind)).alias("classes"), F.struct(name.alias("name")).alias("ic"), F.struct(F.lit(None).cast("string").alias("name")).alias("jct"))
    steps = F.array(F.struct(F.array(step(F.lit("A"), "motorway"), step(F.concat(F.lit("B"), (F.col("id") % 3).cast("string")), "street"), step(F.lit("A"), "street")).alias("intersections")))
    return places(s, d).select(F.col("id").alias("route_id"), F.array(F.struct(steps.alias("steps"))).alias("legs"))


PLAN = {"prox": {"anc": [{"ty": "poi", "tx": "Customer#000000005"}], "wi": {"mnMi": 10, "mxMi": 60}}, "tgt": {"tx": "Customer"}, "cond": [{"ty": "poi", "tx": "Customer#00000001", "d": {"lv": "somewhat_nearby"}}]}

_WORDS = {"bus_stop": text.asks_bus_stop, "shelter": text.asks_shelter, "building": text.asks_building, "natural": text.natural_target}
QUERIES = {
    "feedback_history": lambda s, d: feedback.history(_log(s, d)),
    "feedback_current": lambda s, d: feedback.current(_log(s, d)).withColumn("issues", F.array_join("issues", ",")),
    "feedback_badges": lambda s, d: feedback.current(_log(s, d)).select("key", feedback.badge(F.col("state"), F.col("tickets")).alias("badge")),
    "feedback_round_tickets": lambda s, d: feedback.round_tickets(_log(s, d), "8", "r1").select("seq"),
    "feedback_drafts": lambda s, d: feedback.tickets_of_drafts(_log(s, d)).select("seq", "dataIssue", "dataSubtype", "action", "note"),
    "feedback_reasons": lambda s, d: _log(s, d).select("seq", feedback.ticket_of_reason(F.when(F.col("seq") % 3 == 0, "poi coverage (bus)").when(F.col("seq") % 3 == 1, "odd")).alias("t")).select("seq", "t.problemType", "t.dataIssue", "t.dataSubtype", "t.action", F.array_join("t.searchEngineIssues", ",").alias("issues"), "t.note"),
    "feedback_accepted": lambda s, d: feedback.accepted(table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.lit("r").alias("roundId"), F.when(F.col("n_nationkey") % 3 == 0, "out_of_scope").otherwise("in_scope").alias("scope"), F.lit(None).cast("string").alias("outOfScopeReason"), F.when(F.col("n_nationkey") % 3 == 1, F.array(feedback.ticket_of_reason(F.lit("wrong poi")), feedback.ticket_of_reason(F.lit(None).cast("string")))).alias("tickets"))).select("key", "type", "state", "reason", "dataIssue", "action"),
    "feedback_select_problem": lambda s, d: feedback.select_rows(from_sql(s, d, ROWS, "events"), feedback.current(_log(s, d, SPARSE)), "problem", "poi_missing", ["click", "view"], 1).select("row_idx"),
    "feedback_select_untested": lambda s, d: feedback.select_rows(from_sql(s, d, ROWS, "events"), feedback.current(_log(s, d)), "untested", text=" CLICK ", order="query_count", descending=True).select("row_idx"),
    "feedback_select_scope": lambda s, d: feedback.select_rows(from_sql(s, d, ROWS, "events"), feedback.current(_log(s, d)), reason="unknown query").select("row_idx"),
    "compare_place_matches": lambda s, d: compare.place_matches(*_two_sides(s, d)),
    "compare_top_corroborated": lambda s, d: compare.top_corroborated(*_two_sides(s, d)),
    "compare_diagnosis_rows": lambda s, d: compare.diagnosis_rows(*_two_sides(s, d), F.lit(35.05), F.lit(139.05)).select("query_id", "rank", "row"),
    "compare_one_shape": lambda s, d: compare.one_shape(places(s, d).select(F.lit(1).alias("query_id"), F.col("id").alias("rank"), F.col("id").cast("string").alias("id"), F.struct(F.when(F.col("id") % 2 == 0, F.col("name")).alias("text")).alias("displayName"), F.lit("a").alias("formattedAddress"), F.when(F.col("id") % 5 != 0, F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude"))).alias("location"), F.lit(None).cast("array<string>").alias("types")), "new").drop("types"),
    "layer_bus_stops": lambda s, d: layers.bus_stops(_features(s, d), 35.05, 139.05, 6000.0).select("id", "distance"),
    "layer_entrances": lambda s, d: layers.entrances(_features(s, d), 35.0571, 139.0007, 6000.0).select("id", "distance"),
    "layer_intersections": lambda s, d: layers.intersections(_features(s, d), 35.05, 139.05, 6000.0, "N8").select("id", "distance"),
    "layer_signals": lambda s, d: layers.signals(_features(s, d), 35.05, 139.05, 6000.0, 20).select("id", "distance"),
    "layer_buildings": lambda s, d: layers.buildings(_features(s, d), 35.05, 139.05, 6000.0).select("id", "distance"),
    "layer_malls": lambda s, d: layers.malls(_features(s, d), 35.05, 139.05, 6000.0).select("id", "name"),
    "layer_natural": lambda s, d: layers.natural_features(_features(s, d), 35.05, 139.05, 6000.0).select("id", "layer", "distance"),
    "layer_streets": lambda s, d: layers.street_features(_features(s, d), 35.05, 139.05, 6000.0).select("id", "layer", "category", "distance"),
    "layer_routable": lambda s, d: layers.routable(places(s, d).select("id", "lat", "lng", F.when(F.col("id") % 2 == 0, F.array(F.struct((F.col("lng") + 1).alias("lng"), (F.col("lat") + 1).alias("lat")))).alias("routable"))).select("id", "lat", "lng"),
    "text_asks": lambda s, d: _wordings(s, d).select("id", *(f(F.col("q")).alias(n) for n, f in _WORDS.items()), F.coalesce(text.asked_class(F.col("q")), F.lit("")).alias("class")),
    "text_labels_of_numbers": lambda s, d: places(s, d).select("id", F.array_join(text.labels_of_numbers(F.array((F.col("id") % 9).cast("int"), F.lit(4))), ",").alias("labels")),
    "text_unfenced": lambda s, d: places(s, d).select("id", text.unfenced(F.when(F.col("id") % 2 == 0, F.concat(F.lit("```json\n["), F.col("id").cast("string"), F.lit("]\n```"))).otherwise(F.concat(F.lit(" ["), F.col("id").cast("string"), F.lit("] ")))).alias("answer")),
    "search_basis": lambda s, d: search.basis(_scored(s, d)).select("id"),
    "search_subnames": lambda s, d: search.subnames(table(s, d, "part").select(F.concat("p_brand", F.lit(">"), "p_type").alias("id"))).withColumn("ids", F.array_join("ids", ",")),
    "search_category_set": lambda s, d: search.category_set(table(s, d, "part").select(F.array("p_brand", "p_type").alias("poi_category"))),
    "search_did_you_mean": lambda s, d: search.did_you_mean(_guesses(s, d), items(s, d).select(F.col("id").alias("pos"), F.col("name").alias("text"), "lat", "lng"), 30).select("text"),
    "search_merged": lambda s, d: _duplicated(s, d).select("id"),
    "search_centroid": lambda s, d: search.centroid(places(s, d)).select(F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng")),
    "search_text": lambda s, d: search_poi.text_search(places(s, d), "Customer#00000001", near=(35.05, 139.05), specificity="unique").select("id"),
    "search_plain": lambda s, d: search_poi.plain_search(places(s, d), "00001").select("rank", "id"),
    "search_grounded": lambda s, d: search_poi.grounded(table(s, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.concat(F.lit("CUSTOMER # "), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("text")), places(s, d)).select("pos", "id"),
    "label_reasons": lambda s, d: places(s, d).select("id", F.array_join(labels.reasons(REQUEST, (F.col("id") % 9).cast("int"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b")))), "|").alias("reasons")),
    "box_circle": lambda s, d: places(s, d).select("id", geo.circle_box(F.col("lat"), F.col("lng"), F.lit(500.0)).alias("b")).select("id", F.round(geo.box_circle(F.col("b"))["radius"], 0).alias("radius")),
    "box_corridor": lambda s, d: places(s, d).select("id", geo.corridor_box(F.col("lat"), F.col("lng"), F.lit(35.05), F.lit(139.05), half_m=None).alias("b")).select("id", F.round("b.min_lat", 7).alias("south"), F.round("b.max_lat", 7).alias("north")),
    "geo_implied_travel": lambda s, d: places(s, d).select("id", F.explode(geo.implied_travel(F.col("lat"), F.col("lng"), True, 1.0, F.lit(90.0))).alias("c")).select("id", "c.position", "c.direction"),
    "geo_corners": lambda s, d: advisors.corners(_with_roads(s, d)),
    "route_coverage": lambda s, d: advisors.route_coverage(places(s, d), _lines(s, d), 600.0).select("id", "routes", "share"),
    "route_info": lambda s, d: routes.route_info(_routes(s, d)).select("route_id", F.array_join("interchanges", ",").alias("interchanges"), "motorway", "entry", "exit"),
    "search_plan": lambda s, d: search_poi.search_poi(places(s, d), PLAN),
    "search_narrowed": lambda s, d: search_poi.narrowed(places(s, d), items(s, d).where("height = 7"), 250.0).select("id"),
    "model_ask": lambda s, d: models.parsed(models.ask(table(s, d, "nation").select(F.to_json(F.struct("n_nationkey")).alias("payload")), lambda p: p if "1" in p else "no json"), "n_nationkey bigint").select("payload", F.col("value.n_nationkey").alias("key")),
    "log_values_in_order": lambda s, d: querylog.values_in_order(query_log(s, d), "ai_classification"),
    "log_requests": lambda s, d: querylog.requests_of_rows(query_log(s, d), ROLE_OF).select("row_idx", "query", "lat", "lng", "bbox", "navigation_profile", F.array_join("poi_category", ",").alias("poi_category")),
    "log_visible_columns": lambda s, d: querylog.visible_columns(query_log(s, d), ROLE_OF).distinct(),
    "layer_shelters": lambda s, d: layers.shelters(_features(s, d).withColumn("layer", F.regexp_replace("layer", "natural_label", "shelter")), 35.05, 139.05, 9000.0, "Ｎ").select("id", "distance"),
    "text_clean_names": lambda s, d: places(s, d).select("id", text.clean_name(F.concat(F.lit("\u200b"), "name", F.lit("\ufeff"))).alias("name")),
    "text_search_numerals": lambda s, d: _said(s, d, "東 二十三丁目", "西百五番地", "中〇八号", "しょう 一〇条").select("id", text.normalised_search_name("said").alias("name")),
    "text_corporate_names": lambda s, d: _said(s, d, "株式会社 髙島屋", "（有）渡邊商店", "ＡＢＣ・ストア", "霞ヶ関ビル").select("id", text.normalised_name("said").alias("name")),
    "text_addresses": lambda s, d: _said(s, d, "日本、〒106-0032 東京都港区六本木三丁目2番1号 森ビル", "青森県上北郡六戸町大字犬落瀬1", "東京都港区1-2 ビル3F").select("id", text.normalised_address("said").alias("address")),
    "text_inferred_floors": lambda s, d: _said(s, d, "10階建て以上", "3階以下", "5階の店", "タワマン", "背の高い建物", "平屋", "店").select("id", text.inferred_floors(F.col("said")).alias("f")).select("id", "f.value", "f.min", "f.max"),
    "text_choice_numbers": lambda s, d: _said(s, d, "２番で", "三つ目", "12", "はい").select("id", text.choice_number(F.col("said")).alias("choice")),
    "text_near_labels": lambda s, d: places(s, d).select("id", text.near_label(F.when(F.col("id") % 5 != 0, F.col("id") % 90 / 8)).alias("label")),
    "text_address_types": lambda s, d: _said(s, d, " Address", "place", "ADDRESS ").select("id", text.is_address_type(F.col("said")).alias("address")),
    "scalar_planar": lambda s, d: places(s, d).select("id", F.round(geo.planar(F.col("lat"), F.col("lng"), F.lit(35.05), F.lit(139.05)), 3).alias("metres")),
    "geo_feature_box": lambda s, d: places(s, d).select("id", geo.feature_box(F.when(F.col("id") % 2 == 0, geo.make_box(F.col("lng"), F.col("lat"), F.col("lng") + 1, F.col("lat") + 1)), F.col("lat"), F.col("lng")).alias("b")).select("id", *(F.round(f"b.{c}", 7).alias(c) for c in ("min_lng", "min_lat", "max_lng", "max_lat"))),
    "log_category_order": lambda s, d: _said(s, d, "others", "poi", "address", "strange").select(F.col("said").alias("ai_classification")).distinct().select("ai_classification", querylog.category_rank().alias("place")),
    "log_head": lambda s, d: query_log(s, d).where(F.col("row_idx") < 3 * 30).select("row_idx", "query"),
    "plan_conditions": lambda s, d: s.createDataFrame([(c["type"], c["distance"]["level"], c["negate"]) for c in schema.with_defaults(REQUEST | {"conditions": REQUEST["conditions"] * 2}, most=9)["conditions"]], "type string, level string, negate boolean"),
    "plan_dropped": lambda s, d: s.createDataFrame([(x,) for x in schema.with_defaults(REQUEST | {"conditions": REQUEST["conditions"] * 2})["dropped_conditions"]], "name string"),
    "plan_problems": lambda s, d: s.createDataFrame([(x,) for x in schema.problems({"conditions": [{"type": "poi"}, {"text": "a"}]})], "problem string"),
    "plan_inferred_reach": lambda s, d: s.createDataFrame([(w, f.get("maxMinutes"), f.get("maxMeters")) for w in ("徒歩10分", "1.5km以内", "300m以内", "車で5分") if (f := text.inferred_reach(w))], "wording string, minutes int, metres int"),
    "plan_reaches": lambda s, d: s.createDataFrame([(v, search.reach_of({"level": v}).by_building, search.reach_of({"level": v}).pushback, float(search.reach_of({"level": v}).reference_m)) for v in ("same_building", "adjacent", "nearby", "far")], "level string, by_building boolean, pushback boolean, reference_m double"),
    "log_summary_payload": lambda s, d: querylog.summary_payload(query_log(s, d)),
}

_L = f"WITH log AS ({LOG}), e AS (SELECT *, CASE WHEN problemType = 'search_engine' THEN CASE WHEN seq % 8 = 0 THEN ['fuzzy', 'rank'] ELSE ['rank'] END END AS issues FROM log), "
_CUR = """last AS (SELECT key AS k, arg_max(roundId, seq) AS r FROM e WHERE roundId IS NOT NULL GROUP BY 1), now AS (SELECT e.* FROM e JOIN last ON key = k AND roundId = r),
st AS (SELECT key, count(*) FILTER (type = 'state') AS ns, arg_min(coalesce(state, ''), seq) FILTER (type = 'state') AS s, arg_min(coalesce(reason, ''), seq) FILTER (type = 'state') AS why, count(*) FILTER (type = 'ticket') AS nt FROM now GROUP BY 1),
iss AS (SELECT key, list(DISTINCT x ORDER BY x) AS xs FROM (SELECT key, dataIssue AS x FROM now WHERE type = 'ticket' UNION ALL SELECT key, unnest(issues) FROM now WHERE type = 'ticket') WHERE x IS NOT NULL GROUP BY 1),
cur AS (SELECT st.key, CASE WHEN ns > 0 THEN s ELSE 'problem' END AS state, CASE WHEN ns > 0 THEN nullif(why, '') END AS reason, CASE WHEN ns = 0 THEN coalesce(xs, []) END AS issues, CASE WHEN ns = 0 THEN nt ELSE 0 END AS tickets FROM st LEFT JOIN iss ON st.key = iss.key WHERE ns + nt > 0)"""
_ROWS = f", rws AS ({ROWS}), z AS (SELECT r.*, c.key AS ck, c.state, c.reason, c.issues, CASE WHEN query_count = 'x' THEN 0 ELSE split_part(query_count, ' ', 1)::INT END AS n FROM rws r LEFT JOIN cur c ON r.key = c.key)"
_G = BASE + ", " + FEATURES
_ROUND = "floor(d + 0.5)::BIGINT AS distance"
_PLACE = "(SELECT DISTINCT l.q, l.r FROM l JOIN o ON l.q = o.q AND (ends_with(l.a, o.a) OR ends_with(o.a, l.a) OR l.m <= 50))"
_MATCHED = BASE + f""", m AS (SELECT p.id // 30 AS query_id, p.id AS rank, CASE WHEN max((coalesce(('tokyo1-' || p.id % 23) LIKE '%' || ('tokyo1-' || i.id % 23), false) OR coalesce(('tokyo1-' || i.id % 23) LIKE '%' || ('tokyo1-' || p.id % 23), false)
  OR coalesce({_far('p', 'i', '6371000.0')} <= 50, false))::INT) = 1 THEN 'address' ELSE 'none' END AS match FROM p LEFT JOIN i ON p.id // 30 = i.id // 2 GROUP BY 1, 2)"""
ORACLE = {
    "feedback_history": _L + """x AS (SELECT 1) SELECT seq, timestamp, coalesce(fileName, '') AS fileName, coalesce((rowIndex + 1)::VARCHAR, '') AS rowIndex, query,
  CASE type WHEN 'ticket' THEN CASE WHEN problemType = 'data' THEN '🐞 Ticket (Data)' ELSE '🐞 Ticket (Search Engine)' END WHEN 'state' THEN CASE state WHEN 'no_issue' THEN '✅ No Issue' ELSE '➖ Out of scope' END ELSE CASE result WHEN 'good' THEN '👍' WHEN 'unclear' THEN 'Unclear' ELSE '' END END AS result,
  CASE WHEN type = 'ticket' THEN CASE WHEN problemType = 'data' THEN concat(CASE dataIssue WHEN 'poi_missing' THEN 'poi coverage' WHEN 'address_wrong' THEN 'wrong address' ELSE '' END, CASE WHEN dataSubtype = 'bus' THEN '(Bus stop)' ELSE '' END, ' → ', CASE action WHEN 'add' THEN 'Add' WHEN 'fix' THEN 'Fix' ELSE '' END) ELSE array_to_string(issues, ', ') END ELSE coalesce(reason, '') END AS reason,
  CASE WHEN type = 'ticket' THEN coalesce(note, '') ELSE '' END AS note, CASE WHEN type IS NOT NULL THEN '-' ELSE coalesce(googleOk, '-') END AS googleOk FROM e""",
    "feedback_current": _L + _CUR + " SELECT key, state, reason, array_to_string(issues, ',') AS issues, tickets FROM cur",
    "feedback_badges": _L + _CUR + " SELECT key, CASE state WHEN 'no_issue' THEN '✅' WHEN 'out_of_scope' THEN '➖' ELSE '🐞×' || tickets END AS badge FROM cur",
    "feedback_round_tickets": _L + "x AS (SELECT 1) SELECT seq FROM e WHERE type = 'ticket' AND key = '8' AND roundId = 'r1'",
    "feedback_drafts": _L + """x AS (SELECT 1) SELECT seq, dataIssue, CASE WHEN dataIssue = 'poi_missing' THEN coalesce(dataSubtype, 'general') END AS dataSubtype, action, trim(note) AS note FROM e
WHERE (problemType = 'data' AND dataIssue IS NOT NULL AND action IS NOT NULL) OR problemType = 'search_engine'""",
    "feedback_reasons": """SELECT event_id AS seq, CASE WHEN event_id % 3 = 1 THEN 'search_engine' ELSE 'data' END AS problemType, CASE WHEN event_id % 3 <> 1 THEN 'poi_missing' END AS dataIssue, CASE event_id % 3 WHEN 0 THEN 'bus' WHEN 2 THEN 'general' END AS dataSubtype, CASE WHEN event_id % 3 <> 1 THEN 'add' END AS action,
  CASE WHEN event_id % 3 = 1 THEN 'odd' END AS issues, CASE event_id % 3 WHEN 0 THEN 'AI diagnosis' WHEN 1 THEN 'AI diagnosis (unexpected tag)' ELSE 'AI diagnosis: no match on either side' END AS note FROM events""",
    "feedback_accepted": """SELECT n_nationkey AS key, CASE WHEN n_nationkey % 3 = 1 THEN 'ticket' ELSE 'state' END AS type, CASE n_nationkey % 3 WHEN 0 THEN 'out_of_scope' WHEN 2 THEN 'no_issue' END AS state, CASE WHEN n_nationkey % 3 = 0 THEN 'unknown query' END AS reason, x AS dataIssue, y AS action
FROM nation LEFT JOIN (VALUES (1, 'poi_attribute_wrong', 'fix'), (1, 'poi_missing', 'add')) t(m, x, y) ON n_nationkey % 3 = m""",
    "feedback_select_problem": _L.replace(LOG, SPARSE) + _CUR + _ROWS + " SELECT row_idx FROM z WHERE state = 'problem' AND list_contains(issues, 'poi_missing') AND query_type IN ('click', 'view') AND n >= 1",
    "feedback_select_untested": _L + _CUR + _ROWS + " SELECT row_idx FROM z WHERE ck IS NULL AND contains(lower(concat_ws(' ', row_idx, key, query_type, query_count, query)), 'click')",
    "feedback_select_scope": _L + _CUR + _ROWS + " SELECT row_idx FROM z WHERE (state = 'problem' AND list_contains(issues, 'unknown query')) OR (state = 'out_of_scope' AND reason = 'unknown query')",
    "compare_one_shape": BASE + "SELECT 1 AS query_id, id AS rank, id::VARCHAR AS id, CASE WHEN id % 2 = 0 THEN name ELSE '' END AS name, 'a' AS address, CASE WHEN id % 5 <> 0 THEN lat ELSE 0 END AS lat, CASE WHEN id % 5 <> 0 THEN lng ELSE 0 END AS lng FROM p",
    "compare_top_corroborated": BASE + ", t AS (SELECT id // 2 AS q, arg_min(id % 30, id) AS n FROM i GROUP BY 1) SELECT id // 30 AS query_id, min(id) AS rank FROM p JOIN t ON id // 30 = q AND id % 30 = n GROUP BY 1",
    "compare_place_matches": _MATCHED + " SELECT query_id, rank, match FROM m",
    "compare_diagnosis_rows": _MATCHED + f", o AS (SELECT 35.05::DOUBLE AS lat, 139.05::DOUBLE AS lng), f AS (SELECT p.id, {_far('o', 'p', '6371000.0')} AS d FROM p, o) SELECT query_id, rank, '(株) Shop-' || (rank % 30) || '|' || match || '|' || CASE WHEN d < 1000 THEN floor(d + 0.5)::BIGINT || 'm' ELSE printf('%.1f', d / 1000) || 'km' END AS row FROM m JOIN f ON f.id = rank",
    "layer_bus_stops": _G + f", c AS (SELECT *, row_number() OVER (PARTITION BY floor(lat * 1000 + 0.5), floor(lng * 1000 + 0.5) ORDER BY d, id) AS r FROM g WHERE layer = 'transit_stop_label' AND mode = 'bus' AND stop_type = 'stop' AND d <= 6000) SELECT id, {_ROUND} FROM c WHERE r = 1 ORDER BY d, id LIMIT 50",
    "layer_entrances": _G + f", o AS (SELECT 35.0571::DOUBLE AS lat, 139.0007::DOUBLE AS lng), z AS (SELECT f.id, {_far('o', 'f')} AS d FROM f, o WHERE layer = 'transit_stop_label' AND (stop_type = 'entrance' OR maki = 'entrance')) SELECT id, {_ROUND} FROM z WHERE d <= 500 ORDER BY d, id LIMIT 50",
    "layer_intersections": _G + f" SELECT id, {_ROUND} FROM g WHERE layer = 'road' AND class = 'intersection' AND name = 'n8' AND d <= 6000 ORDER BY d, id LIMIT 50",
    "layer_signals": _G + f", c AS (SELECT *, row_number() OVER (PARTITION BY floor(lat * 1000 + 0.5), floor(lng * 1000 + 0.5) ORDER BY d, id) AS r FROM g WHERE layer = 'road' AND class = 'traffic_signals' AND d <= 6000) SELECT id, {_ROUND} FROM c WHERE r = 1 ORDER BY d, id LIMIT 20",
    "layer_buildings": _G + f" SELECT id, {_ROUND} FROM g WHERE layer = 'poi_label' AND class = 'building' AND name IS NOT NULL AND d <= 6000 ORDER BY d, id LIMIT 50",
    "layer_malls": _G + " SELECT id, name FROM (SELECT * FROM g WHERE d <= 6000 ORDER BY d, id LIMIT 50) WHERE name IS NOT NULL AND type = 'Mall'",
    "layer_natural": _G + f", c AS (SELECT *, row_number() OVER (PARTITION BY coalesce(name, id::VARCHAR) ORDER BY d, id) AS r FROM g WHERE layer = 'natural_label' AND d <= 6000) SELECT id, layer, {_ROUND} FROM c WHERE r = 1 ORDER BY d, id LIMIT 50",
    "layer_streets": _G + f", c AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN layer = 'road' AND name IS NOT NULL THEN name ELSE layer || id END ORDER BY d, id) AS r FROM g WHERE layer IN ('road', 'transit_stop_label') AND d <= 6000) SELECT id, layer, CASE WHEN layer = 'road' THEN CASE WHEN class = 'primary' THEN 'road' ELSE CASE WHEN class = 'building' THEN 'other' ELSE 'point' END END END AS category, {_ROUND} FROM c WHERE r = 1 ORDER BY d, id LIMIT 25",
    "layer_routable": BASE + "SELECT id, CASE WHEN id % 2 = 0 THEN lat + 1 ELSE lat END AS lat, CASE WHEN id % 2 = 0 THEN lng + 1 ELSE lng END AS lng FROM p",
    "text_asks": BASE + "SELECT id, id % 9 IN (0, 1) AS bus_stop, id % 9 IN (4, 7) AS shelter, id % 9 = 2 AS building, id % 9 IN (5, 8) AS natural, CASE WHEN id % 9 = 3 THEN 'lodging' ELSE '' END AS class FROM p",
    "text_labels_of_numbers": BASE + "SELECT id, coalesce(['poi', 'poi_brand', 'poi_category', 'address', 'unsupported_query_location_intent', 'broken_query', 'others'][id % 9], 'others') || ',address' AS labels FROM p",
    "text_unfenced": BASE + "SELECT id, '[' || id || ']' AS answer FROM p",
    "search_basis": BASE + "SELECT id FROM p WHERE id % 9 = 0",
    "search_subnames": "SELECT p_type AS name, array_to_string(list(DISTINCT p_brand || '>' || p_type ORDER BY p_brand || '>' || p_type), ',') AS ids FROM part GROUP BY 1",
    "search_category_set": "SELECT p_brand AS category FROM part UNION SELECT p_type FROM part",
    "search_did_you_mean": BASE + ", b AS (SELECT 0 AS s, n_nationkey AS id, n_name AS name, 35 + n_nationkey % 7 / 100.0::DOUBLE AS lat, 139 + n_nationkey % 3 / 100.0::DOUBLE AS lng FROM nation UNION ALL SELECT 1, id, name, lat, lng FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY floor(lat * 3000 + 0.5), floor(lng * 3000 + 0.5) ORDER BY s, id) AS r FROM b) SELECT name AS text FROM r WHERE r = 1 ORDER BY s, id LIMIT 30",
    "search_centroid": BASE + "SELECT round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM p",
    "search_plain": BASE + "SELECT row_number() OVER (ORDER BY id) AS rank, id FROM (SELECT id FROM p WHERE contains(name, '00001') ORDER BY id LIMIT 30)",
    "search_grounded": BASE + "SELECT i.id AS pos, p.id AS id FROM i JOIN p ON i.id = p.id",
    "label_reasons": BASE + "SELECT id, concat_ws('|', CASE WHEN id % 9 >= 5 THEN '✔️ 5階建て以上（' || (id % 9) || '階相当）' END, CASE WHEN id % 2 = 0 THEN '✔️ すぐ近くにa' END, CASE WHEN id % 2 = 0 THEN '✔️ 近くにb（ではない）' END, '✔️ 同じビルにc') AS reasons FROM p",
    "box_circle": BASE + "SELECT id, 500.0::DOUBLE AS radius FROM p",
    "box_corridor": BASE + "SELECT id, round(least(lat, 35.05::DOUBLE) - 500 / 111000.0::DOUBLE, 7) AS south, round(greatest(lat, 35.05::DOUBLE) + 500 / 111000.0::DOUBLE, 7) AS north FROM p",
    "geo_corners": BASE + "SELECT id, id % 3 = 0 AS corner FROM p",
    "route_info": BASE + "SELECT id AS route_id, 'A,B' || (id % 3) AS interchanges, true AS motorway, 'A' AS entry, 'B' || (id % 3) AS exit FROM p",
    "search_narrowed": BASE + ", b AS (SELECT min(lng) - 250 / (111320.0::DOUBLE * cos(radians(avg(lat)))) AS a, min(lat) - 250 / 110540.0::DOUBLE AS b, max(lng) + 250 / (111320.0::DOUBLE * cos(radians(avg(lat)))) AS c, max(lat) + 250 / 110540.0::DOUBLE AS d FROM i WHERE height = 7) SELECT id FROM p, b WHERE lng BETWEEN a AND c AND lat BETWEEN b AND d",
    "model_ask": """SELECT '{"n_nationkey":' || n_nationkey || '}' AS payload, CASE WHEN contains(n_nationkey::VARCHAR, '1') THEN n_nationkey END AS key FROM nation""",
    "log_values_in_order": f"WITH log AS ({LOG_SQL}) SELECT ai_classification AS value, min(row_idx) AS first_idx FROM log WHERE trim(ai_classification) <> '' GROUP BY 1",
    "log_visible_columns": f"WITH log AS ({LOG_SQL}) SELECT DISTINCT query, proximity, bbox, poi_category, navigation_profile FROM log",
    "log_requests": f"""WITH log AS ({LOG_SQL}), x AS (SELECT *, string_split(trim(proximity), ',') AS v FROM log), y AS (SELECT *, CASE WHEN len(v) = 2 THEN try_cast(v[1] AS DOUBLE) END AS a, CASE WHEN len(v) = 2 THEN try_cast(v[2] AS DOUBLE) END AS b FROM x)
SELECT row_idx, nullif(trim(query), '') AS query, CASE WHEN a IS NOT NULL THEN b END AS lat, CASE WHEN b IS NOT NULL THEN a END AS lng, nullif(trim(bbox), '') AS bbox, nullif(trim(navigation_profile), '') AS navigation_profile, nullif(trim(poi_category), '') AS poi_category FROM y""",
    "search_merged": BASE + """, l AS (SELECT id % 500 AS g, id // 500 AS k, id, length('n' || id) AS n, id % 7 AS d FROM p), m AS (SELECT a.g, a.k AS step, CASE WHEN a.n > b.n OR (a.n = b.n AND a.d <= b.d) THEN b.k ELSE a.k END AS x FROM l a JOIN l b ON a.g = b.g AND b.k = a.k + 1 WHERE a.k IN (0, 1)),
z AS (SELECT g, x FROM m WHERE step = 0 UNION SELECT g, x FROM m t WHERE step = 1 AND NOT EXISTS (SELECT 1 FROM m f WHERE f.g = t.g AND f.step = 0 AND f.x = 1)) SELECT id FROM l WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.g = l.g AND z.x = l.k)""",
    "search_text": BASE + f", o AS (SELECT 35.05::DOUBLE AS lat, 139.05::DOUBLE AS lng) SELECT p.id FROM p, o WHERE contains(p.name, 'Customer#00000001') ORDER BY {_far('o', 'p')}, p.id LIMIT 5",
    "geo_implied_travel": BASE + f""", c AS (SELECT p.id, v.pos, lat, lng, lat + r * 1000 / 110540.0::DOUBLE AS y, lng + c * 1000 / (111320.0::DOUBLE * cos(radians(lat))) AS x FROM p, (VALUES ('NW', 1, -1), ('N', 1, 0), ('NE', 1, 1), ('W', 0, -1), ('E', 0, 1), ('SW', -1, -1), ('S', -1, 0), ('SE', -1, 1)) v(pos, r, c)),
w AS (SELECT id, pos, {_turn(_bearing('y', 'x', 'lat', 'lng') + ' + 90')} AS way FROM c) SELECT id, pos AS position, {_compass('way')} AS direction FROM w WHERE least(abs(floor(way + 0.5) - 90), 360 - abs(floor(way + 0.5) - 90)) <= 45""",
    "route_coverage": BASE + """, l AS (SELECT k, x, y, u, v FROM range(4) t(k), LATERAL (VALUES (139.0::DOUBLE + 0.01::DOUBLE * k, 35.0::DOUBLE, 139.05::DOUBLE, 35.05::DOUBLE), (139.05::DOUBLE, 35.05::DOUBLE, 139.1::DOUBLE - 0.01::DOUBLE * k, 35.1::DOUBLE)) s(x, y, u, v)),
m AS (SELECT id, k, (x - lng) * w AS ax, (y - lat) * 110540.0::DOUBLE AS ay, (u - lng) * w AS bx, (v - lat) * 110540.0::DOUBLE AS bq FROM (SELECT *, 111320.0::DOUBLE * cos(radians(lat)) AS w FROM p), l),
t AS (SELECT *, greatest(0, least(1, -(ax * (bx - ax) + ay * (bq - ay)) / (power(bx - ax, 2) + power(bq - ay, 2)))) AS t FROM m)
SELECT id, count(DISTINCT k) AS routes, count(DISTINCT k) / 4.0::DOUBLE AS share FROM t WHERE sqrt(power(ax + t * (bx - ax), 2) + power(ay + t * (bq - ay), 2)) <= 600 GROUP BY 1""",
    "search_plan": BASE + f""", o AS (SELECT lat, lng FROM p WHERE id = 5), b AS (SELECT lat - 4800 * 1.02::DOUBLE / 110540.0::DOUBLE AS s, lat + 4800 * 1.02::DOUBLE / 110540.0::DOUBLE AS n, lng - 4800 * 1.02::DOUBLE / (111320.0::DOUBLE * cos(radians(lat))) AS w, lng + 4800 * 1.02::DOUBLE / (111320.0::DOUBLE * cos(radians(lat))) AS e FROM o),
t AS (SELECT p.id, p.name, p.lat, p.lng, {_far('o', 'p')} AS d FROM p, o, b WHERE p.lat BETWEEN s AND n AND p.lng BETWEEN w AND e), r AS (SELECT * FROM t WHERE d BETWEEN 800 AND 4800),
c AS (SELECT p.id, p.lat, p.lng FROM p, b WHERE contains(p.name, 'Customer#00000001') AND p.lat BETWEEN s - 816 / 110540.0::DOUBLE AND n + 816 / 110540.0::DOUBLE AND p.lng BETWEEN w - 816 / (111320.0::DOUBLE * cos(radians(n))) AND e + 816 / (111320.0::DOUBLE * cos(radians(n)))),
x AS (SELECT min(lng) - 800 / (111320.0::DOUBLE * cos(radians(avg(lat)))) AS w, min(lat) - 800 / 110540.0::DOUBLE AS s, max(lng) + 800 / (111320.0::DOUBLE * cos(radians(avg(lat)))) AS e, max(lat) + 800 / 110540.0::DOUBLE AS n, count(*) AS k FROM c),
m AS (SELECT r.* FROM r, x WHERE (SELECT count(*) FROM r) <= 150 OR x.k = 0 OR (r.lat BETWEEN x.s AND x.n AND r.lng BETWEEN x.w AND x.e) ORDER BY d, id LIMIT 150),
h AS (SELECT m.id, min({_far('m', 'c')}) AS near FROM m, c GROUP BY 1), q AS (SELECT m.*, CASE WHEN near <= 800 THEN 1 - near / 800 ELSE 0 END AS cond FROM m LEFT JOIN h ON h.id = m.id),
s AS (SELECT *, round((0.2 * 0.4 + 0.7 * cond + greatest(0, 1 - d / 4800)) / 1.9, 3) AS score, round((0.2 * 0.4 + 0.7 * cond) / 0.9, 3) AS q FROM q), k AS (SELECT * FROM s WHERE q >= 0.3),
md AS (SELECT median(q) AS med, count(*) AS n FROM k), mad AS (SELECT median(abs(q - med)) AS mad FROM k, md), f AS (SELECT k.*, n, CASE WHEN mad < 1e-9 THEN q - med > 0.05 ELSE 0.6745 * (q - med) / mad > 3.5 END AS o FROM k, md, mad), z AS (SELECT count(*) FILTER (o) AS z FROM f)
SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, name, lat, lng, score FROM f, z WHERE n < 4 OR z = 0 OR z = n OR o""",
    "layer_shelters": _G + f" SELECT id, {_ROUND} FROM g WHERE layer = 'natural_label' AND name IS NOT NULL AND d <= 9000 ORDER BY d, id LIMIT 50",
    "text_clean_names": BASE + "SELECT id, name FROM p",
    "text_search_numerals": BASE + "SELECT id, ['東23丁目', '西105番地', '中08号', 'ショウ10条'][id % 4 + 1] AS name FROM p",
    "text_corporate_names": BASE + "SELECT id, ['高島屋', '渡辺商店', 'abcストア', '霞が関ビル'][id % 4 + 1] AS name FROM p",
    "text_addresses": BASE + "SELECT id, ['東京都港区六本木3-2-1', '青森県六戸町犬落瀬1', '東京都港区1-2ビル3f'][id % 3 + 1] AS address FROM p",
    "text_inferred_floors": BASE + "SELECT id, CASE id % 7 WHEN 2 THEN 5 END::INT AS value, CASE id % 7 WHEN 0 THEN 10 WHEN 3 THEN 20 WHEN 4 THEN 10 END::INT AS min, CASE id % 7 WHEN 1 THEN 3 WHEN 5 THEN 3 END::INT AS max FROM p",
    "text_choice_numbers": BASE + "SELECT id, CASE id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 12 END::INT AS choice FROM p",
    "text_near_labels": BASE + "SELECT id, CASE WHEN id % 5 <> 0 THEN printf('%.1f', (id % 90) / 8.0::DOUBLE) || CASE WHEN (id % 90) / 8.0::DOUBLE > 5 THEN 'km (over 5km)' ELSE 'km (within 5km)' END END AS label FROM p",
    "text_address_types": BASE + "SELECT id, id % 3 <> 1 AS address FROM p",
    "scalar_planar": BASE + "SELECT id, round(sqrt(power((139.05::DOUBLE - lng) * 111320.0::DOUBLE * cos(radians(lat)), 2) + power((35.05::DOUBLE - lat) * 110540.0::DOUBLE, 2)), 3) AS metres FROM p",
    "geo_feature_box": BASE + ", k AS (SELECT *, 400 / 111000.0::DOUBLE AS h, 400 / (111000.0::DOUBLE * cos(radians(lat))) AS w FROM p) SELECT id, round(CASE WHEN id % 2 = 0 THEN lng ELSE lng - w END, 7) AS min_lng, round(CASE WHEN id % 2 = 0 THEN lat ELSE lat - h END, 7) AS min_lat, round(CASE WHEN id % 2 = 0 THEN lng + 1 ELSE lng + w END, 7) AS max_lng, round(CASE WHEN id % 2 = 0 THEN lat + 1 ELSE lat + h END, 7) AS max_lat FROM k",
    "log_category_order": "SELECT * FROM (VALUES ('others', 7), ('poi', 1), ('address', 4), ('strange', NULL)) t(ai_classification, place) WHERE (SELECT count(*) FROM customer) > 3",
    "log_head": "SELECT event_id AS row_idx, props AS query FROM events WHERE event_id < 90",
    "plan_conditions": "SELECT * FROM (VALUES ('poi', 'adjacent', false), ('road', 'roadside', true), ('poi', 'same_building', false), ('poi', 'adjacent', false), ('road', 'roadside', true)) t(type, level, negate)",
    "plan_dropped": "SELECT * FROM (VALUES ('a'), ('b'), ('c')) t(name)",
    "plan_problems": "SELECT * FROM (VALUES ('the target has no text'), ('there is no anchor and no scope'), ('condition 1 has no type')) t(problem)",
    "plan_inferred_reach": "SELECT * FROM (VALUES ('徒歩10分', 10, NULL), ('1.5km以内', NULL, 1500), ('300m以内', NULL, 300), ('車で5分', 5, NULL)) t(wording, minutes, metres)",
    "plan_reaches": "SELECT * FROM (VALUES ('same_building', true, false, 250.0::DOUBLE), ('adjacent', false, false, 50.0::DOUBLE), ('nearby', false, false, 400.0::DOUBLE), ('far', false, true, 250.0::DOUBLE)) t(level, by_building, pushback, reference_m)",
}
