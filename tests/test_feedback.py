"""Feedback entries, merges, wordings and requests on rows made for them."""

import json

from pyspark.sql import functions as F

from larkfield.functions import geo, text
from larkfield.operators import compare, feedback, feedback_queries, labels, layers, querylog, search
from larkfield.plans import schema, search_poi
from larkfield.sources import sinks, tables


def test_merges_follow_their_order(spark):
    rows = [("g", 0, 1, "ab", 5.0), ("g", 1, 2, "abc", 9.0), ("g", 2, 3, "xyz", 2.0), ("h", 0, 4, None, None), ("h", 1, 5, None, 1.0)]
    listed = spark.createDataFrame(rows, "group string, pos long, id long, name string, distance double")
    merges = spark.createDataFrame([("g", 0, 0, 1), ("g", 1, 0, 2), ("g", 2, 1, 2), ("h", 0, 0, 1), ("h", 1, 0, 7)], "group string, step int, a long, b long")
    # 0 loses to 1 and takes no further part; 1 and 2 are as long, 2 is nearer; of the unnamed the nearer stays
    assert sorted(r["id"] for r in search.merged(listed, merges).collect()) == [3, 5]


def test_first_state_of_the_latest_round_counts(spark):
    fields = "seq long, key string, roundId string, type string, state string, reason string, dataIssue string, searchEngineIssues array<string>"
    rows = [(1, "a", "r1", "ticket", None, None, "poi_missing", None), (2, "a", "r2", "state", "no_issue", None, None, None), (3, "a", "r2", "state", "out_of_scope", "x", None, None), (4, "a", None, None, None, None, None, None), (5, "b", "r1", "ticket", None, None, None, ["p", "q"]), (6, "b", "r1", "ticket", None, None, "poi_missing", None)]
    log = spark.createDataFrame(rows, fields)
    got = {r["key"]: (r["state"], r["reason"], r["issues"], r["tickets"]) for r in feedback.current(log).collect()}
    assert got == {"a": ("no_issue", None, None, 0), "b": ("problem", None, ["p", "poi_missing", "q"], 2)}
    assert {r["key"]: r["state"] for r in compare.row_states(log).collect()} == {"a": "no_issue", "b": "problem"}


def test_summary_payload_holds_the_aggregates(spark):
    rows = [(k, q, c, "2026-08-1%d 01:00:00 UTC" % (k % 2), "", "", "", "", "", "") for k, (q, c) in enumerate([("a", "poi"), ("a", "poi"), ("b", "poi"), ("c", "zz"), ("d", "address")])]
    log = spark.createDataFrame(rows, "row_idx long, query string, ai_classification string, datetime string, proximity string, bbox string, poi_category string, poi_category_exclusions string, near string, navigation_profile string")
    got = json.loads(querylog.summary_payload(log).first()["payload"])
    assert got["categories"] == ["poi", "address", "zz"]
    assert got["top_queries_by_category"]["poi"] == [{"query": "a", "count": 2}, {"query": "b", "count": 1}]
    assert got["date_range"] == {"from": "2026-08-10", "to": "2026-08-11"}
    assert got["daily_category_counts"]["2026-08-10"] == {"address": 1, "poi": 2, "zz": 0}
    assert got["long_tail_distribution"]["all"]["2-9"] == {"unique_queries": 1, "volume_pct": 40.0}


def test_requests_read_both_orders_of_coordinates(spark):
    rows = spark.createDataFrame([(0, " q ", "139.7,35.6", "35.1,139.2", "10 km", "a, b,,c"), (1, "", "139.7", "x,y", "", "")], "row_idx long, q string, p string, l string, r string, t string")
    roles = {"q": "q", "r": "radius", "t": "types"}
    one, two = querylog.requests_of_rows(rows, roles | {"p": "proximity"}).orderBy("row_idx").collect()
    assert (one["query"], one["lat"], one["lng"], one["radius"], one["types"]) == ("q", 35.6, 139.7, 10.0, ["a", "b", "c"])
    assert (two["query"], two["lat"], two["lng"], two["radius"]) == (None, None, None, None)
    other = querylog.requests_of_rows(rows, roles | {"l": "location"}).orderBy("row_idx").collect()
    assert [(r["lat"], r["lng"]) for r in other] == [(35.1, 139.2), (None, None)]


def test_wordings():
    request = {"proximity": {"anchors": [{"text": "駅"}, {"text": "港"}], "within": {"minMinutes": 3, "minutes": 9}}, "target": {"text": "店", "floors": {"max": 3}}, "conditions": [{"type": "road", "distance": {"level": "adjacent"}}]}
    assert labels.criteria(request) == "🔎 駅・港周辺で「店」を検索\n条件: road"
    assert labels.facts(request) == "基準地点: 駅・港\n範囲: walking 3〜9分\n探すもの: 店\n階数: 3階建て以下\n条件1: road（目の前）"
    assert (labels.floor_label({"min": 2}), labels.floor_label(None)) == ("2階以上", "階数")


def test_summary_of_results(spark):
    rows = spark.createDataFrame([(1, "full", 0.9, None, 7, ["a"]), (2, "full", 0.95, "x", 2, []), (3, "partial", 0.4, "y", 1, []), (4, "none", 0.1, "z", 1, [])], "id long, class string, score double, name string, floors int, hits array<string>")
    request = {"target": {"floors": {"min": 5}}, "conditions": [{"type": "poi", "text": "a"}]}
    assert labels.results_summary(rows, request, "ambiguous") == "確度: ambiguous\n候補総数: 3件\n1. x（スコア0.95）\n2. (名称不明)（スコア0.9）✔️ 5階建て以上（7階相当）、✔️ 近くにa"


def test_natural_targets_loosen_lines():
    plan = lambda t: schema.with_defaults({"target": {"text": t}, "conditions": [{"type": "road"}]})["conditions"][0]["distance"]["level"]
    assert (plan("中央公園"), plan("カフェ")) == ("very_close", "roadside")


def test_text_search_limits_and_overrides(spark):
    poi = spark.range(1, 41).select("id", F.lit("Ｃａｆｅ").alias("name"), (35 + F.col("id") / 1000).alias("lat"), F.lit(139.0).alias("lng"), F.when(F.col("id") % 2 == 0, "poi").otherwise("place").alias("feature_type"), F.array(F.lit("cafe")).alias("poi_category"))
    count = lambda **k: search_poi.text_search(poi, "cafe", **k).count()
    assert (count(), count(specificity="unique"), count(specificity="brand"), count(types=["poi"])) == (30, 5, 20, 20)
    box = geo.make_box(*(F.lit(x) for x in (138.0, 35.0, 140.0, 35.0035)))
    assert (count(box=box), count(category="bar")) == (3, 0)
    assert [r["id"] for r in search_poi.plain_search(poi, "cafe", near=(35.0401, 139.0), specificity="unique").orderBy("rank").collect()] == [40, 39, 38, 37, 36]


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(text.near_label(F.lit(6.04))) == "6.0km (over 5km)"
    assert value(text.unfenced(F.lit(" ```json\n{}\n``` "))) == "{}"
    assert [value(layers.road_category(F.lit(x))) for x in ("path", "ferry", "junction", "odd", None)] == ["road", "rail and other", "point", "other", None]
    cells = value(geo.implied_travel(F.lit(35.0), F.lit(139.0), True, 1.0))
    assert len(cells) == 8 and {c["position"]: c["direction"] for c in cells}["S"] == "E"


def test_queries_take_all_places(spark, monkeypatch):
    rows = [(k, f"Customer#00000001{k % 10}" if k > 5000 else f"Customer#{k}", 0) for k in (1, 50, 51, 5001, 20000)]
    monkeypatch.setattr(tables, "table", lambda *_: spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int"))
    assert {r.id for r in feedback_queries.QUERIES["search_text"](spark, "").collect()} == {5001, 20000}
    # one travels east with the landmark at the left only south of it
    got = feedback_queries.QUERIES["geo_implied_travel"](spark, "").collect()
    assert sorted(map(tuple, got)) == sorted((k, *way) for k, *_ in rows for way in (("S", "E"), ("SE", "NE"), ("SW", "SE")))


def test_plan_rings_floors_buildings_and_points(spark):
    rows = [(1, "駅", 35.0, 139.0, None, None), (2, "店A", 35.004, 139.0, 3, 9), (3, "店B", 35.008, 139.0, 8, 9), (4, "店C", 35.02, 139.0, 8, 7), (5, "港", 35.03, 139.0, None, None), (6, "銀行", 35.0201, 139.01, 1, 7)]
    poi = spark.createDataFrame(rows, "id long, name string, lat double, lng double, floors int, building long")
    find = lambda near, steps=None, **k: sorted(r["name"] for r in search_poi.search_poi(poi, {"proximity": near, "target": {"text": "店"} | k.pop("target", {}), **k}, least=0.0, trace=steps).collect())
    station, harbour = {"text": "駅"}, {"text": "港"}
    assert find({"anchors": [station], "within": {"maxMinutes": 12}}) == ["店A", "店B"]
    assert find({"anchors": [station], "within": {"minMinutes": 8, "maxMinutes": 12}}) == ["店B"]
    assert find({"anchors": [station, harbour], "within": {"maxMeters": 1200}}) == ["店A", "店B", "店C"]
    assert find({"scope": {"text": "港"}}) == ["店A", "店B", "店C"]
    assert find({"anchors": [station], "within": {"level": "somewhat_nearby"}}, target={"floors": {"min": 5}}) == []
    assert find({"anchors": [station], "within": {"maxMeters": 3000}}, target={"floors": {"min": 5}}) == ["店B", "店C"]
    steps = []
    assert find({"scope": {"text": "港"}}, steps, conditions=[{"type": "poi", "text": "銀行", "distance": {"level": "same_building"}}]) == ["店C"]
    assert [(name, df.count()) for name, df in steps][:3] == [("names", 3), ("reach", 3), ("rules", 1)]
    assert len(find({"scope": {"text": "港"}}, conditions=[{"type": "poi", "text": "無い", "distance": {"level": "same_building"}}])) == 3
    assert [r["name"] for r in search_poi.search_poi(poi, {"proximity": {"scope": {"text": "nowhere"}}, "target": {"text": "店"}}, point=(35.02, 139.0), least=0.0).collect()] == ["店C"]


def test_route_coverage_counts_all_routes(spark):
    lines = spark.createDataFrame([(k, [(139.0, 35.0 + k / 1000), (139.1, 35.0 + k / 1000)]) for k in range(12)], "id int, line array<struct<lng:double,lat:double>>")
    poi = spark.createDataFrame([(1, 35.0, 139.05), (2, 35.011, 139.01), (3, 35.2, 139.0)], "id long, lat double, lng double")
    from larkfield.operators import advisors

    assert [(r["id"], r["routes"], round(r["share"], 3)) for r in advisors.route_coverage(poi, lines, 300.0).collect()] == [(1, 3, 0.25), (2, 3, 0.25)]


def test_json_says_nothing_twice(spark):
    df = spark.createDataFrame([(1, "", ["x"], ("", 2.0), None), (2, "a", [], None, [("", 1)])], "rank int, name string, tags array<string>, at struct<b:string,c:double>, more array<struct<d:string,e:int>>")
    assert [json.loads(r["json"]) for r in sinks.minified(df).collect()] == [{"rank": 1, "tags": ["x"], "at": {"c": 2.0}}, {"rank": 2, "name": "a", "more": [{"e": 1}]}]
    got = json.loads(sinks.response(df.select("rank", "name"), {"stage": "done"}))
    assert got == {"results": [{"rank": 1}, {"rank": 2, "name": "a"}], "meta": {"count": 2, "stage": "done"}}


def test_feedback_file(spark, tmp_path):
    df = spark.createDataFrame([("2", 'say "hi"', 0.5), ("1", "a,b", None)], "ts string, query string, score double")
    sinks.write_feedback(df, str(tmp_path / "f"))
    lines = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "f").glob("part-*"))).splitlines()
    assert lines[0] == "\ufeff" + ",".join(sinks.FEEDBACK_COLUMNS) and lines[1].startswith('"1","a,b",""') and lines[2].startswith('"2","say ""hi""",""') and len(lines) == 3


def test_nearest_prefecture_is_exact(spark):
    far = [(p[2] + dx, p[1] + dy) for p in querylog.PREFECTURES for dx, dy in ((0, 0), (0.3, -0.2), (-5.0, 4.0))] + [(None, 35.0), (200.0, 95.0)]
    rows = spark.createDataFrame(far, "x double, y double")
    got = querylog.with_prefecture(rows, F.col("x"), F.col("y"), "a").withColumn("b", F.when(F.col("x").isNotNull(), querylog.nearest_prefecture(F.col("x"), F.col("y"))["ord"]))
    assert got.where("not (a <=> b)").count() == 0
