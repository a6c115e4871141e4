import json

import pytest
from pyspark.sql import functions as F

from larkfield import cli
from larkfield.operators import assistant, models, search, spatial
from larkfield.plans import dialogue, search_poi
from larkfield.sources import sinks


def test_backoff_and_bad_answers(spark):
    calls = []

    def busy(payload):
        calls.append(payload)
        if len(calls) < 3:
            raise assistant.RateLimited()
        return "[]"

    assert assistant.with_backoff(busy, (0.0, 0.0, 0.0))("x") == "[]" and len(calls) == 3
    texts = spark.createDataFrame([("塔の店",), ("a",), (None,)], "text string")
    for bad in (lambda _: "no json", lambda _: "[1]", lambda _: 1 / 0):
        got = {r.text: (r.request, r.problems) for r in assistant.parse_queries(texts, bad).collect()}
        assert got == {"塔の店": (None, ["no answer"]), "a": (None, ["no answer"])}
        assert {r.action for r in assistant.classify_feedback(texts, bad).collect()} == {""}
        assert assistant.parse_refinement({"a": 1}, "x", bad) == {"a": 1}
        assert set(assistant.column_roles(texts, bad).values()) == {"(none)"} and assistant.commentary(texts.withColumn("payload", F.lit("{}")), bad) == ""
        rows = spark.createDataFrame([("g", ["a"], 1), ("g", None, 2)], "group string, poi_category array<string>, id int")
        assert assistant.filter_categories(rows, bad).count() == 2
        listed = spark.createDataFrame([(1, 0, 5, "a", 1.0), (1, 1, 6, "ab", 2.0)], "group int, pos bigint, id bigint, name string, distance double")
        assert assistant.merge_clusters(listed, bad).count() == 2
    got = assistant.parse_queries(texts, lambda _: json.dumps({"tgt": {"tx": "店"}, "prox": {"anc": [{"tx": "塔"}]}})).where("text = '塔の店'").first()
    assert json.loads(got.request)["target"]["queries"] == ["店"] and got.problems == []


def test_batches_keep_every_query_and_failed_ones_get_the_default(spark):
    rows = spark.createDataFrame([(f"q{k % 50}",) for k in range(200)] + [(None,)], "query string")
    requests = assistant.batch_requests(rows, 7, 3)
    assert sorted(q for r in requests.collect() for q in r.queries) == sorted([f"q{k}" for k in range(50)] + [""])
    assert {r.job for r in requests.collect()} == {0, 1, 2} and max(len(r.queries) for r in requests.collect()) == 7

    def model(queries):
        if "q7" in queries:
            raise ValueError
        return ["poi"] * len(queries)

    lost = {q for r in requests.collect() if "q7" in r.queries for q in r.queries}
    labels = {r.query: r.label for r in assistant.batch_labels(requests, models.answered(requests, model)).collect()}
    assert labels == {q: "others" if q in lost else "poi" for q in [f"q{k}" for k in range(50)] + [""]}


def test_dialogue():
    d = dialogue.Dialogue()
    assert d.heard("a") == "a" and d.unresolved("a") and d.heard("b") == "a。b"
    assert all(d.unresolved(x) for x in "bcd") and d.pending == "a。b。c。d" and not d.unresolved("e") and d.heard("f") == "f"
    for _ in range(3):
        with pytest.raises(dialogue.ClarificationNeeded) as raised:
            d.ask("which?", [("x", 1.0, 2.0)])
        assert raised.value.options == [("x", 1.0, 2.0)]
    d.ask("which?")


def test_options_are_the_first_of_each_prefecture(spark):
    found = spark.createDataFrame([(1, "x", "東京都a", 1.0, 2.0), (2, "x", "東京都b", 1.0, 2.0), (3, "x", "大阪府c", 3.0, 4.0)], "id bigint, name string, address string, lat double, lng double")
    assert dialogue.options(found) == [("x", 1.0, 2.0), ("x", 3.0, 4.0)] and len(dialogue.options(found.drop("address"))) == 3


FEATURES = "id bigint, layer string, name string, class string, mode string, stop_type string, maki string, type string, lat double, lng double"


def test_collection_and_anchors_by_kind(spark):
    poi = spark.createDataFrame([(1, "中央駅", 35.0, 139.0, "poi"), (2, "バス停カフェ", 35.001, 139.0, "poi"), (3, "緑マンション", 35.001, 139.001, "poi"), (4, "中央", 36.0, 139.0, "place"), (5, "店", 35.002, 139.0, "poi")], "id bigint, name string, lat double, lng double, feature_type string")
    features = spark.createDataFrame([
        (11, "transit_stop_label", "東口", None, "metro", "entrance", None, None, 35.0003, 139.0), (12, "transit_stop_label", "西口", None, "metro", "entrance", None, None, 35.0, 138.9995), (13, "transit_stop_label", "一番", None, "bus", "stop", None, None, 35.001, 139.0),
        (14, "road", "中央交差点", "intersection", None, None, None, None, 35.004, 139.0), (15, "poi_label", "緑マンション別館", "building", None, None, None, None, 35.001, 139.002), (16, "shelter", "広場", None, None, None, None, None, 35.001, 139.0),
    ], FEATURES)
    box = (138.9, 34.9, 139.1, 35.1)
    ids = lambda *q, **k: sorted(r.id for r in search_poi.collect(poi, list(q), box, features=features, **k).collect())
    assert ids("バス停") == [13] and ids("避難所") == [16] and ids("中央交差点") == [14] and ids("緑マンション") == [3, 15] and ids("店") == [5] and ids("出口") == [11, 12]
    none = features.where("id > 13")
    assert [r.id for r in search_poi.collect(poi, ["バス停"], box, features=none, target=True).collect()] == [2] and search_poi.collect(poi, ["バス停"], box, features=none).count() == 0
    at = lambda **a: [p[:2] for p in search_poi.anchor_points(poi, a, features)]
    assert at(type="station", text="中央駅") == [(35.0003, 139.0), (35.0, 138.9995)] and at(type="station", text="中央駅", subtype={"exit": "西口"}) == [(35.0, 138.9995)]
    assert at(type="intersection", text="中央") == [(35.004, 139.0)] and at(type="locality", text="中央") == [(36.0, 139.0)] and at(type="poi", text="中央駅") == [(35.0, 139.0)]


def test_duplicates_take_no_place_among_the_nearest(spark):
    rows = [(k, "店", 35.0 + k * 1e-6, 139.0, ["c"]) for k in range(200)] + [(300 + k, f"{chr(0x4E00 + k)}店", 35.002 + k * 1e-5, 139.0, ["c"]) for k in range(20)] + [(900, "駅", 35.0, 139.0, ["s"])]
    poi = spark.createDataFrame(rows, "id bigint, name string, lat double, lng double, poi_category array<string>")
    steps = []
    request = {"proximity": {"anchors": [{"text": "駅"}], "within": {"maxMeters": 900}}, "target": {"text": "店"}}
    assert search_poi.search_poi(poi, request, least=0.0, trace=steps).count() == 21
    assert {n: df.count() for n, df in steps if n in ("names", "capped")} == {"names": 21, "capped": 21}
    assert search_poi.search_poi(poi, request, least=0.0, removed=["c"]).count() == 21  # a group that would be empty stays
    lines = spark.createDataFrame([(1, "primary", [(138.99, 35.00201), (139.01, 35.00201)]), (2, "major_rail", [(138.99, 35.0), (139.01, 35.0)])], "id int, class string, line array<struct<lng:double,lat:double>>")
    along = request | {"conditions": [{"type": "road", "text": "道", "distance": {"meters": 3}}]}
    first = search_poi.search_poi(poi, along, least=0.0, lines=lines, prefilter=True).orderBy("rank").first()
    assert first.id in (300, 301)


def test_reach_areas(spark):
    ring = spatial.circle_ring(35.0, 139.0, 800.0)
    points = spark.createDataFrame([(k, y, x) for k, (x, y) in enumerate(ring)], "id int, lat double, lng double")
    d = [r.distance for r in spatial.within_reach(points, 35.0, 139.0, None).collect()]
    assert len(d) == 32 and max(abs(x - 800) for x in d) < 0.01
    area = spatial.reach_area(35.0, 139.0, 5, 10, 80.0)
    grid = spark.createDataFrame([(k, 35.0 + k * 0.001, 139.0) for k in range(12)], "id int, lat double, lng double")
    assert [r.id for r in spatial.in_area(grid, area).orderBy("id").collect()] == [4, 5, 6, 7]
    assert spatial.reach_area(35.0, 139.0, 60, None, 80.0, None, (138.99, 34.99, 139.01, 35.01))["too_large"]


def test_scope_with_a_margin(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id int, x double")
    ids = lambda inside, near=None: [r.id for r in search.in_scope(rows, inside, near).orderBy("id").collect()]
    assert ids(F.col("x") < 2) == [1] and ids(F.col("x") > 9) == [1, 2, 3] and ids(F.col("x") > 9, F.col("x") > 2) == [3]


def test_charts(spark):
    df = spark.createDataFrame([("a<", 3), ("b", 1)], "k string, count int")
    page = sinks.report("t", [("one", df), ("two", df), ("three", df), ("four", df)], charts={"one": "line", "two": "bar", "three": "pie"})
    assert page.count("<polyline") == 1 and page.count("<path") == 2 and page.count("a&lt;") >= 5 and "a<" not in page.replace("a<text", "")
    assert "<circle" in sinks.pie_chart(["x"], [2.0]) and "<path" not in sinks.pie_chart([], [])


def labeller(queries):
    return ["poi"] * len(queries)


def writer(payload):
    return json.dumps({"text": "busy days"})


def test_command_line_asks_the_model_named(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("query,datetime,ai_classification,proximity,bbox,poi_category,poi_category_exclusions,near,navigation_profile\na,2026-01-01 10:00:00 UTC,others,,,,,,\na,2026-01-01 10:00:00 UTC,others,,,,,,\nb,2026-01-01 11:00:00 UTC,poi,,,,,,\n")
    args = lambda *a: cli.parser().parse_args([*a, str(path), "--out", str(tmp_path / "out")])
    for extra in ([], ["--batch-api"], ["--workers", "2"]):
        out = cli.run(spark, args("ai-classify", "--model", f"{__name__}:labeller", *extra))
        assert {r.ai_classification for r in spark.read.csv(out[0], header=True).collect()} == {"poi"}
    out = cli.run(spark, args("ai-retry", "--model", f"{__name__}:labeller", "--batch-size", "1", "--max-batches", "1"))
    assert sorted(r.ai_classification for r in spark.read.csv(out[0], header=True).collect()) == ["others", "poi", "poi"]  # the chosen row only
    page = cli.run(spark, args("analyze-ai", "--model", f"{__name__}:writer"))[-1]
    assert "busy days" in "".join(r.value for r in spark.read.text(page).collect())
