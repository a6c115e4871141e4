import math
import random

import pytest
from pyspark.sql import functions as F

from larkfield.functions import geo, text
from larkfield.operators import candidates, place_queries, routes, search, spatial
from larkfield.plans import schema
from larkfield.plans.search_poi import search_poi
from larkfield.sources import tables
from larkfield.sources.tables import items, places
from larkfield.streaming import log_streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_polygon_form_of_a_circle(spark):
    rng = random.Random(1)
    corners = [(math.cos(2 * math.pi * k / 32), math.sin(2 * math.pi * k / 32)) for k in range(32)]
    rows = [(rng.uniform(0, 1.02), rng.uniform(0, 2 * math.pi)) for _ in range(2000)]

    def inside(d, a):
        x, y = d * math.cos(a), d * math.sin(a)
        return all((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= 0 for p, q in zip(corners, corners[1:] + corners[:1]))

    got = [r.x for r in spark.createDataFrame(rows, "d double, a double").select(geo.in_circle_polygon(F.col("d"), F.col("a"), 1.0).alias("x")).collect()]
    assert sum(g != inside(*r) for g, r in zip(got, rows)) == 0


def test_polygons_and_lines(spark):
    ring = F.expr("array(named_struct('lng', 0D, 'lat', 0D), named_struct('lng', 2D, 'lat', 0D), named_struct('lng', 2D, 'lat', 2D), named_struct('lng', 0D, 'lat', 2D))")
    assert one(spark, geo.in_polygon(F.lit(1.0), F.lit(1.0), ring)) and not one(spark, geo.in_polygon(F.lit(1.0), F.lit(2.5), ring))
    line = F.slice(ring, 1, 2)
    assert abs(one(spark, geo.to_line(F.lit(0.001), F.lit(1.0), line)) - 110.54) < 0.1
    assert one(spark, geo.to_line(F.lit(0.001), F.lit(1.0), F.slice(ring, 1, 1))) is None
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, None, None)], "id bigint, lat double, lng double")
    polygons = spark.range(1).select("id", ring.alias("ring"))
    assert {r.id: r.inside for r in spatial.split_by_polygons(points, polygons, cell_deg=0.5).collect()} == {1: True, 2: False, 3: False}
    lines = spark.range(1).select("id", line.alias("line"))
    near = spatial.nearest_line(spark.createDataFrame([(1, 0.001, 1.0), (2, 0.1, 1.0)], "id bigint, lat double, lng double"), lines, 500.0)
    assert [(r.id, round(r.nearest)) for r in near.collect()] == [(1, 111)]


def test_coordinates(spark):
    assert one(spark, geo.round_coordinate(F.lit(-2.5), 0)) == -2 and one(spark, geo.truncate_coordinate(F.lit("-35.6789"), 2)) == -35.67
    assert one(spark, geo.truncate_coordinate(F.lit("35"), 3)) == 35.0 and one(spark, geo.compass(F.lit(350.0))) == "N"
    assert one(spark, geo.compact_distance(F.lit(1234.0))) == "1.2 km"


def test_pairs_equal_brute_force(spark, sf_dir):
    a, b = [(r.id, r.lat, r.lng) for r in places(spark, sf_dir).collect()], [(r.id, r.lat, r.lng) for r in items(spark, sf_dir).collect()]
    want = {(i, j) for i, y, x in a for j, v, u in b if candidates.metres({"lat": y, "lng": x}, {"lat": v, "lng": u}) * geo.TURF_M / geo.EARTH_M <= 900}
    assert {(r.a_id, r.b_id) for r in spatial.pairs_within(places(spark, sf_dir), items(spark, sf_dir), 900.0).collect()} == want


def far(a, b):
    """Great circle by the angle between unit vectors, good at any distance."""
    v = [[math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y))] for y, x in (a, b)]
    return 2 * geo.TURF_M * math.asin(math.dist(*v) / 2)


@pytest.mark.parametrize("lat, lng, spread", [(0.0, 20.0, 1.0), (70.0, 179.99, 2.5), (-70.0, -180.0, 2.5), (89.0, 0.0, 180.0), (89.99, 0.0, 180.0), (-89.999, 50.0, 180.0), (0.0, 180.0, 0.5), (45.0, 179.999, 0.5)])
def test_pairs_everywhere_on_the_globe(spark, lat, lng, spread):
    rng = random.Random(int(lat))
    wrap = lambda x: (x + 180) % 360 - 180
    points = [(k, max(-90.0, min(90.0, lat + rng.uniform(-0.03, 0.03))), wrap(lng + rng.uniform(-spread, spread) * 0.02)) for k in range(150)] + [(150 + k, max(-90.0, min(90.0, lat + rng.uniform(-0.03, 0.03))), wrap(lng + rng.uniform(-spread, spread))) for k in range(50)]
    df = spark.createDataFrame(points, "id bigint, lat double, lng double")
    want = {(a[0], b[0]) for a in points for b in points if far(a[1:], b[1:]) <= 800}
    assert {(r.a_id, r.b_id) for r in spatial.pairs_within(df, df, 800.0).select("a_id", "b_id").collect()} == want and len(want) > 200
    near = [r.id for r in spatial.around(df, lat, wrap(lng), 900.0).collect()]
    assert sorted(near) == [i for i, y, x in points if far((lat, lng), (y, x)) <= 900]
    covered = df.where("id % 3 = 0")
    assert {r.id for r in spatial.uncovered(df, covered, 800.0).collect()} == {a for a, *_ in points if not any((a, b) in want for b in range(0, 200, 3))}


def copies(spark, n, points):
    """n rows dealt to a few points; one id at two places, one null id, one row without a place."""
    near = F.element_at(F.array(*(F.struct(F.lit(y).alias("lat"), F.lit(x).alias("lng")) for y, x in points)), (F.col("id") % len(points) + 1).cast("int"))
    odd = spark.createDataFrame([(0, *points[-1]), (None, *points[0]), (n, None, 139.0)], "id bigint, lat double, lng double")
    return spark.range(n).select("id", near["lat"].alias("lat"), near["lng"].alias("lng")).unionByName(odd)


def measurements(spark, monkeypatch, *names):
    """An accumulator of how often the distance functions of these names are worked out, row by row."""
    count = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def one(d):
        count.add(1)
        return d

    for name in names:
        if plain := getattr(spatial, name, None):
            monkeypatch.setattr(spatial, name, lambda *a, plain=plain: one(plain(*a)))
    return count


MAINS, ITEMS = [(35.0, 139.0), (36.0, 139.0), (35.003, 139.0)], [(35.001, 139.0), (35.5, 139.0)]


def test_lines_measure_copies_once(spark, monkeypatch):
    count = measurements(spark, monkeypatch, "to_line", "to_segment")
    end = F.struct(F.lit(139.001).alias("lng"), F.col("lat").alias("lat"))
    lines = copies(spark, 400, ITEMS).where("lat is not null").select("id", F.array(F.struct("lng", "lat"), end).alias("line"))
    got = [(r.id, round(r.nearest, 2)) for r in spatial.nearest_line(copies(spark, 1500, MAINS), lines, 400.0).collect()]
    want = {i: 221.08 if i % 3 else 110.54 for i in range(1500) if i % 3 != 1} | {None: 110.54}
    assert len(got) == len(want) and dict(got) == want
    assert 0 < count.value < 100  # of 200,000 pairs of rows in reach


def test_pairs_measure_copies_once(spark, monkeypatch):
    count = measurements(spark, monkeypatch, "haversine")
    got = spatial.pairs_within(copies(spark, 900, MAINS), copies(spark, 400, ITEMS), 400.0, digits=1)
    found = {(r.a_id, r.b_id, r.distance): r.n for r in got.groupBy("a_id", "b_id", "distance").agg(F.count("*").alias("n")).collect()}
    mains = [(i, 222.4 if i % 3 else 111.2) for i in range(900) if i % 3 != 1] + [(0, 222.4), (None, 111.2)]
    assert found == {(i, j, d): 1 for i, d in mains for j in [*range(0, 400, 2), None]}
    assert 0 < count.value < 5000  # of 120,000 pairs of rows


def nearest_copies(spark, monkeypatch, **how):
    """nearest_match over copies, as {id: metres}, and how many distances it took."""
    count = measurements(spark, monkeypatch, "haversine")
    got = [(r.id, round(r.nearest, 1)) for r in spatial.nearest_match(copies(spark, 900, MAINS), copies(spark, 400, ITEMS), 400.0, **how).collect()]
    assert len(got) == len(dict(got))
    return dict(got), count.value


def test_nearest_measures_copies_once(spark, monkeypatch):
    got, count = nearest_copies(spark, monkeypatch)
    assert got == {i: 222.4 if i % 3 else 111.2 for i in range(900) if i % 3 != 1} | {None: 111.2}
    assert 0 < count < 100  # of 120,000 pairs of rows


def test_nearest_north_measures_copies_once(spark, monkeypatch):
    got, count = nearest_copies(spark, monkeypatch, direction="north")
    assert got == {i: 222.4 for i in range(900) if i % 3 == 2} | {0: 222.4}
    assert 0 < count < 100  # of 120,000 pairs of rows


def test_nearest_in_polygon_measures_copies_once(spark, monkeypatch):
    got, count = nearest_copies(spark, monkeypatch, polygon_steps=4)
    assert got == {i: 222.4 if i % 3 else 111.2 for i in range(900) if i % 3 != 1} | {None: 111.2}
    assert 0 < count < 100  # of 120,000 pairs of rows


@pytest.mark.parametrize("lat", [0.0, 70.0, 89.0])
def test_lines_at_high_latitudes(spark, lat):
    rng = random.Random(int(lat))
    scale = 1 / math.cos(math.radians(lat))
    spot = lambda: (10 + rng.uniform(-0.02, 0.02) * scale, lat + rng.uniform(-0.02, 0.02))
    points, lines = [(k, *spot()[::-1]) for k in range(80)], [(k, [spot(), spot(), spot()]) for k in range(15)]

    def away(y, x, p, q):
        s = geo.LNG_M * math.cos(math.radians(y))
        (a, b), (c, d) = (((u - x) * s, (v - y) * geo.LAT_M) for u, v in (p, q))
        t = max(0, min(1, -(a * (c - a) + b * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
        return math.hypot(a + t * (c - a), b + t * (d - b))

    want = {(i, k, n) for i, y, x in points for k, line in lines for n in (0, 1) if away(y, x, line[n], line[n + 1]) <= 300}
    got = spatial.lines_within(spark.createDataFrame(points, "id bigint, lat double, lng double"), spark.createDataFrame(lines, "id bigint, line array<struct<lng:double,lat:double>>"), 300.0).collect()
    assert sorted((r.id, r.line_id) for r in got) == sorted((i, k) for i, k, _ in want) and len(want) > 50


def test_union_of_sources_by_normalised_names(spark):
    rows = lambda *names: spark.createDataFrame([(k, n, 35.0, 139.0) for k, n in enumerate(names)], "id bigint, name string, lat double, lng double")
    got = spatial.union_sources(rows("ＡＢＣ １", "すし"), rows("abc1", "スシ", "other"))
    assert sorted(r.name for r in got.collect()) == sorted(["ＡＢＣ １", "すし", "other"])


def test_reach_and_scores(spark):
    assert search.reach_of({"meters": 70, "level": "nearby"}).radius_m == 70 and search.reach_of({"level": "far"}).pushback
    assert search.reach_of({"level": "nearby", "method": "isochrone"}).minutes == 5 and search.reach_of({"level": "adjacent", "method": "isochrone"}).radius_m == 50
    assert search.reach_of(None).reference_m == 150 and search.reach_of({"level": "same_building"}).by_building
    c = spark.createDataFrame([(1, "definitely", 100.0, None, 5), (2, "unknown", None, None, None)], "id bigint, relevance string, distance double, reach_sec double, floors int")
    none = spark.createDataFrame([], "id bigint, condition string, closeness double")
    assert {r["class"] for r in search.evaluate(c, none, ["a"]).collect()} == {"full"}  # a condition nobody meets vanishes
    assert {r["class"] for r in search.evaluate(c, none, ["a"], evaluated=["a"]).collect()} == {"none"}
    hits = spark.createDataFrame([(1, "a", 0.5)], "id bigint, condition string, closeness double")
    r = {r.id: r for r in search.tiers(search.evaluate(c, hits, ["a"], reference_m=200.0)).collect()}
    assert (r[1].score, r[1].tier, r[2].tier) == (round(0.3 + 0.25 + 0.1, 3), "full1", "none")
    assert [x.id for x in c.where(search.floor_pass(F.col("floors"), value=5)).collect()] == [1]
    assert [x.id for x in c.where(search.floor_pass(F.col("floors"), value=5, negate=True)).collect()] == [2]


def test_names(spark):
    assert text.plain_name("(株)ローソン 千駄ヶ谷店") == text.plain_name("ﾛｰｿﾝ・千駄が谷店") != text.plain_name("ガスト")
    assert text.search_name("すし 二丁目") == "スシ2丁目" and text.numeral("二十三") == "23"
    assert text.plain_address("日本、〒106-0032 東京都港区六本木三丁目2番1号 森ビル") == text.plain_address("東京都港区六本木3-2-1") == "東京都港区六本木3-2-1"
    assert text.plain_address("青森県上北郡六戸町1") == text.plain_address("青森県六戸町1") and "3f" in text.plain_address("東京都港区1-2 ビル3F")
    assert one(spark, text.query_type(F.lit("渋谷区"))) == "place" and one(spark, text.inferred_floors(F.lit("10階建て以下")))["max"] == 10
    assert text.inferred_reach("駅から1.5km以内") == {"maxMeters": 1500} and one(spark, text.leading_number(F.lit("12.5px"))) == 12.5


def test_lists(spark):
    rows = [("g", k, k, n, 35.0 + dy, 139.0, float(d)) for k, (n, dy, d) in enumerate([("ローソン", 0, 5), ("ローソン 渋谷店", 0.0002, 9), ("ﾛｰｿﾝ", 0.01, 1), (None, 0.02, 2), ("A", 0.02, 7), ("AB", 0.02005, 8)])]
    df = spark.createDataFrame(rows, "group string, pos int, id bigint, name string, lat double, lng double, distance double")
    assert sorted(r.id for r in candidates.dedup_names(df).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in candidates.dedup_contained(df).collect()) == [0, 1, 2, 3, 5]
    assert [r.id for r in candidates.spread(df, 3).collect()] == [0, 2, 3]
    assert {r.id for r in candidates.near_clusters(df).collect() if r.cluster is not None} == {3, 4, 5}
    assert len(candidates.hulls(df).first().ring) == 2
    alone = candidates.hulls(df.where("pos = 0"), 100.0).first().ring
    assert len(alone) == 32 and all(abs(candidates.planar_metres({"lat": 35.0, "lng": 139.0}, p) - 100) < 0.1 for p in alone)


def test_lists_hold_all_places_and_are_bounded(spark, sf_dir, monkeypatch):
    listed = place_queries._listed(spark, sf_dir)
    ids = sorted(r.id for r in places(spark, sf_dir).collect())
    assert sorted(r.id for r in listed.collect()) == ids
    twice = spark.range(20000).selectExpr("id as c_custkey", "'a' as c_name", "0 as c_nationkey")
    monkeypatch.setattr(tables, "table", lambda *_: twice)
    big = place_queries._listed(spark, sf_dir)
    assert big.count() == 20000 and big.groupBy("group").count().agg(F.max("count")).first()[0] == 75
    rows = spark.range(candidates.MOST + 1).selectExpr("'g' as group", "id as pos", "id", "'a' as name", "35.0D + id / 1000D as lat", "139.0D as lng", "1.0D as distance")
    assert candidates.dedup_names(rows).count() == 1 and len(candidates.hulls(rows).first().ring) == 2  # of any length
    for operator in (candidates.dedup_contained, candidates.near_clusters, lambda df: candidates.spread(df, 5)):
        with pytest.raises(Exception, match="cap them first"):
            operator(rows).collect()
        assert operator(rows.where("id < 50")).count() > 0


def test_plan(spark):
    request = {"prox": {"anc": [{"ty": "poi", "tx": "駅"}], "wi": {"mxMe": 900}}, "tgt": {"tx": "店"}, "cond": [{"ty": "road", "tx": "r", "d": {"lv": "far"}}, {"ty": "poi", "tx": "寺"}, {"ty": "poi"}, {"ty": "x", "tx": "y"}]}
    plan = schema.with_defaults(schema.expand(request))
    assert [c["distance"]["level"] for c in plan["conditions"]] == ["roadside", "very_close", "very_close"] and plan["dropped_conditions"] == ["y"]
    assert plan["target"]["queries"] == ["店"] and not schema.problems(plan) and schema.problems({}) != []
    poi = spark.createDataFrame([(1, "駅", 35.0, 139.0), (2, "店A", 35.001, 139.0), (3, "店B", 35.004, 139.0), (4, "店C", 35.1, 139.0), (5, "寺", 35.0011, 139.0)], "id bigint, name string, lat double, lng double")
    found = search_poi(poi, request | {"cond": [{"ty": "poi", "tx": "寺"}]}).orderBy("rank").collect()
    assert [r.name for r in found] == ["店A", "店B"] or [r.name for r in found] == ["店A"]
    assert search_poi(poi, {"prox": {"anc": [{"tx": "nowhere"}]}, "tgt": {"tx": "店"}}).count() == 0


def test_routes(spark):
    df = spark.createDataFrame([(1, k, c, a, b) for k, (c, a, b) in enumerate([("motorway", 0, 1), ("toll", 1, 2), ("street", 2, 3), ("motorway", 3, 4), ("motorway", 9, 10)])], "route int, pos int, class string, a int, b int")
    assert sorted((r.a, r.b, r.slices) for r in routes.islands(df).collect()) == [(0, 2, 2), (3, 4, 1), (9, 10, 1)]


@pytest.mark.parametrize("n", [1, 3])
def test_stream_dedup_equals_batch(spark, tmp_path, n):
    keys = ["a", "b", "a", "a", "b", "b", "a", "a", "c", "a", "b", "a"]
    for k in range(n):
        part = [(i, x) for i, x in enumerate(keys) if i * n // len(keys) == k]
        spark.createDataFrame(part, "row_idx bigint, query string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_idx bigint, query string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = log_streams.dedup_window(stream).writeStream.format("memory").queryName(f"kept{n}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    from larkfield.operators.querylog import dedup_window

    want = sorted(r.row_idx for r in dedup_window(spark.createDataFrame(list(enumerate(keys)), "row_idx bigint, query string")).collect())
    assert sorted(r.row_idx for r in spark.table(f"kept{n}").collect()) == want
