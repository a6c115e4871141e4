import duckdb
from pyspark.sql import functions as F

from larkfield.operators import advisors, compare, place_queries, search


def line(*points):
    return [{"lng": x, "lat": y} for x, y in points]


def test_corners(spark):
    roads = [(1, 0.0, 0.0, 1, line((-0.001, 0.00002), (0.001, 0.00002))), (1, 0.0, 0.0, 2, line((0.00003, -0.001), (0.00003, 0.001))), (2, 0.0, 0.0, 1, line((-0.001, 0.0), (0.001, 0.0))), (2, 0.0, 0.0, 2, line((-0.001, 0.00001), (0.001, 0.00001)))]
    df = spark.createDataFrame(roads, "id int, lat double, lng double, road int, line array<struct<lng:double,lat:double>>")
    assert {r.id: r.corner for r in advisors.corners(df).collect()} == {1: True, 2: False}


def test_bearing(spark):
    r = spark.range(1).select(advisors.travel_bearing(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(True)).alias("x")).first().x
    assert (r.degrees, r.direction) == (90, "E")


def test_promotable(spark):
    c = spark.createDataFrame([(0, "a", "poi", "nearby"), (1, "b", "poi", "adjacent"), (2, "c", "poi", "very_close"), (3, "d", "road", "adjacent")], "pos int, label string, type string, level string")
    i = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), ("d",)], "label string")
    assert [tuple(r) for r in advisors.promotable(c, i).collect()] == [("b", 2)]
    assert advisors.promotable(c, i.limit(0)).count() == 0


def test_promotable_query_on_many_items(spark, tmp_path):
    spark.range(3).selectExpr("cast(id as int) as n_nationkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(4600).selectExpr("id as s_suppkey", "concat('s', id) as s_name", "cast(if(id < 1700, 0, if(id < 3100, 2, 1)) as int) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = [(r.label, r.n) for r in place_queries.QUERIES["advise_promotable"](spark, str(tmp_path)).collect()]
    assert got == duckdb.sql(place_queries.ORACLE["advise_promotable"].replace("supplier", f"'{tmp_path}/supplier.parquet/*.parquet'")).fetchall() == [(2, 1400)]


def test_categories_never_empty(spark):
    c = spark.createDataFrame([(1, "g", ["x"]), (2, "g", ["y"]), (3, "h", ["x"]), (4, "g", None)], "id int, group string, poi_category array<string>")
    r = spark.createDataFrame([("g", ["x"]), ("h", ["x"])], "group string, remove array<string>")
    assert sorted(x.id for x in search.drop_categories(c, r).collect()) == [2, 3, 4]
    assert sorted(x.id for x in search.drop_categories(c, r, keep_null=False).collect()) == [2, 3]


def test_matches_need_one_row_for_both(spark):
    cols = "query_id int, rank int, name string, address string, lat double, lng double"
    left = spark.createDataFrame([(1, 1, "A", "東京都港区1-1", None, None), (1, 2, "B", "x", 35.0, 139.0), (2, 1, "C", "", None, None)], cols)
    right = spark.createDataFrame([(1, 1, "(株)A", "東京都港区2-2", None, None), (1, 2, "Z", "日本、東京都港区1-1", None, None), (1, 3, "B", None, 35.0001, 139.0)], cols)
    assert {(r.query_id, r.rank): r.match for r in compare.match_classes(left, right).collect()} == {(1, 1): "name", (1, 2): "both", (2, 1): "none"}


def test_states(spark):
    log = spark.createDataFrame([(1, "state", "k", "r1", "a", "ok", None), (2, "ticket", "k", "r2", "t", None, None), (3, "ticket", "m", "r1", "u", None, None), (4, "state", "m", "r1", None, "scope", "far")], "seq long, type string, key string, roundId string, id string, state string, reason string")
    assert {r.key: r.state for r in compare.row_states(log).collect()} == {"k": "problem", "m": "scope"}
    assert {r.key: r.state for r in compare.row_states(compare.remove_ticket(log, "k", "t")).collect()} == {"k": "ok", "m": "scope"}
