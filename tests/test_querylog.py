import random

import pytest
from pyspark.sql import functions as F

from larkfield import cli
from larkfield.operators import models
from larkfield.operators import querylog as q
from larkfield.sources.tables import query_log, read_query_log, with_row_index


def greedy(keys, window=5):
    kept, last = [], {}
    for i, k in enumerate(keys):
        if k not in last or i - last[k] > window:
            kept.append(i)
            last[k] = i
    return kept


@pytest.mark.parametrize("block", [6, 7, 16, 4096])
def test_dedup_is_the_greedy_one(spark, monkeypatch, block):
    monkeypatch.setattr(q, "BLOCK", block)
    rng = random.Random(block)
    keys = [rng.choice(["a", "a", "b", "c", None, " a", "A"]) for _ in range(400)] + ["hot"] * 60
    df = spark.createDataFrame(list(enumerate(keys)), "row_idx bigint, query string")
    assert sorted(r.row_idx for r in q.dedup_window(df).collect()) == greedy(keys)


def test_window_edges(spark):
    df = spark.createDataFrame([(0, "x"), (3, "x"), (6, "x"), (8, "y"), (13, "y"), (14, "y")], "row_idx bigint, query string")
    assert sorted(r.row_idx for r in q.dedup_window(df).collect()) == [0, 6, 8, 14]


def test_dates_and_proximity(spark):
    df = spark.createDataFrame([("2026-08-11 23:59:53 UTC", "139.70,35.66"), ("", ""), ("2026", "139.7"), ("2026-08-11", "a,b"), ("2026-08-11 xx:00:00", "1,2,3"), ("x", "nan,nan")], "datetime string, proximity string")
    x, y = q.parse_proximity()
    rows = df.select(q.log_date().alias("d"), q.log_hour().alias("h"), x.alias("x"), y.alias("y")).collect()
    assert [r.d for r in rows] == ["2026-08-11", "unknown", "unknown", "2026-08-11", "2026-08-11", "unknown"]
    assert [r.h for r in rows] == [8, None, None, None, None, None]
    assert [(r.x, r.y) for r in rows] == [(139.7, 35.66)] + [(None, None)] * 5


def test_long_tail_sums_to_the_rows(spark, sf_dir):
    rows = query_log(spark, sf_dir)
    n = rows.count()
    got = {r.scope: r.t for r in q.long_tail(rows).groupBy("scope").agg(F.sum("total_count").alias("t")).collect()}
    assert got["all"] == n and sum(v for k, v in got.items() if k != "all") == n


def test_csv_and_commands(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('﻿query,ai_classification,datetime,bbox,proximity,poi_category,poi_category_exclusions,near,navigation_profile\n"a ""q"" x",poi,2026-08-11 23:59:53 UTC,,"139.70,35.66",,,,\n"two\nlines",others,,,,,,,\n"a ""q"" x",odd,2026-08-11,,,,,,\nshort\n', encoding="utf-8")
    rows = with_row_index(read_query_log(spark, str(path)))
    assert [(r.row_idx, r.query) for r in rows.orderBy("row_idx").collect()] == [(0, 'a "q" x'), (1, "two\nlines"), (2, 'a "q" x'), (3, "short")]
    with pytest.raises(ValueError):
        read_query_log(spark, str(path), ("nothing",))
    for command, n in (("dedup", 1), ("add-query-count", 1), ("count-queries", 1), ("ai-classify", 1), ("ai-retry", 1), ("count-classifications", 1), ("analyze", 8)):
        assert len(cli.run(spark, cli.parser().parse_args([command, str(path), "--out", str(tmp_path / command)]))) == n
    back = read_query_log(spark, next((tmp_path / "dedup").iterdir()).as_posix())
    assert back.count() == 3 and "same_query_count" in back.columns


def test_model_ladder(spark):
    def flaky(batch):
        if len(batch) > 1:
            raise RuntimeError
        return ["poi"] if batch[0] != "bad" else ["a", "b"]

    assert models.classify_batch(flaky, ["x", "bad", "y"]) == ["poi", "others", "poi"]
    df = spark.createDataFrame([("東京駅",), ("東京駅",), ("港区",), (None,)], "query string")
    assert {r.query: r.label for r in models.classify(df).collect()} == {"東京駅": "poi", "港区": "address", "": "broken_query"}
