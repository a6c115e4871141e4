"""Query-log operators: windowed dedup, counts, classification joins and trend aggregates. Rows are ordered by row_idx, dense from 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfield.functions.geo import EARTH_KM, haversine
from larkfield.functions.reference import CATEGORIES, LONG_TAIL, PREFECTURES, USAGE_COLUMNS
from larkfield.functions.text import leading_number

#: Rows of one block of the windowed dedup; bounds the arrays it folds.
BLOCK = 4096


def percent(n, total) -> Column:
    """One decimal with a percent sign; 0.0% of nothing."""
    return F.concat(F.call_function("format_number", F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0)), F.lit("0.0")), F.lit("%"))


def dedup_window(rows: DataFrame, key: str = "query", window: int = 5, index: str = "row_idx") -> DataFrame:
    """Keep a row unless a kept row of its key lies within the `window` rows before it; dropped rows hide nothing.

    Blocks of BLOCK rows are folded apart: for each number of rows that the block before may still hide (0 to window) a block tells how many
    it hides in the next. Runs of BLOCK blocks compose these few numbers into their own, and a key's runs are composed last: so a hot key's
    arrays hold BLOCK numbers, BLOCK blocks, and a BLOCK-th of a BLOCK-th of its rows. From there true starts go back down to the rows.
    """
    if window >= BLOCK:
        raise ValueError("a block must be longer than the window")
    place = (F.col(index) % BLOCK).cast("int")
    blocks = rows.select(F.col(key).alias("_k"), F.floor(F.col(index) / BLOCK).alias("_b"), place.alias("_p")).groupBy("_k", "_b").agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    hide = lambda start: F.aggregate("_ps", start, lambda until, p: F.when(p >= until, p + window + 1).otherwise(until))
    steps = F.transform(F.sequence(F.lit(0), F.lit(window)), lambda s: F.greatest(F.lit(0), hide(s) - BLOCK))
    none = F.expr("cast(array() as array<struct<b:bigint,s:int>>)")

    def follow(acc, e):
        start = F.when(acc["b"] + 1 == e["_b"], acc["out"]).otherwise(F.lit(0))
        return F.struct(e["_b"].alias("b"), F.get(e["_t"], start).alias("out"), F.when(start > 0, F.concat(acc["seen"], F.array(F.struct(e["_b"].alias("b"), start.alias("s"))))).otherwise(acc["seen"]).alias("seen"))

    before = lambda b, out: F.struct(b.alias("b"), out.alias("out"), none.alias("seen"))
    runs = blocks.select("_k", F.floor(F.col("_b") / BLOCK).alias("_r"), F.struct("_b", steps.alias("_t")).alias("_e")).groupBy("_k", "_r").agg(F.sort_array(F.collect_list("_e")).alias("_c"))
    whole = lambda s: F.aggregate("_c", before(F.col("_r") * BLOCK - 1, s), follow)
    passed = F.transform(F.sequence(F.lit(0), F.lit(window)), lambda s: F.when(whole(s)["b"] == F.col("_r") * BLOCK + BLOCK - 1, whole(s)["out"]).otherwise(F.lit(0)))
    chains = runs.select("_k", F.struct(F.col("_r").alias("_b"), passed.alias("_t")).alias("_e")).groupBy("_k").agg(F.sort_array(F.collect_list("_e")).alias("_c"))
    first = chains.select("_k", F.explode(F.aggregate("_c", before(F.lit(-2).cast("bigint"), F.lit(0)), follow)["seen"]).alias("_s")).select(F.col("_k").alias("_rk"), F.col("_s.b").alias("_rb"), F.col("_s.s").alias("_into"))
    known = runs.join(first, F.col("_k").eqNullSafe(F.col("_rk")) & (F.col("_r") == F.col("_rb")), "left")
    starts = known.select("_k", F.explode(whole(F.coalesce("_into", F.lit(0)))["seen"]).alias("_s")).select(F.col("_k").alias("_sk"), F.col("_s.b").alias("_sb"), F.col("_s.s").alias("_start"))
    known = blocks.join(starts, F.col("_k").eqNullSafe(F.col("_sk")) & (F.col("_b") == F.col("_sb")), "left")
    zero = F.struct(F.coalesce("_start", F.lit(0)).alias("until"), F.expr("cast(array() as array<int>)").alias("kept"))
    fold = F.aggregate("_ps", zero, lambda a, p: F.when(p >= a["until"], F.struct((p + window + 1).alias("until"), F.concat(a["kept"], F.array(p)).alias("kept"))).otherwise(a))
    kept = known.select("_b", F.explode(fold["kept"]).alias("_p")).select((F.col("_b") * BLOCK + F.col("_p")).alias("_kept"))
    return rows.join(kept, F.col(index) == F.col("_kept"), "left_semi")


def with_query_count(rows: DataFrame, key: str = "query") -> DataFrame:
    """rows with same_query_count, by a pre-aggregated join rather than a window, so a hot query doesn't land in one task."""
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("same_query_count"))
    return rows.join(counts, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def clean(rows: DataFrame) -> DataFrame:
    """Counts over all rows, then the windowed dedup."""
    return dedup_window(with_query_count(rows))


def count_queries(rows: DataFrame) -> DataFrame:
    """query, count; most frequent first, ties by first row."""
    return rows.groupBy("query").agg(F.count("*").alias("count"), F.min("row_idx").alias("first_idx")).orderBy(F.desc("count"), "first_idx")


def category_rank(col: str = "ai_classification") -> Column:
    """Place in the known order; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col(col)).cast("int"), F.lit(0))


def count_labels(rows: DataFrame, col: str = "ai_classification") -> DataFrame:
    """Known labels in their order, then others by count and first row; with their share."""
    n = rows.groupBy(col).agg(F.count("*").alias("count"), F.min("row_idx").alias("first_idx"))
    total = n.agg(F.sum("count").alias("total"))
    known = category_rank(col)
    return n.crossJoin(F.broadcast(total)).select(col, "count", percent(F.col("count"), F.col("total")).alias("ratio"), known.alias("_known"), "first_idx").orderBy(F.col("_known").asc_nulls_last(), F.desc("count"), "first_idx").drop("_known", "first_idx")  # total: one row


def summary(rows: DataFrame) -> DataFrame:
    """Rows, distinct queries, queries that repeat."""
    return rows.groupBy("query").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("uniques"), F.count_if(F.col("n") > 1).alias("duplicated"))


def log_date(col: str = "datetime") -> Column:
    return F.when(F.length(F.trim(col)) < 10, "unknown").otherwise(F.substring(F.col(col), 1, 10))


def log_hour(col: str = "datetime", shift: int = 9) -> Column:
    """Hour of day after the shift; null if the text has none."""
    return F.pmod(F.expr(f"try_cast(substr({col}, 12, 2) as int)") + shift, F.lit(24))


def daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy(log_date().alias("date")).agg(F.count("*").alias("count"))


def hourly(rows: DataFrame) -> DataFrame:
    """24 rows, zeros filled, and `unknown` if there are any."""
    n = rows.groupBy(log_hour().alias("h")).agg(F.count("*").alias("n"))
    hours = rows.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    filled = hours.join(n, F.col("hour") == F.col("h"), "left").select(F.col("hour").cast("string").alias("hour_jst"), F.coalesce("n", F.lit(0)).alias("count"))
    return filled.unionByName(n.where("h is null and n > 0").select(F.lit("unknown").alias("hour_jst"), F.col("n").alias("count")))


def parse_proximity(col: str = "proximity") -> tuple[Column, Column]:
    """(lng, lat) of 'lng,lat'; null unless there are two finite numbers."""
    parts = F.split(F.col(col), ",")
    number = lambda k: F.when(F.size(parts) == 2, F.nullif(F.get(parts, k).try_cast("double"), F.lit(float("nan"))))
    lng, lat = number(F.lit(0)), number(F.lit(1))
    fine = lng.isNotNull() & lat.isNotNull() & (F.abs(lng) < float("inf")) & (F.abs(lat) < float("inf"))
    return F.when(fine, lng), F.when(fine, lat)


def nearest_prefecture(lng: Column, lat: Column) -> Column:
    """Struct (d, ord) of the nearest of 47, the first of equal ones: a fold over a constant array, no join and no long generated code."""
    table = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(k).alias("k")) for k, (_, y, x, _) in enumerate(PREFECTURES)))
    return F.array_min(F.transform(table, lambda p: F.struct(haversine(lat, lng, p["y"], p["x"], EARTH_KM).alias("d"), p["k"].alias("ord"))))


def with_prefecture(rows: DataFrame, lng: Column, lat: Column, name: str = "ord") -> DataFrame:
    """rows with the place of the nearest prefecture, null without coordinates: the least of 47 squared chords, over a constant array so that generated
    code stays small. Great circles are measured only where a second chord is as good as equal."""
    phi = [(math.radians(y), math.radians(x)) for _, y, x, _ in PREFECTURES]
    units = F.array(*(F.struct(F.lit(math.cos(p) * math.cos(q)).alias("u"), F.lit(math.cos(p) * math.sin(q)).alias("v"), F.lit(math.sin(p)).alias("w"), F.lit(k).alias("k")) for k, (p, q) in enumerate(phi)))
    square = lambda x: x * x
    own = rows.withColumns({"_x": lng, "_y": lat}).withColumns({"_u": F.cos(F.radians("_y")) * F.cos(F.radians("_x")), "_v": F.cos(F.radians("_y")) * F.sin(F.radians("_x")), "_w": F.sin(F.radians("_y"))})
    chords = F.transform(units, lambda p: F.struct((square(F.col("_u") - p["u"]) + square(F.col("_v") - p["v"]) + square(F.col("_w") - p["w"])).alias("c"), p["k"].alias("k")))
    near = own.withColumn("_s", F.slice(F.array_sort(chords), 1, 2))
    best, second = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    place = F.when(second["c"] <= best["c"] * (1 + 1e-9) + 1e-15, nearest_prefecture(F.col("_x"), F.col("_y"))["ord"]).otherwise(best["k"])
    return near.withColumn(name, F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), place)).drop("_x", "_y", "_u", "_v", "_w", "_s")


def by_prefecture(rows: DataFrame) -> DataFrame:
    """47 rows, zeros filled, then rows without proximity; rate over all rows. Distinct proximities are located once."""
    n = rows.groupBy("proximity").agg(F.count("*").alias("n"))
    lng, lat = parse_proximity()
    n = with_prefecture(n, lng, lat, "k").groupBy("k").agg(F.sum("n").alias("n"))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    names = rows.sparkSession.createDataFrame([(k, p[0], p[3]) for k, p in enumerate(PREFECTURES)] + [(None, "(no proximity)", "")], "ord int, prefecture string, prefecture_romaji string")
    return names.join(n, F.col("ord").eqNullSafe(F.col("k")), "left").crossJoin(F.broadcast(total)).select("prefecture", "prefecture_romaji", F.coalesce("n", F.lit(0)).alias("count"), percent(F.coalesce("n", F.lit(0)), F.col("total")).alias("rate_pct"))  # total: one row


def top_queries(rows: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent queries of each category, ties by first row."""
    counts = rows.groupBy("ai_classification", "query").agg(F.count("*").alias("count"), F.min("row_idx").alias("first_idx"))
    w = Window.partitionBy("ai_classification").orderBy(F.desc("count"), "first_idx")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("first_idx")


def daily_category(rows: DataFrame) -> DataFrame:
    """Every date with every category that occurs, and the category's share of the day."""
    n = rows.groupBy(log_date().alias("date"), "ai_classification").agg(F.count("*").alias("n"))
    days, cats = n.groupBy("date").agg(F.sum("n").alias("total")), n.select(F.col("ai_classification").alias("cat")).distinct()
    spine = days.crossJoin(cats)  # the dense days x categories result itself
    joined = spine.join(n, (spine.date == n.date) & spine["cat"].eqNullSafe(n.ai_classification), "left")
    return joined.select(spine.date, F.col("cat").alias("ai_classification"), F.coalesce("n", F.lit(0)).alias("count"), percent(F.coalesce("n", F.lit(0)), F.col("total")).alias("ratio"))


def column_usage(rows: DataFrame) -> DataFrame:
    """Rows with a non-blank value, for each parameter, in one pass."""
    used = rows.agg(F.count("*").alias("total"), *(F.count_if(F.regexp_replace(c, r"[\s　]", "") != "").alias(c) for c in USAGE_COLUMNS))
    return used.unpivot("total", USAGE_COLUMNS, "parameter", "count").select("parameter", "count", "total", percent(F.col("count"), F.col("total")).alias("rate_pct"))


def bucket(n: Column) -> Column:
    out = F.lit("unknown")
    for label, low, _ in LONG_TAIL[::-1]:
        out = F.when(n >= low, label).otherwise(out)
    return out


def long_tail(rows: DataFrame) -> DataFrame:
    """scope (all, then each category) x bucket of a query's count: distinct queries, rows and share of rows, zeros filled."""
    per = rows.groupingSets([["query"], ["ai_classification", "query"]], "ai_classification", "query").agg(F.count("*").alias("n"), F.grouping("ai_classification").alias("g"))
    scoped = per.select(F.when(F.col("g") == 1, "all").otherwise(F.concat(F.lit("category:"), F.col("ai_classification"))).alias("scope"), "n")
    n = scoped.groupBy("scope", bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("u"), F.sum("n").alias("t"))
    scopes = n.groupBy(F.col("scope").alias("s")).agg(F.sum("t").alias("all"))
    spine = scopes.select("s", "all", F.explode(F.array(*(F.lit(b) for b, _, _ in LONG_TAIL))).alias("b"))
    out = spine.join(n, (F.col("s") == F.col("scope")) & (F.col("b") == F.col("bucket")), "left")
    return out.select(F.col("s").alias("scope"), F.col("b").alias("bucket"), F.coalesce("u", F.lit(0)).alias("unique_query_count"), F.coalesce("t", F.lit(0)).alias("total_count"), percent(F.coalesce("t", F.lit(0)), F.col("all")).alias("volume_pct"))


def apply_labels(rows: DataFrame, labels: DataFrame, only: str | None = None, default: str = "others") -> DataFrame:
    """rows with ai_classification from labels (query, label). only: replace it just where it equals this category."""
    joined = rows.join(labels.select(F.col("query").alias("_q"), "label"), F.col("query") == F.col("_q"), "left").drop("_q")
    old = F.col("ai_classification") if only else F.lit(default)
    new = F.coalesce("label", old)
    return joined.withColumn("ai_classification", F.when(F.col("ai_classification") == only, new).otherwise(old) if only else new).drop("label")


def retry_targets(rows: DataFrame, category: str = "others", most: int | None = None) -> DataFrame:
    """Rows of a category, the first `most` by row_idx."""
    chosen = rows.where(F.col("ai_classification") == category)
    return chosen if most is None else chosen.orderBy("row_idx").limit(most)


def retry(rows: DataFrame, classify, category: str = "others", most: int | None = None) -> DataFrame:
    """rows with new labels for those of a category, the first `most` by row_idx: these rows only, though others may ask the same. classify: rows -> (query, label)."""
    chosen = retry_targets(rows, category, most)
    new = chosen.join(classify(chosen).select(F.col("query").alias("_q"), "label"), F.col("query") == F.col("_q")).select(F.col("row_idx").alias("_i"), "label")
    return rows.join(new, F.col("row_idx") == F.col("_i"), "left").withColumn("ai_classification", F.coalesce("label", "ai_classification")).drop("_i", "label")


def usage_distribution(counts: DataFrame, col: str = "count") -> DataFrame:
    """Queries that occur once, 2 to 10, 11 to 50 and more often."""
    c = F.col(col).try_cast("double")
    return counts.agg(F.count_if(c == 1).alias("n_1"), F.count_if((c >= 2) & (c <= 10)).alias("n_2_10"), F.count_if((c >= 11) & (c <= 50)).alias("n_11_50"), F.count_if(c >= 51).alias("n_51"))


def filter_rows(rows: DataFrame, category: str | None = None, least_count: int | None = None, text: str | None = None) -> DataFrame:
    """Conjunction of the filters that are given; text is looked for in all columns, without case."""
    if category:
        rows = rows.where(F.col("ai_classification") == category)
    if least_count:
        rows = rows.where(F.col("same_query_count") >= least_count)
    if text:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *rows.columns)), F.lit(text.lower())))
    return rows


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    return rows.orderBy("row_idx").offset(offset).limit(limit)


def values_in_order(rows: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column as they first occur; empty ones not."""
    return rows.where(F.coalesce(F.trim(col), F.lit("")) != "").groupBy(F.col(col).alias("value")).agg(F.min("row_idx").alias("first_idx")).orderBy("first_idx")


#: Parameter: (the roles of columns that hold it, whether it is a number). A role may be stated for either side.
ROLES = {
    "query": (("q", "query"), False), "lat": (("proximity(lat)", "location(lat)"), True), "lng": (("proximity(lng)", "location(lng)"), True), "bbox": (("bbox",), False), "bbox_lat": (("bbox(lat)",), True), "bbox_lng": (("bbox(lng)",), True),
    "limit": (("limit",), True), "language": (("language",), False), "country": (("country",), False), "near": (("near",), False), "navigation_profile": (("navigation_profile",), False), "radius": (("radius",), True), "type": (("type",), False), "region": (("region",), False),
}
LISTS = ("types", "poi_category", "poi_category_exclusion")


def requests_of_rows(rows: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Search parameters of each row, from the roles of its columns (column: role). `proximity` is `lng,lat`, `location` is `lat,lng`; lists are
    cut at commas; numbers are what a value begins with; empty values and absent roles give null."""
    value = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    by_role = {}
    for column, role in roles.items():
        by_role.setdefault(role, []).append(value(column))
    first = lambda names: F.coalesce(*(x for n in names for x in by_role.get(n, [])), F.lit(None).cast("string"))

    def pair(role: str, place: int) -> Column:
        parts = F.split(first([role]), ",")
        both = [leading_number(F.get(parts, F.lit(k))) for k in (0, 1)]
        return F.when((F.size(parts) == 2) & both[0].isNotNull() & both[1].isNotNull(), both[place])

    out = {name: leading_number(first(names)) if number else first(names) for name, (names, number) in ROLES.items()}
    out["lat"] = F.coalesce(out["lat"], pair("proximity", 1), pair("location", 0))
    out["lng"] = F.coalesce(out["lng"], pair("proximity", 0), pair("location", 1))
    out |= {name: F.filter(F.transform(F.split(first([name]), ","), lambda x: F.trim(x)), lambda x: x != "") for name in LISTS}
    return rows.select("row_idx", *(c.alias(n) for n, c in out.items()))


def visible_columns(rows: DataFrame, roles: dict[str, str], apart: tuple[str, ...] = ("query_type", "query_count")) -> DataFrame:
    """The columns that have a role, but those shown apart."""
    return rows.select(*(c for c in rows.columns if roles.get(c, "(none)") != "(none)" and c not in apart))


def summary_payload(rows: DataFrame, top: int = 10) -> DataFrame:
    """One row: JSON of the aggregates that a commentary is written from; no row of the log is in it."""
    rows = rows.fillna("", ["ai_classification"])
    number = lambda c: F.round(F.regexp_replace(c, "%", "").cast("double"), 1)
    by_key = lambda k: lambda a, b: F.when(a[k] < b[k], -1).when(a[k] > b[k], 1).otherwise(0)
    entries = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)), by_key(k)))
    queries = top_queries(rows, top).groupBy("ai_classification").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "query", "count"))), lambda x: F.struct(x["query"].alias("query"), x["count"].alias("count"))).alias("v")).agg(entries("ai_classification", "v").alias("top_queries_by_category"), F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(category_rank(), F.lit(len(CATEGORIES) + 1)).alias("o"), "ai_classification"))), lambda x: x["ai_classification"]).alias("categories"))
    days = daily_category(rows).groupBy("date").agg(entries("ai_classification", "count").alias("v")).agg(entries("date", "v").alias("daily_category_counts"), F.struct(F.min("date").alias("from"), F.max("date").alias("to")).alias("date_range"))
    usage = column_usage(rows).agg(entries("parameter", F.struct("count", number("rate_pct").alias("rate_pct")).alias("v")).alias("column_usage_rate"))
    tail = long_tail(rows).groupBy("scope").agg(entries("bucket", F.struct(F.col("unique_query_count").alias("unique_queries"), number("volume_pct").alias("volume_pct")).alias("v")).alias("v")).agg(entries("scope", "v").alias("long_tail_distribution"))
    one = queries.crossJoin(days).crossJoin(usage).crossJoin(tail)  # a row each
    return one.select(F.to_json(F.struct("categories", "date_range", "top_queries_by_category", "daily_category_counts", "column_usage_rate", "long_tail_distribution")).alias("payload"))
