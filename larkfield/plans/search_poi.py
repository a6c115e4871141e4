"""Headless place search over DataFrames: one plan from request to ranked rows."""

from __future__ import annotations


import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.functions.geo import LAT_M, LNG_M, TURF_M, haversine, in_box, towards
from larkfield.functions.reference import RAIL_AND_OTHER, ROAD_RANK
from larkfield.functions.text import asks_building, asks_bus_stop, asks_shelter, normalised_search_name, search_name
from larkfield.operators import candidates as lists
from larkfield.operators import layers, search, spatial
from larkfield.plans.schema import expand, problems, with_defaults

#: Metres around anchors of a kind when the request states no reach.
USUAL_REACH = {"station": 600.0, "locality": 800.0}
REACH = 400.0
SCOPE_REACH = 5000.0
#: Classes of lines that a condition's type means.
LINE_CLASSES = {"road": list(ROAD_RANK), "rail": RAIL_AND_OTHER, "water": ["water", "river", "canal", "stream"]}


#: Entrances that a station stands for; metres from it; margin around an anchor that has a box.
ENTRANCES, ENTRANCE_M, BOX_M = 8, 500.0, 300.0
#: Feature types of localities.
LOCALITIES = ("place", "locality", "neighborhood", "district", "region")


def with_search_name(poi: DataFrame) -> DataFrame:
    """poi with its normalised name, search_name: worth storing, as every search of a name reads it."""
    return poi if "search_name" in poi.columns else poi.withColumn("search_name", normalised_search_name("name"))


def named(poi: DataFrame, queries: list[str]) -> DataFrame:
    """Places whose normalised name contains a normalised query."""
    wanted = [q for q in map(search_name, queries) if q]
    if not wanted:
        return poi.limit(0)
    held = with_search_name(poi).where(F.exists(F.array(*map(F.lit, wanted)), lambda q: F.contains(F.col("search_name"), q)))
    return held.select(*poi.columns)


def first_named(poi: DataFrame, text: str):
    """The place a text names: equal names first, then the first by id. One row comes to the driver."""
    rows = with_search_name(named(poi, [text])).withColumn("_e", F.col("search_name") == search_name(text))
    return rows.orderBy(F.desc("_e"), "id").first()


def place_of(poi: DataFrame, text: str) -> tuple[float, float] | None:
    row = first_named(poi, text)
    return (row["lat"], row["lng"]) if row else None


def anchor_points(poi: DataFrame, anchor: dict, features: DataFrame | None = None) -> list[tuple[float, float, float]]:
    """(lat, lng, usual reach) of what an anchor of a kind stands for: a station by its entrances, the one its subtype names if there is one, else
    itself; a crossing among the crossings; a locality among the localities, its box instead of its point; else a place by its name."""
    kind, text = anchor.get("type"), anchor.get("text") or ""
    usual = USUAL_REACH.get(kind, REACH)
    if kind in ("intersection", "crossing") and features is not None:
        crossings = features.where((F.col("layer") == "road") & (F.col("class") == "intersection"))
        at = place_of(crossings.select("id", "name", "lat", "lng"), text)
        return [(*at, usual)] if at else []
    pool = poi.where(F.col("feature_type").isin(*LOCALITIES)) if kind == "locality" and "feature_type" in poi.columns else poi
    row = first_named(pool, text)
    if not row:
        return []
    if kind == "station" and features is not None:
        doors = layers.entrances(features, row["lat"], row["lng"], ENTRANCE_M, ENTRANCES).collect()  # ENTRANCES rows at most
        wanted = search_name((anchor.get("subtype") or {}).get("exit"))
        exact = [d for d in doors if wanted and wanted in search_name(d["name"])]
        if doors:
            return [(d["lat"], d["lng"], usual) for d in exact or doors]
    if "bbox" in poi.columns and row["bbox"]:
        b = row["bbox"]
        half = max((b["max_lat"] - b["min_lat"]) * LAT_M, (b["max_lng"] - b["min_lng"]) * LNG_M) / 2
        return [((b["min_lat"] + b["max_lat"]) / 2, (b["min_lng"] + b["max_lng"]) / 2, half + BOX_M)]
    return [(row["lat"], row["lng"], usual)]


def centres(poi: DataFrame, near: dict, point: tuple[float, float] | None = None, features: DataFrame | None = None) -> list[tuple[float, float, float]]:
    """(lat, lng, usual reach) of each anchor that resolves; without any, of the scope, then of the request's own point."""
    found = [p for a in near.get("anchors") or [] if a.get("text") for p in anchor_points(poi, a, features)]
    scope = (near.get("scope") or {}).get("text")
    if not found and scope and (at := place_of(poi, scope)):
        found = [(*at, SCOPE_REACH)]
    return found or ([(*point, REACH)] if point else [])


def box_around(points: list[tuple[float, float, float]], reaches: list[float]) -> tuple[float, float, float, float]:
    """(min_lng, min_lat, max_lng, max_lat) of circles of reaches[k] metres around the points."""
    wide = lambda p, m: m * 1.02 / (LNG_M * max(1e-6, math.cos(math.radians(p[0]))))
    high = lambda m: m * 1.02 / LAT_M
    both = list(zip(points, reaches))
    return min(p[1] - wide(p, m) for p, m in both), min(p[0] - high(m) for p, m in both), max(p[1] + wide(p, m) for p, m in both), max(p[0] + high(m) for p, m in both)


def within_box(rows: DataFrame, box: tuple[float, float, float, float], margin_m: float = 0.0) -> DataFrame:
    """rows in a box with a margin, a filter that reaches the scan; all rows where it goes round the globe."""
    a, b, c, d = box
    dy, dx = margin_m * 1.02 / LAT_M, margin_m * 1.02 / (LNG_M * max(1e-6, math.cos(math.radians(max(abs(b), abs(d))))))
    rows = rows.where(F.col("lat").between(b - dy, d + dy))
    return rows if a - dx < -180 or c + dx > 180 else rows.where(F.col("lng").between(a - dx, c + dx))


def collect(poi: DataFrame, queries: list[str], box: tuple[float, float, float, float], margin_m: float = 0.0, features: DataFrame | None = None, target: bool = False) -> DataFrame:
    """(poi's columns) of what the queries ask for in a box: bus stops, shelters, crossings, signals and station entrances from their layers, buildings from
    theirs and by name, all else by name. A target without a bus stop is looked for by name."""
    own = within_box(poi, box, margin_m)
    if features is None:
        return named(own, queries)
    area = within_box(features, box, margin_m)
    shaped = lambda rows: rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(poi.schema[c].dataType).alias(c) for c in poi.columns))
    asked = lambda f: any(q and poi.sparkSession.range(1).select(f(F.lit(q))).first()[0] for q in queries)  # noqa: E731  on the driver's row
    if asked(asks_bus_stop):
        stops = shaped(area.where((F.col("layer") == "transit_stop_label") & (F.col("mode") == "bus") & (F.col("stop_type") == "stop")))
        return named(own, queries) if target and stops.isEmpty() else stops
    if asked(asks_shelter):
        return shaped(area.where(F.col("layer") == "shelter"))
    for words, rows in (((("交差点", "crossing")), (F.col("layer") == "road") & (F.col("class") == "intersection")), (("信号", "signal"), (F.col("layer") == "road") & (F.col("class") == "traffic_signals")), (("出口", "入口", "exit"), (F.col("layer") == "transit_stop_label") & ((F.col("maki") == "entrance") | (F.col("stop_type") == "entrance")))):
        if any(w in (q or "").lower() for q in queries for w in words):
            return shaped(area.where(rows))
    if asked(asks_building):
        return named(own, queries).unionByName(named(shaped(area.where((F.col("layer") == "poi_label") & (F.col("class") == "building"))), queries)).dropDuplicates(["id"])
    return named(own, queries)


def span_of(within: dict, usual: float) -> tuple[float | None, float]:
    """(inner, outer) metres of a stated reach: by level, as a ring, by minutes, by metres; else (None, usual). A ring without outer end goes half as far again."""
    speed = search.SPEEDS.get(within.get("profile") or "walking", 80)
    first = lambda *keys: next((within[k] for k in keys if within.get(k) is not None), None)
    low, high, metres = first("minMinutes"), first("maxMinutes", "minutes"), first("maxMeters", "meters")
    radius = search.DISTANCE_LEVELS.get(within.get("level"), (None, None, None))[1]
    if within.get("level"):
        return None, radius or usual
    if low is not None:
        return low * speed, high * speed if high is not None else low * speed * 1.5
    return None, high * speed if high is not None else metres if metres is not None else usual


def reachable(rows: DataFrame, points: list[tuple[float, float, float]], within: dict) -> DataFrame:
    """rows within the stated reach of any of the points, with the distance of the nearest."""
    far = [haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"), TURF_M, "atan2") for lat, lng, _ in points]
    inside = None
    for d, (_, _, usual) in zip(far, points):
        inner, outer = span_of(within, usual)
        one = d <= outer if inner is None else (d <= outer) & (d >= inner)
        inside = one if inside is None else inside | one
    return rows.where(inside).withColumn("distance", F.least(*far) if len(far) > 1 else far[0])


def narrowed(rows: DataFrame, items: DataFrame, radius_m: float = 250.0) -> DataFrame:
    """rows within the box around items, padded: for a search with too many results, around its most selective condition."""
    box = spatial.extent(items, radius_m).select(F.struct("min_lng", "min_lat", "max_lng", "max_lat").alias("_box"))
    return rows.crossJoin(F.broadcast(box)).where(in_box(F.col("lat"), F.col("lng"), F.col("_box"))).drop("_box")  # box: one row


def held(rows: DataFrame) -> DataFrame:
    """A bounded table's rows as a table of their own: what follows reads them, not the plan behind them."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def search_poi(
    poi: DataFrame, request: dict, ratings: DataFrame | None = None, blocked: list[str] = (), most: int = 150, least: float = 0.3, point: tuple[float, float] | None = None, trace: list | None = None,
    features: DataFrame | None = None, lines: DataFrame | None = None, removed: list[str] = (), prefilter: bool = False, merges=None, reach=None,
) -> DataFrame:
    """rank, id, name, lat, lng, score of a request (long or short keys) over poi: id, name, lat, lng, and if known floors, building, poi_category,
    feature_type, bbox and search_name (the normalised name, stored).

    Order of steps: collection in the target's box, name rules, dedup by name, reach, same building, floors, narrowing (more than `most` rows left: to the
    surroundings of the condition with the fewest places), nearest `most`, conditions (prefilter: rows that meet none go), categories, ratings,
    clusters, scores, threshold and outlier cut. Conditions look in the target's box and their own reach around it. An unresolved anchor or a
    request without target gives no rows.

    features: layers that bus stops, crossings, entrances and buildings come from; lines: id, class, line of roads, rails and waters; removed: categories
    that a model removes; merges(rows): rows after a model's merges; reach(lat, lng, minutes): a ring for travel times, else circles; trace: a
    list that gets (step, rows left) of each step, to be counted.
    """
    plan = with_defaults(expand(request))
    empty = poi.select(F.lit(1).alias("rank"), "id", "name", "lat", "lng", F.lit(0.0).alias("score")).limit(0)
    if problems(plan):
        return empty
    near, target = plan["proximity"], plan["target"]
    points = centres(poi, near, point, features)
    if not points:
        return empty
    step = (lambda name, df: trace.append((name, df))) if trace is not None else lambda name, df: None
    within = near["within"] or {}
    box = box_around(points, [span_of(within, usual)[1] for *_, usual in points])
    rows = collect(poi, target["queries"], box, features=features, target=True)
    rows = search.drop_blocked(search.drop_building_names(rows, target["query_intent"]), list(blocked))
    listed = rows.select("*", F.lit(0).alias("group"), F.col("id").alias("pos"), haversine(F.lit(points[0][0]), F.lit(points[0][1]), F.col("lat"), F.col("lng"), TURF_M, "atan2").alias("distance"))
    rows = lists.dedup_names(listed).drop("group", "pos", "distance")
    step("names", rows)
    if reach is not None and (within.get("minMinutes") is not None or within.get("maxMinutes") is not None):
        speed = search.SPEEDS.get(within.get("profile") or "walking", 80)
        area = spatial.reach_area(points[0][0], points[0][1], within.get("minMinutes"), within.get("maxMinutes"), speed, reach, box)
        rows = spatial.in_area(rows, area).withColumn("distance", haversine(F.lit(points[0][0]), F.lit(points[0][1]), F.col("lat"), F.col("lng"), TURF_M, "atan2"))
    else:
        rows = reachable(rows, points, within)
    if near["bearing_filter"]:
        rows = rows.where(towards(F.col("lat"), F.col("lng"), F.lit(points[0][0]), F.lit(points[0][1]), F.lit(near["bearing_filter"]), strict=False))
    step("reach", rows)
    for c in plan["conditions"]:
        if search.reach_of(c["distance"]).by_building and "building" in poi.columns:
            items = named(within_box(poi, box, BOX_M), c["queries"])
            if not items.isEmpty():
                rows = spatial.same_building(rows, items).where(~F.col("same") if c["negate"] else F.col("same")).drop("same")
    floors = target.get("floors")
    if floors and "floors" in poi.columns:
        rows = rows.where(search.floor_pass(F.col("floors"), floors.get("value"), floors.get("min"), floors.get("max"), floors["negate"]))
    step("rules", rows)
    tested = []
    for c in plan["conditions"]:
        how = search.reach_of(c["distance"])
        if not how.by_building and not how.pushback:
            along = lines is not None and c["type"] in LINE_CLASSES
            found = lines.where(F.col("class").isin(*LINE_CLASSES[c["type"]])) if along else collect(poi, c["queries"], box, how.reference_m, features)
            tested.append((c, how, found, along))
    if [t for t in tested if not t[3] and not t[0]["negate"]] and rows.limit(most + 1).count() > most:
        counts = [(f.count(), k) for k, (c, _, f, along) in enumerate(tested) if not along and not c["negate"]]  # a number a condition, three at most
        if tight := [x for x in counts if x[0]]:
            _, how, found, _ = tested[min(tight)[1]]
            rows = narrowed(rows, found, max(250.0, how.reference_m))
            step("narrowed", rows)
    columns = [c for c in ("poi_category",) if c in poi.columns]
    rows = held(search.cap(rows, most).select("id", "name", "lat", "lng", "distance", *columns))  # `most` rows
    step("capped", rows)
    hits, labels = None, []
    for c, how, found, along in tested:
        label = c.get("text") or c["type"]
        met = spatial.nearest_line(rows, found, how.reference_m) if along else spatial.nearest_match(rows, found, how.reference_m, c["direction"], 32 if how.minutes else None)
        one = search.condition_hits(rows, met, label, how.reference_m, c["negate"])
        hits = one if hits is None else hits.unionByName(one)
        labels.append(label)
    hits = held(hits) if hits is not None else None  # a row a candidate and condition
    if prefilter and hits is not None:
        some = hits.select(F.col("id").alias("_id")).distinct()
        met = rows.join(some, F.col("id") == F.col("_id"), "left_semi")
        rows = rows if met.isEmpty() else met
        step("conditions", rows)
    if removed and columns:
        gone = rows.sparkSession.createDataFrame([("0", list(removed))], "group string, remove array<string>")
        rows = search.drop_categories(rows.withColumn("group", F.lit("0")), gone).drop("group")
        step("categories", rows)
    rows = search.rate(rows, ratings, strict=True) if ratings is not None else rows.withColumn("relevance", F.lit("unknown"))
    order = search.Window.partitionBy(F.lit(0)).orderBy("distance", "id")  # capped above
    rows = lists.dedup_contained(rows.withColumns({"group": F.lit(0), "pos": F.row_number().over(order)}))
    rows = held((merges(rows) if merges else rows).drop("group", "pos", *columns))  # `most` rows at most
    step("clusters", rows)
    rows = rows.withColumn("reach_sec", F.lit(None).cast("double")).withColumn("floors", F.lit(None).cast("int"))
    hits = hits if hits is not None else rows.select("id", F.lit("").alias("condition"), F.lit(0.0).alias("closeness")).limit(0)
    reference = max(1.0, span_of(within, points[0][2])[1])
    scored = search.evaluate(rows, hits, labels, search.LITE, reference_m=reference, evaluated=list(labels)) if labels else search.evaluate(rows, hits, ["-"], search.LITE, reference_m=reference)
    kept = search.outliers(held(scored), least)
    step("scores", kept)
    return kept.select(F.row_number().over(search.Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")).alias("rank"), "id", "name", "lat", "lng", "score")  # capped above


#: Most results by how specific a query is.
LIMITS = {"unique": 5, "brand": 20, "generic": 30}


def text_search(poi: DataFrame, query: str, types: list[str] | None = None, box=None, near: tuple[float, float] | None = None, category: str | None = None, specificity: str = "generic") -> DataFrame:
    """Places whose name holds the query, nearest first if near is given, else by id; as many as its specificity allows.

    types: feature types; box: a struct of bounds; category: one of poi_category. Leave one out to search without it. Rows without coordinates
    are left out; only features of a place type keep their bbox.
    """
    rows = poi.where("lat is not null and lng is not null")
    if box is not None:
        rows = rows.where(in_box(F.col("lat"), F.col("lng"), box))
    if types is not None:
        rows = rows.where(F.col("feature_type").isin(types))
    if category is not None:
        rows = rows.where(F.array_contains("poi_category", category))
    if "bbox" in poi.columns:
        rows = rows.withColumn("bbox", F.when(F.col("feature_type") != "poi", F.col("bbox")))
    far = haversine(F.lit(near[0]), F.lit(near[1]), F.col("lat"), F.col("lng"), TURF_M, "atan2") if near else F.lit(None).cast("double")
    return named(rows, [query]).withColumn("distance", far).orderBy("distance", "id").limit(LIMITS.get(specificity, LIMITS["generic"]))


def plain_search(poi: DataFrame, query: str, **options) -> DataFrame:
    """text_search() as ranked results without a score."""
    found = text_search(poi, query, **options)
    w = search.Window.partitionBy(F.lit(0)).orderBy("distance", "id")  # limited above
    return found.select(F.row_number().over(w).alias("rank"), "id", "name", "lat", "lng", F.lit(None).cast("double").alias("score"))


def grounded(names: DataFrame, poi: DataFrame) -> DataFrame:
    """(text, id, lat, lng): suggested names (pos, text) that a place bears, the first by id of each."""
    own = names.select("pos", "text", normalised_search_name("text").alias("_n")).where("_n <> ''")
    place = poi.groupBy(normalised_search_name("name").alias("_p")).agg(F.min(F.struct("id", "lat", "lng")).alias("b"))
    return own.join(place, F.col("_n") == F.col("_p")).select("pos", "text", "b.*")
