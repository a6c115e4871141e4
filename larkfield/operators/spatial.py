"""Spatial joins and set operations over places (id, lat, lng, ...), by equi-joins on grid cells: no cross join, no nested loop."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfield.functions.geo import EARTH_M, LAT_M, LNG_M, TURF_M, bearing, haversine, in_circle_polygon, in_polygon, to_line, to_segment, towards
from larkfield.functions.text import normalised_search_name


def _reach(top: Column, angle: float) -> Column:
    """Degrees of longitude that a circle of `angle` radians spans to either side, its centre at most `top` degrees from the equator; 360 around a pole."""
    return F.when(top + math.degrees(angle) >= 89.9999, 360.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(angle) / F.cos(F.radians(F.least(top, F.lit(89.9999)))))))) * 1.0001


def _columns(band: Column, height: float, angle: float) -> Column:
    """The number of equal columns around the globe that a latitude band is cut into, each as wide as a circle's reach in it."""
    return F.greatest(F.lit(1), F.floor(360 / _reach(F.greatest(F.abs(band * height), F.abs((band + 1) * height)), angle)))


def cells(df: DataFrame, metres: float, spread: bool) -> DataFrame:
    """df with its cell (_cx, _cy); spread: with all cells that a circle of `metres` touches. Bands of latitude are as high as the radius and have
    columns of their own, so that cells hold like areas from the equator to the poles; columns go round the globe."""
    angle = metres * 1.01 / EARTH_M
    height = math.degrees(angle)
    east = F.pmod(F.col("lng") + 180, F.lit(360.0))
    band = F.floor(F.col("lat") / height)
    if not spread:
        n = _columns(F.col("_cy"), height, angle)
        return df.withColumn("_cy", band).withColumn("_cx", F.least(F.floor(east * n / 360), n - 1))
    wide = df.withColumn("_cy", F.explode(F.sequence(band - 1, band + 1))).withColumn("_n", _columns(F.col("_cy"), height, angle))
    own = _reach(F.abs("lat"), angle)
    first, last = F.floor((east - own) * F.col("_n") / 360), F.floor((east + own) * F.col("_n") / 360)
    n = F.col("_n")
    touched = F.when(last - first + 1 >= n, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.transform(F.sequence(first, last), lambda x: F.pmod(x, n)))
    return wide.withColumn("_cx", F.explode(touched)).drop("_n")


def _located(df: DataFrame) -> DataFrame:
    return df.where("lat is not null and lng is not null")


def _near_cells(left: DataFrame, right: DataFrame, metres: float, distance) -> DataFrame:
    """left and right (with lat and lng) side by side as a_lat, a_lng, b_lat, b_lng where at most `metres` apart, with their distance."""
    distance = distance or (lambda y1, x1, y2, x2: haversine(y1, x1, y2, x2, TURF_M, "atan2"))
    a = cells(left, metres, False).withColumnsRenamed({"lat": "a_lat", "lng": "a_lng"})
    b = cells(right, metres, True).withColumnsRenamed({"lat": "b_lat", "lng": "b_lng"})
    out = a.join(b, ["_cx", "_cy"]).withColumn("distance", distance(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")))
    return out.where(F.col("distance") <= metres).drop("_cx", "_cy")


def pairs_within(a: DataFrame, b: DataFrame, metres: float, distance=None, where: Column | None = None, digits: int | None = None, parts: int = 16) -> DataFrame:
    """(a_id, b_id, distance) of points at most `metres` apart, anywhere on the globe. Rows with null coordinates match nothing.

    Rows that share coordinates travel as `parts` lists of ids at most, by hash; lists are measured, not rows, and unfolded where near. digits: of the distance."""
    fold = lambda df, side: _located(df).select("lat", "lng", F.struct("id").alias("_id")).groupBy("lat", "lng", F.pmod(F.xxhash64("_id"), F.lit(parts)).alias("_part")).agg(F.collect_list("_id").alias(side)).drop("_part")  # noqa: E731  structs: null ids stay
    near = _near_cells(fold(a, "_a"), fold(b, "_b"), metres, distance)
    if digits is not None:
        near = near.withColumn("distance", F.round("distance", digits))
    each = near.withColumn("_a", F.explode("_a")).withColumn("_b", F.explode("_b"))
    out = each.select(F.col("_a.id").alias("a_id"), "a_lat", "a_lng", F.col("_b.id").alias("b_id"), "b_lat", "b_lng", "distance")
    return out if where is None else out.where(where)


def nearest_match(mains: DataFrame, items: DataFrame, radius: float, direction: str | None = None, polygon_steps: int | None = None) -> DataFrame:
    """(id, nearest): mains with an item within the radius, and the least distance. Rows that share coordinates are measured once.

    direction: only mains that lie strictly on that side of the item. polygon_steps: the radius is that of a polygon of so many corners.
    """
    near = _near_cells(*(_located(df).select("lat", "lng").distinct() for df in (mains, items)), radius, None)
    if direction:
        near = near.where(towards(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"), F.lit(direction)))
    if polygon_steps:
        near = near.where(in_circle_polygon(F.col("distance"), F.radians(bearing(F.col("b_lat"), F.col("b_lng"), F.col("a_lat"), F.col("a_lng"))), radius, polygon_steps))
    return _by_id(mains, near.groupBy(F.col("a_lat").alias("_lat"), F.col("a_lng").alias("_lng")).agg(F.min("distance").alias("nearest")))


def _by_id(mains: DataFrame, least: DataFrame) -> DataFrame:
    """(id, nearest) of the mains at the coordinates (_lat, _lng) of `least`."""
    own = _located(mains).select("id", "lat", "lng").join(least, (F.col("lat") == F.col("_lat")) & (F.col("lng") == F.col("_lng")))
    return own.groupBy("id").agg(F.min("nearest").alias("nearest"))


def neighbours(points: DataFrame, km: float = 0.2) -> DataFrame:
    """Self-join: each point with the sorted ids of others within km."""
    near = pairs_within(points, points, km * 1000, lambda y1, x1, y2, x2: haversine(y1, x1, y2, x2, 6371000.0, "atan2")).where("a_id <> b_id")
    return near.groupBy(F.col("a_id").alias("id")).agg(F.sort_array(F.collect_list("b_id")).alias("near"))


def uncovered(targets: DataFrame, results: DataFrame, metres: float = 200.0) -> DataFrame:
    """Targets with no result within metres."""
    hit = pairs_within(targets, results, metres).select(F.col("a_id").alias("_id")).distinct()
    return targets.join(hit, F.col("id") == F.col("_id"), "left_anti")


def suggestions(candidates: DataFrame, landmarks: DataFrame, reach: float = 150.0, margin: float = 60.0, most: int = 15) -> DataFrame:
    """Landmarks that have one clearly nearest candidate: within reach, and `margin` nearer than the second; the `most` nearest of each candidate."""
    near = pairs_within(landmarks, candidates, reach + margin).select(F.col("a_id").alias("landmark"), F.col("b_id").alias("candidate"), "distance")
    order = Window.partitionBy("landmark").orderBy("distance", "candidate")  # Spark limits the groups to two before the shuffle
    two = near.withColumn("_r", F.row_number().over(order)).where("_r <= 2").groupBy("landmark").agg(F.min(F.struct("distance", "candidate")).alias("one"), F.max(F.when(F.col("_r") == 2, F.col("distance"))).alias("two"))
    second = F.col("two")
    clear = two.where((F.col("one.distance") <= reach) & (second.isNull() | (second - F.col("one.distance") >= margin)))
    w = Window.partitionBy("candidate").orderBy("distance", "landmark")
    return clear.select("landmark", "one.candidate", "one.distance").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def same_building(mains: DataFrame, items: DataFrame, metres: float = 8.0) -> DataFrame:
    """mains with `same`: an item has the same building id or lies within metres; also where the main's or any item's building is unknown.

    mains, items: id, building, lat, lng. Without items nothing is the same.
    """
    known = items.where("building is not null").select(F.col("building").alias("_b")).distinct()
    near = pairs_within(mains, items, metres).select(F.col("a_id").alias("_n")).distinct()
    state = items.agg(F.count("*").alias("_all"), F.count_if(F.col("building").isNull()).alias("_unknown"))
    joined = mains.join(known, F.col("building") == F.col("_b"), "left").join(near, F.col("id") == F.col("_n"), "left").crossJoin(F.broadcast(state))  # state: one row
    same = (F.col("_all") > 0) & (F.col("building").isNull() | (F.col("_unknown") > 0) | F.col("_b").isNotNull() | F.col("_n").isNotNull())
    return joined.withColumn("same", same).drop("_b", "_n", "_all", "_unknown")


def nearest_building(points: DataFrame, buildings: DataFrame, metres: float = 10.0) -> DataFrame:
    """points with the id of the nearest building within metres, null if none; ties to the smaller id."""
    best = pairs_within(points, buildings, metres).groupBy(F.col("a_id").alias("_id")).agg(F.min(F.struct("distance", "b_id")).alias("_best"))
    return points.join(best, F.col("id") == F.col("_id"), "left").withColumn("building_id", F.col("_best.b_id")).drop("_id", "_best")


def floors(points: DataFrame, buildings: DataFrame, metres: float = 10.0, storey: float = 3.0) -> DataFrame:
    """points with floors of the nearest building with a height: at least 1, null if none."""
    high = buildings.where("height > 0")
    best = pairs_within(points, high, metres).groupBy(F.col("a_id").alias("_id")).agg(F.min(F.struct("distance", "b_id")).alias("_best"))
    joined = points.join(best, F.col("id") == F.col("_id"), "left").withColumn("_bid", F.col("_best.b_id")).join(high.select(F.col("id").alias("_hid"), "height"), F.col("_bid") == F.col("_hid"), "left")
    return joined.withColumn("floors", F.greatest(F.lit(1), F.floor(F.col("height") / storey + 0.5)).cast("int")).withColumn("floors", F.when(F.col("height").isNotNull(), F.col("floors"))).drop("_id", "_best", "_bid", "_hid", "height")


def around(points: DataFrame, lat: float, lng: float, radius: float) -> DataFrame:
    """points within radius, with their distance _d. A box bounds what is read; it goes round the globe and over the poles."""
    angle = radius * 1.01 / EARTH_M
    box = F.col("lat").between(lat - math.degrees(angle), lat + math.degrees(angle))
    if abs(lat) + math.degrees(angle) < 89.9999:
        wide = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat))))) * 1.0001
        inside = F.col("lng").between(lng - wide, lng + wide)
        for turn in (360, -360):
            if lng - wide < -180 or lng + wide > 180:
                inside = inside | F.col("lng").between(lng - wide + turn, lng + wide + turn)
        box = box & inside
    return points.where(box).withColumn("_d", haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"), TURF_M, "atan2")).where(F.col("_d") <= radius)


def _nearest(near: DataFrame, most: int) -> DataFrame:
    return near.orderBy("_d", "id").limit(most).withColumn("distance", F.floor(F.col("_d") + 0.5)).drop("_d")


def scan(points: DataFrame, lat: float, lng: float, radius: float, most: int = 50) -> DataFrame:
    """Named points within radius, nearest first, `most` of them; distance rounded to a metre."""
    return _nearest(around(points.where(F.coalesce("name", F.lit("")) != ""), lat, lng, radius), most)


def scan_layer(features: DataFrame, layer: str, lat: float, lng: float, radius: float, most: int = 50, where: Column | None = None, by_place: int | None = None, named: bool = True) -> DataFrame:
    """scan() over one layer of spatial features, further filtered; by_place: the nearest of those that share coordinates rounded to so many decimals."""
    chosen = features.where(F.col("layer") == layer)
    if where is not None:
        chosen = chosen.where(where)
    if named:
        chosen = chosen.where(F.coalesce("name", F.lit("")) != "")
    near = around(chosen, lat, lng, radius)
    if by_place is not None:
        cell = [F.floor(F.col(c) * 10**by_place + 0.5) for c in ("lat", "lng")]
        near = near.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy("_d", "id"))).where("_r = 1").drop("_r")
    return _nearest(near, most)


def lines_within(mains: DataFrame, lines: DataFrame, radius: float, cell_m: float = 1000.0) -> DataFrame:
    """(id, line_id, d) of mains and lines (id, line: array<struct<lng,lat>>) whose segments come within radius metres, a row a segment, on each
    main's local plane. Lines meet mains by the cells of their segments; a latitude band has cells as wide as its own degrees are short."""
    n = F.greatest(F.size("line") - 1, F.lit(0))
    ends = lines.select("id", F.explode(F.zip_with(F.slice("line", 1, n), F.slice("line", 2, n), lambda p, q: F.array(p, q))).alias("part"))
    height, pad = cell_m / LAT_M, radius / LAT_M * 1.02
    degrees = lambda metres: metres / (LNG_M * F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(F.col("_cy") * height), F.abs((F.col("_cy") + 1) * height)))))))  # noqa: E731  in the band, at its far edge
    width = F.least(F.lit(360.0), degrees(cell_m))
    low, high = (lambda c: F.least(F.col("part")[0][c], F.col("part")[1][c])), (lambda c: F.greatest(F.col("part")[0][c], F.col("part")[1][c]))
    parts = ends.withColumn("_cy", F.explode(F.sequence(F.floor((low("lat") - pad) / height), F.floor((high("lat") + pad) / height))))
    wide = F.least(F.lit(360.0), degrees(radius * 1.02))
    parts = parts.withColumn("_cx", F.explode(F.sequence(F.floor((low("lng") - wide) / width), F.floor((high("lng") + wide) / width))))
    own = mains.where("lat is not null and lng is not null").select("id", "lat", "lng").withColumn("_cy", F.floor(F.col("lat") / height)).withColumn("_cx", F.floor(F.col("lng") / width))
    return own.join(parts.withColumnRenamed("id", "line_id"), ["_cx", "_cy"]).withColumn("d", to_segment(F.col("lat"), F.col("lng"), F.col("part")[0], F.col("part")[1])).where(F.col("d") <= radius).select("id", "line_id", "d")


def nearest_line(mains: DataFrame, lines: DataFrame, radius: float, where: Column | None = None) -> DataFrame:
    """(id, nearest) of mains with a line within radius metres; where: which lines count. Mains that share coordinates, and equal lines, are measured once."""
    points = _located(mains).select("lat", "lng").distinct().withColumn("id", F.struct("lat", "lng"))
    shapes = (lines if where is None else lines.where(where)).select("line").distinct().withColumn("id", F.lit(None))
    near = lines_within(points, shapes, radius).groupBy(F.col("id.lat").alias("_lat"), F.col("id.lng").alias("_lng")).agg(F.min("d").alias("nearest"))
    return _by_id(mains, near)


def split_by_polygons(points: DataFrame, polygons: DataFrame, hole: Column | None = None, cell_deg: float = 0.01) -> DataFrame:
    """points with `inside`: in some polygon (id, ring) and not in the hole. Polygons meet points by the cells of their boxes."""
    x = lambda f: f(F.transform("ring", lambda p: p["lng"]))
    y = lambda f: f(F.transform("ring", lambda p: p["lat"]))
    boxed = polygons.withColumn("_cx", F.explode(F.sequence(F.floor(x(F.array_min) / cell_deg), F.floor(x(F.array_max) / cell_deg)))).withColumn("_cy", F.explode(F.sequence(F.floor(y(F.array_min) / cell_deg), F.floor(y(F.array_max) / cell_deg))))
    own = points.select("id", "lat", "lng").withColumn("_cx", F.floor(F.col("lng") / cell_deg)).withColumn("_cy", F.floor(F.col("lat") / cell_deg))
    hit = own.join(boxed.select("ring", "_cx", "_cy"), ["_cx", "_cy"]).where(in_polygon(F.col("lat"), F.col("lng"), F.col("ring"))).select(F.col("id").alias("_id")).distinct()
    inside = F.col("_id").isNotNull() & (F.lit(True) if hole is None else ~in_polygon(F.col("lat"), F.col("lng"), hole))
    return points.join(hit, F.col("id") == F.col("_id"), "left").withColumn("inside", inside).drop("_id")


def dedup_by_place(points: DataFrame, scale: float = 3000.0, order: str = "id") -> DataFrame:
    """The first of points that share round(coordinate * scale)."""
    cell = [F.floor(F.col(c) * scale + 0.5) for c in ("lat", "lng")]
    first = points.groupBy(*(c.alias(f"_{k}") for k, c in enumerate(cell))).agg(F.min(order).alias("_first"))
    return points.join(first, (cell[0] == F.col("_0")) & (cell[1] == F.col("_1")) & (F.col(order) == F.col("_first"))).drop("_0", "_1", "_first")


def union_sources(*sources: DataFrame, name: str = "name") -> DataFrame:
    """Union in order of priority; of rows with one normalised search name and place (to a thousandth of a degree) the first stays."""
    tagged = [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)]
    out = tagged[0]
    for s in tagged[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(normalised_search_name(name), F.floor(F.col("lng") * 1000 + 0.5), F.floor(F.col("lat") * 1000 + 0.5)).orderBy("_source", "id")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_source")


def within_reach(points: DataFrame, lat: float, lng: float, outer: float | None, inner: float | None = None) -> DataFrame:
    """Points not nearer than inner and not farther than outer."""
    d = haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"), TURF_M, "atan2")
    out = points.withColumn("distance", d)
    if outer is not None:
        out = out.where(F.col("distance") <= outer)
    return out if inner is None else out.where(F.col("distance") >= inner)


def hex_grid(spark, lat: float, lng: float, half_m: float, radius: float = 65.0, overlap: float = 0.95) -> DataFrame:
    """Centres (lat, lng) of a hexagonal cover of a square by circles."""
    step, rise = radius * math.sqrt(3) * overlap, radius * 1.5 * overlap
    n, m = math.ceil(half_m / step) + 1, math.ceil(half_m / rise) + 1
    grid = spark.range(-m, m + 1).select(F.col("id").alias("r")).withColumn("c", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    x, y = (F.col("c") + F.pmod("r", F.lit(2)) / 2) * step, F.col("r") * rise
    return grid.select((F.lit(lat) + y / LAT_M).alias("lat"), (F.lit(lng) + x / (LNG_M * math.cos(math.radians(lat)))).alias("lng"))


def grid_scan(points: DataFrame, min_lng: float, min_lat: float, max_lng: float, max_lat: float, radius: float = 65.0, overlap: float = 0.95, ring: Column | None = None, hole: Column | None = None, buffer_m: float = 0.0, places: int = 3) -> DataFrame:
    """points within radius of a centre of the hexagonal cover of a box, one (the nearest to the middle) of those that share coordinates to `places`
    decimals, nearest first, with distance to the middle. ring: only centres in that polygon or within buffer_m of its edge count; hole: no
    points inside it."""
    lat, lng = (min_lat + max_lat) / 2, (min_lng + max_lng) / 2
    half = max((max_lat - min_lat) * LAT_M, (max_lng - min_lng) * LNG_M * math.cos(math.radians(lat))) / 2
    centres = hex_grid(points.sparkSession, lat, lng, half, radius, overlap).where(F.col("lat").between(min_lat - radius / LAT_M, max_lat + radius / LAT_M)).withColumn("id", F.monotonically_increasing_id())
    if ring is not None:
        edge = F.concat(ring, F.slice(ring, 1, 1))
        centres = centres.where(in_polygon(F.col("lat"), F.col("lng"), ring) | (to_line(F.col("lat"), F.col("lng"), edge) <= buffer_m))
    hit = pairs_within(points, centres, radius).select(F.col("a_id").alias("_id")).distinct()
    rows = points.join(hit, F.col("id") == F.col("_id"), "left_semi")
    if hole is not None:
        rows = rows.where(~in_polygon(F.col("lat"), F.col("lng"), hole))
    rows = rows.withColumn("_d", haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"), TURF_M, "atan2"))
    cell = [F.floor(F.col(c) * 10**places + 0.5) for c in ("lat", "lng")]
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy("_d", "id"))).where("_r = 1").drop("_r")
    return one.withColumn("distance", F.floor(F.col("_d") + 0.5)).drop("_d").orderBy("distance", "id")


def circle_ring(lat: float, lng: float, radius: float, steps: int = 32) -> list[tuple[float, float]]:
    """The regular polygon of `steps` corners (lng, lat) that stands for a circle."""
    angle = radius / TURF_M
    out = []
    for k in range(steps):
        turn = -2 * math.pi * k / steps
        y = math.asin(math.sin(math.radians(lat)) * math.cos(angle) + math.cos(math.radians(lat)) * math.sin(angle) * math.cos(turn))
        x = math.radians(lng) + math.atan2(math.sin(turn) * math.sin(angle) * math.cos(math.radians(lat)), math.cos(angle) - math.sin(math.radians(lat)) * math.sin(y))
        out.append((math.degrees(x), math.degrees(y)))
    return out


def reach_area(lat: float, lng: float, least: float | None, most: float | None, speed: float, source=None, usual: tuple[float, float, float, float] | None = None) -> dict:
    """The area between `least` and `most` minutes from a point: box, outer and hole (rings of lng, lat, or None), too_large.

    source(lat, lng, minutes): a ring, or None where there is none (then a circle by speed, metres a minute, stands in). Without `most` the box is the
    inner area's, half as large again; if that is nearly as wide as the usual box, too_large, and the usual box."""
    ring = lambda minutes: (source(lat, lng, minutes) if source else None) or circle_ring(lat, lng, minutes * speed)
    box = lambda r: (min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r))
    inner, outer = ring(least) if least is not None else None, ring(most) if most is not None else None
    if outer is not None:
        return {"box": box(outer), "outer": outer, "hole": inner, "too_large": False}
    if inner is None:
        return {"box": usual, "outer": None, "hole": None, "too_large": False}
    a, b, c, d = box(inner)
    if usual and c - a >= 0.9 * (usual[2] - usual[0]):
        return {"box": usual, "outer": None, "hole": None, "too_large": True}
    x, y = (a + c) / 2, (b + d) / 2
    return {"box": (x - (x - a) * 1.5, y - (y - b) * 1.5, x + (c - x) * 1.5, y + (d - y) * 1.5), "outer": None, "hole": inner, "too_large": False}


def in_area(points: DataFrame, area: dict) -> DataFrame:
    """points within an area's box and outer ring, not in its hole."""
    ring = lambda r: F.array(*(F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in r))
    a, b, c, d = area["box"]
    out = points.where(F.col("lng").between(a, c) & F.col("lat").between(b, d))
    if area["outer"]:
        out = out.where(in_polygon(F.col("lat"), F.col("lng"), ring(area["outer"])))
    return out.where(~in_polygon(F.col("lat"), F.col("lng"), ring(area["hole"]))) if area["hole"] else out


def extent(points: DataFrame, pad_m: float = 150.0) -> DataFrame:
    """One row: the box of all points with a margin, and their mean."""
    e = points.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lng").alias("c"), F.max("lng").alias("d"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    dy, dx = F.lit(pad_m / LAT_M), F.lit(pad_m) / (LNG_M * F.cos(F.radians("lat")))
    return e.select((F.col("c") - dx).alias("min_lng"), (F.col("a") - dy).alias("min_lat"), (F.col("d") + dx).alias("max_lng"), (F.col("b") + dy).alias("max_lat"), "lat", "lng")


