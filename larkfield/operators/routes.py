"""Coordinates and routes: precision tables, motorway islands, alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkfield.functions.geo import haversine, round_coordinate, truncate_coordinate


def simplify(points: DataFrame, decimals: int, mode: str = "round") -> DataFrame:
    """points (id, lat, lng) with simplified coordinates and the metres that moves them."""
    cut = (lambda c: round_coordinate(F.col(c), decimals)) if mode == "round" else (lambda c: truncate_coordinate(F.format_string("%.15f", F.col(c)), decimals))
    out = points.withColumn("lat2", cut("lat")).withColumn("lng2", cut("lng"))
    return out.withColumn("offset_m", haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"), 6371000.0, "atan2"))


def precision_table(points: DataFrame, most: int = 15) -> DataFrame:
    """offset_m of each point at 0 to `most` decimals."""
    steps = F.array(*(F.struct(F.lit(k).alias("decimals"), round_coordinate(F.col("lat"), k).alias("lat2"), round_coordinate(F.col("lng"), k).alias("lng2")) for k in range(most + 1)))
    rows = points.select("id", "lat", "lng", F.explode(steps).alias("s"))
    return rows.select("id", "s.decimals", haversine(F.col("lat"), F.col("lng"), F.col("s.lat2"), F.col("s.lng2"), 6371000.0, "atan2").alias("offset_m"))


def islands(slices: DataFrame) -> DataFrame:
    """Consecutive slices of a route (route, pos, class, a, b) merged where both are motorway or toll and one begins where the other ended."""
    w = Window.partitionBy("route").orderBy("pos")
    marked = slices.withColumn("_on", F.col("class").isin("motorway", "toll"))
    new = ~(F.coalesce(F.lag("_on").over(w), F.lit(False)) & F.col("_on") & F.coalesce(F.lag("b").over(w) == F.col("a"), F.lit(False)))
    grouped = marked.withColumn("_new", new.cast("int")).withColumn("_g", F.sum("_new").over(w)).where("_on")
    return grouped.groupBy("route", F.col("_g").alias("island")).agg(F.min_by("a", "pos").alias("a"), F.max_by("b", "pos").alias("b"), F.count("*").alias("slices"))


def add_no_toll(routes: DataFrame, no_toll: DataFrame, seconds: float = 30.0, metres: float = 100.0, most: int = 4) -> DataFrame:
    """The alternatives, at most `most`, and the toll-free route unless one is about as long and far. Both: route_id, duration, distance."""
    own = routes.orderBy("duration", "route_id").limit(most)
    like = own.select(F.col("duration").alias("_t"), F.col("distance").alias("_m"))  # a few rows
    fresh = no_toll.join(F.broadcast(like), (F.abs(F.col("duration") - F.col("_t")) < seconds) & (F.abs(F.col("distance") - F.col("_m")) < metres), "left_anti")
    return own.unionByName(fresh)


def route_info(routes: DataFrame) -> DataFrame:
    """route_id, interchanges and junctions in order without repeats, whether a motorway is used, entry and exit."""
    parts = F.flatten(F.flatten(F.transform("legs", lambda leg: F.transform(leg["steps"], lambda s: s["intersections"]))))
    named = lambda f: F.array_distinct(F.array_compact(F.transform("_p", lambda i: i[f]["name"])))
    ics = named("ic")
    fast = F.exists("_p", lambda i: F.coalesce(F.exists(i["classes"], lambda c: c == "motorway"), F.lit(False)))
    return routes.withColumn("_p", parts).select("route_id", ics.alias("interchanges"), named("jct").alias("junctions"), fast.alias("motorway"), F.get(ics, F.lit(0)).alias("entry"), F.when(F.size(ics) > 0, F.element_at(ics, -1)).alias("exit"))
