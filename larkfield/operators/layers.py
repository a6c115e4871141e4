"""Named scans over layers of spatial features: id, layer, name, class, mode, stop_type, maki, lat, lng."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.functions.reference import RAIL_AND_OTHER, ROAD_POINTS, ROAD_RANK
from larkfield.functions.text import normalised_search_name, search_name
from larkfield.operators.spatial import around, scan_layer


def _holds(name: str) -> Column:
    return F.contains(normalised_search_name("name"), F.lit(search_name(name)))


def bus_stops(features: DataFrame, lat: float, lng: float, radius: float, most: int = 50) -> DataFrame:
    """Bus stops, one of those that share coordinates to three decimals."""
    return scan_layer(features, "transit_stop_label", lat, lng, radius, most, (F.col("mode") == "bus") & (F.col("stop_type") == "stop"), by_place=3, named=False)


def entrances(features: DataFrame, lat: float, lng: float, radius: float = 500.0, most: int = 50) -> DataFrame:
    """Station entrances within 500 metres at most."""
    way_in = (F.col("maki") == "entrance") | (F.col("stop_type") == "entrance")
    return scan_layer(features, "transit_stop_label", lat, lng, min(radius, 500.0), most, way_in, named=False)


def intersections(features: DataFrame, lat: float, lng: float, radius: float, name: str | None = None, most: int = 50) -> DataFrame:
    """Named crossings, those whose name contains `name` if given."""
    rows = features.where(_holds(name)) if name else features
    return scan_layer(rows, "road", lat, lng, radius, most, F.col("class") == "intersection")


def signals(features: DataFrame, lat: float, lng: float, radius: float, most: int = 50) -> DataFrame:
    return scan_layer(features, "road", lat, lng, radius, most, F.col("class") == "traffic_signals", by_place=3, named=False)


def buildings(features: DataFrame, lat: float, lng: float, radius: float, most: int = 50) -> DataFrame:
    return scan_layer(features, "poi_label", lat, lng, radius, most, F.col("class") == "building")


def shelters(features: DataFrame, lat: float, lng: float, radius: float, name: str | None = None, most: int = 50) -> DataFrame:
    return scan_layer(features.where(_holds(name)) if name else features, "shelter", lat, lng, radius, most)


def malls(features: DataFrame, lat: float, lng: float, radius: float, all_names: bool = False, most: int = 50) -> DataFrame:
    """Names at a point, nearest first: of all features, or of malls and department stores among the nearest. features has type."""
    near = around(features, lat, lng, radius).orderBy("_d", "id").limit(most).withColumn("distance", F.floor(F.col("_d") + 0.5)).drop("_d")
    return near.where((F.coalesce("name", F.lit("")) != "") & (F.lit(all_names) | F.coalesce(F.col("type").isin("Mall", "Department store"), F.lit(False))))


def road_category(kind: Column) -> Column:
    return F.when(kind.isin(list(ROAD_RANK)), "road").when(kind.isin(RAIL_AND_OTHER), "rail and other").when(kind.isin(ROAD_POINTS), "point").when(kind.isNotNull(), "other")


def _nearest_of_names(near: DataFrame, layer: str) -> DataFrame:
    """One row, the nearest, of each name in a layer; rows of other layers and without name all."""
    single = (F.col("layer") == layer) & (F.coalesce("name", F.lit("")) != "")
    key = F.when(F.coalesce(single, F.lit(False)), F.col("name")).otherwise(F.concat(F.lit("\0"), F.col("layer"), F.lit("\0"), F.col("id").cast("string")))
    return near.groupBy(key.alias("_k")).agg(F.min(F.struct("_d", "id", "layer", "name", "class")).alias("r")).select("r.*")


def natural_features(features: DataFrame, lat: float, lng: float, radius: float, most: int = 50) -> DataFrame:
    """Water, waterways, land use and natural labels, the nearest of each label's name, nearest first."""
    chosen = features.where(F.col("layer").isin("water", "waterway", "landuse", "natural_label"))
    one = _nearest_of_names(around(chosen, lat, lng, radius), "natural_label")
    return one.orderBy("_d", "id").limit(most).select("id", "layer", "name", "class", F.floor(F.col("_d") + 0.5).alias("distance"))


def street_features(features: DataFrame, lat: float, lng: float, radius: float, target: str = "both", most: int = 25) -> DataFrame:
    """Roads (the nearest of each name) and transit stops, nearest first. target: road, transit or both."""
    layers = {"road": ["road"], "transit": ["transit_stop_label"]}.get(target, ["road", "transit_stop_label"])
    one = _nearest_of_names(around(features.where(F.col("layer").isin(layers)), lat, lng, radius), "road")
    return one.orderBy("_d", "id").limit(most).select("id", "layer", "name", "class", F.when(F.col("layer") == "road", road_category(F.col("class"))).alias("category"), F.floor(F.col("_d") + 0.5).alias("distance"))


def routable(points: DataFrame) -> DataFrame:
    """points with lat and lng of their first routable point (routable: array<struct<lng,lat>>), else their own."""
    first = F.get("routable", F.lit(0))
    return points.withColumns({"lat": F.coalesce(first["lat"], F.col("lat")), "lng": F.coalesce(first["lng"], F.col("lng"))})

