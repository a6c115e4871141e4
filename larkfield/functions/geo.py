"""Distances, boxes and polygons as column expressions. Radii and metres per degree are parameters; variants are never unified silently."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, EARTH_M, TURF_M = 6371.0, 6371000.0, 6371008.8
LAT_M, LNG_M, COARSE_M = 110540.0, 111320.0, 111000.0


def haversine(lat1, lng1, lat2, lng2, radius: float = EARTH_M, form: str = "asin") -> Column:
    """Great-circle distance in the unit of radius; form asin (its argument clamped) or atan2."""
    half_lat, half_lng = (F.radians(lat2) - F.radians(lat1)) / 2, (F.radians(lng2) - F.radians(lng1)) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    return 2 * radius * (F.asin(F.least(F.lit(1.0), F.sqrt(a))) if form == "asin" else F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def planar(lat1, lng1, lat2, lng2, lat_m: float = LAT_M, lng_m: float = LNG_M) -> Column:
    """Metres on a local plane at the first point's latitude."""
    return F.hypot((lng2 - lng1) * lng_m * F.cos(F.radians(lat1)), (lat2 - lat1) * lat_m)


def in_box(lat, lng, box: Column) -> Column:
    """Inclusive test against struct(min_lng, min_lat, max_lng, max_lat)."""
    return lng.between(box["min_lng"], box["max_lng"]) & lat.between(box["min_lat"], box["max_lat"])


def make_box(min_lng, min_lat, max_lng, max_lat) -> Column:
    return F.struct(min_lng.alias("min_lng"), min_lat.alias("min_lat"), max_lng.alias("max_lng"), max_lat.alias("max_lat"))


def expand_box(box: Column, metres, lat_m: float = COARSE_M, lng_m: float = COARSE_M) -> Column:
    """The box with a margin of metres on each side."""
    middle = F.radians((box["min_lat"] + box["max_lat"]) / 2)
    dy, dx = metres / F.lit(lat_m), metres / (F.lit(lng_m) * F.cos(middle))
    return make_box(box["min_lng"] - dx, box["min_lat"] - dy, box["max_lng"] + dx, box["max_lat"] + dy)


def cap_box(box: Column, half_m: float = 2000.0) -> Column:
    """The box cut to half_m metres around its centre."""
    lat, lng = (box["min_lat"] + box["max_lat"]) / 2, (box["min_lng"] + box["max_lng"]) / 2
    dy, dx = F.lit(half_m / LAT_M), half_m / (F.lit(LNG_M) * F.cos(F.radians(lat)))
    return make_box(F.greatest(box["min_lng"], lng - dx), F.greatest(box["min_lat"], lat - dy), F.least(box["max_lng"], lng + dx), F.least(box["max_lat"], lat + dy))


def intersect_box(a: Column, b: Column) -> Column:
    """Common part; the first box where they are disjoint."""
    both = make_box(F.greatest(a["min_lng"], b["min_lng"]), F.greatest(a["min_lat"], b["min_lat"]), F.least(a["max_lng"], b["max_lng"]), F.least(a["max_lat"], b["max_lat"]))
    return F.when((both["min_lng"] <= both["max_lng"]) & (both["min_lat"] <= both["max_lat"]), both).otherwise(a)


def cut_box(box: Column, direction: Column) -> Column:
    """The half of the box on the north, south, east or west side; the whole box for any other direction."""
    lat, lng = (box["min_lat"] + box["max_lat"]) / 2, (box["min_lng"] + box["max_lng"]) / 2
    return make_box(
        F.when(direction == "east", lng).otherwise(box["min_lng"]),
        F.when(direction == "north", lat).otherwise(box["min_lat"]),
        F.when(direction == "west", lng).otherwise(box["max_lng"]),
        F.when(direction == "south", lat).otherwise(box["max_lat"]),
    )


def towards(lat, lng, lat0, lng0, direction: Column, strict: bool = True) -> Column:
    """Whether a point lies in the direction from (lat0, lng0); true for unknown directions."""
    more = (lambda a, b: a > b) if strict else (lambda a, b: a >= b)
    return F.when(direction == "north", more(lat, lat0)).when(direction == "south", more(lat0, lat)).when(direction == "east", more(lng, lng0)).when(direction == "west", more(lng0, lng)).otherwise(F.lit(True))


def in_circle_polygon(distance: Column, bearing: Column, radius: float, steps: int = 32) -> Column:
    """Whether a point at distance and bearing (radians) lies in the regular polygon of `steps` corners that stands for a circle."""
    part = 2 * math.pi / steps
    return distance * F.cos(F.pmod(bearing, F.lit(part)) - part / 2) <= radius * math.cos(part / 2)


def in_polygon(lat, lng, ring: Column) -> Column:
    """Ray cast against a ring of structs (lng, lat), closed or not."""
    pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    crosses = lambda e: ((e["p"]["lat"] > lat) != (e["q"]["lat"] > lat)) & (lng < e["p"]["lng"] + (lat - e["p"]["lat"]) * F.try_divide(e["q"]["lng"] - e["p"]["lng"], e["q"]["lat"] - e["p"]["lat"]))
    return F.size(F.filter(pairs, crosses)) % 2 == 1


def to_segment(lat, lng, p: Column, q: Column) -> Column:
    """Metres from a point to the segment between two structs (lng, lat), on the point's local plane."""
    scale = F.lit(LNG_M) * F.cos(F.radians(lat))
    x = lambda p: (p["lng"] - lng) * scale
    y = lambda p: (p["lat"] - lat) * LAT_M
    dx, dy = x(q) - x(p), y(q) - y(p)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(x(p) * dx + y(p) * dy), dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(x(p) + t * dx, y(p) + t * dy)


def to_line(lat, lng, line: Column) -> Column:
    """Metres from a point to a polyline of structs (lng, lat), on the point's local plane; null for fewer than two points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.array_min(F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda p, q: to_segment(lat, lng, p, q)))


def snap(value, cell) -> Column:
    """The nearest multiple of cell, halves upwards."""
    return F.floor(value / cell + 0.5) * cell


def compass(bearing_deg) -> Column:
    names = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.get(names, F.pmod(F.floor(F.pmod(bearing_deg, F.lit(360.0)) / 45 + 0.5), F.lit(8)).cast("int"))


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing in degrees from north, 0 to 360."""
    d = F.radians(lng2) - F.radians(lng1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def compact_distance(metres, gap: str = " ") -> Column:
    """950 m, 1.2 km, with gap between number and unit."""
    return F.when(metres < 1000, F.concat(F.floor(metres + 0.5).cast("string"), F.lit(f"{gap}m"))).otherwise(F.concat(F.call_function("format_number", metres / 1000, F.lit("0.0")), F.lit(f"{gap}km")))


def repair(lat, lng) -> tuple[Column, Column]:
    """A pair that can only be swapped (|lat| > 90 and |lng| <= 90) the right way round."""
    swapped = (F.abs(lat) > 90) & (F.abs(lng) <= 90)
    return F.when(swapped, lng).otherwise(lat), F.when(swapped, lat).otherwise(lng)


def round_coordinate(value, decimals: int) -> Column:
    return F.floor(value * 10**decimals + 0.5) / 10**decimals


def truncate_coordinate(text, decimals: int) -> Column:
    """A decimal string cut, not rounded, after `decimals` digits."""
    head, tail = F.substring_index(text, ".", 1), F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise(F.lit(""))
    return (F.when((tail == "") | F.lit(decimals == 0), head).otherwise(F.concat(head, F.lit("."), F.substring(tail, 1, max(decimals, 1))))).cast("double")


def circle_box(lat, lng, radius) -> Column:
    """The rectangle that a centre and a radius stand for, rounded to six decimals."""
    d = radius / COARSE_M
    return make_box(*(F.round(x, 6) for x in (lng - d, lat - d, lng + d, lat + d)))


def box_circle(box: Column) -> Column:
    """struct(lat, lng, radius) that a rectangle stands for."""
    return F.struct(((box["min_lat"] + box["max_lat"]) / 2).alias("lat"), ((box["min_lng"] + box["max_lng"]) / 2).alias("lng"), ((box["max_lat"] - box["min_lat"]) / 2 * COARSE_M).alias("radius"))


def corridor_box(lat1, lng1, lat2, lng2, buffer_m: float = 500.0, half_m: float | None = 500.0) -> Column:
    """The box around the line between two points, buffered; cut to half_m around its middle."""
    around = expand_box(make_box(F.least(lng1, lng2), F.least(lat1, lat2), F.greatest(lng1, lng2), F.greatest(lat1, lat2)), buffer_m)
    return around if half_m is None else cap_box(around, half_m)


def feature_box(box: Column, lat, lng, metres: float = 400.0) -> Column:
    """A feature's own box, else its point with metres around it."""
    return F.coalesce(box, expand_box(make_box(lng, lat, lng, lat), metres))


def implied_travel(lat, lng, left: bool, size_km: float, travel=None) -> Column:
    """The eight cells around a landmark, each with the direction one travels in it with the landmark at the left or right; within 45 degrees of travel if given."""
    size, cells = size_km * 1000, []
    dy, dx = 1 / LAT_M, 1 / (LNG_M * F.cos(F.radians(lat)))
    for row in (1, 0, -1):
        for col in (-1, 0, 1):
            if row or col:
                y, x = lat + row * size * dy, lng + col * size * dx
                way = F.pmod(bearing(y, x, lat, lng) + (90 if left else -90), F.lit(360.0))
                box = make_box(*(F.round(v, 5) for v in (x - size / 2 * dx, y - size / 2 * dy, x + size / 2 * dx, y + size / 2 * dy)))
                cells.append(F.struct(F.lit(("N" if row > 0 else "S" if row else "") + ("E" if col > 0 else "W" if col else "")).alias("position"), F.floor(way + 0.5).alias("bearing"), compass(way).alias("direction"), box.alias("box")))
    off = lambda c: F.abs(c["bearing"] - travel)
    return F.array(*cells) if travel is None else F.filter(F.array(*cells), lambda c: F.least(off(c), 360 - off(c)) <= 45)
