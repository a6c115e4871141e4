"""Comparison of two providers' results, and the append-only feedback log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfield.functions.geo import compact_distance, haversine
from larkfield.functions.text import normalised_address, normalised_name


def _met(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """left's rows beside all rows of the other side's page, with flags by_name and by_place."""
    a = left.select("query_id", "rank", normalised_name("name").alias("n"), normalised_address("address").alias("d"), "lat", "lng")
    b = right.select(F.col("query_id").alias("q"), F.col("rank").alias("other_rank"), normalised_name("name").alias("n2"), normalised_address("address").alias("d2"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    name = (F.col("n") != "") & (F.col("n") == F.col("n2"))
    ends = (F.col("d") != "") & (F.col("d2") != "") & (F.endswith("d", "d2") | F.endswith("d2", "d"))
    near = haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"), 6371000.0, "atan2") <= metres
    no = F.lit(False)
    return a.join(b, F.col("query_id") == F.col("q"), "left").select("query_id", "rank", "other_rank", F.coalesce(name, no).alias("by_name"), (F.coalesce(ends, no) | F.coalesce(near, no)).alias("by_place"))


def match_classes(left: DataFrame, right: DataFrame, metres: float = 50.0) -> DataFrame:
    """left's rows with match: both, name, address or none, against the other provider's rows of the same query.

    name: equal normalised names; address: equal or ending alike, or within metres. both: one row of the other side has both. Results of a query
    are a page, so the join by query is bounded by its size.
    """
    flags = _met(left, right, metres).groupBy("query_id", "rank").agg(F.max(F.col("by_name") & F.col("by_place")).alias("both"), F.max("by_name").alias("by_name"), F.max("by_place").alias("by_place"))
    return flags.select("query_id", "rank", F.when(F.col("both"), "both").when(F.col("by_name"), "name").when(F.col("by_place"), "address").otherwise("none").alias("match"))


def place_matches(left: DataFrame, right: DataFrame, metres: float = 50.0) -> DataFrame:
    """left's rows with match: address if a row of the other side has its place, whatever the names; else none."""
    return _met(left, right, metres).groupBy("query_id", "rank").agg(F.when(F.max("by_place"), "address").otherwise("none").alias("match"))


def top_corroborated(left: DataFrame, right: DataFrame) -> DataFrame:
    """(query_id, rank): left's first row that bears the name of the other side's first row."""
    top = right.groupBy("query_id").agg(F.min_by(F.struct("rank", "name", "address", "lat", "lng"), "rank").alias("t")).select("query_id", "t.*")
    return _met(left, top, 0.0).where("by_name").groupBy("query_id").agg(F.min("rank").alias("rank"))


def diagnosis_rows(left: DataFrame, right: DataFrame, lat: Column, lng: Column) -> DataFrame:
    """(query_id, rank, row): left's rows as `name|match|distance from the centre`, all that a diagnosis is given."""
    km = haversine(lat, lng, F.col("lat"), F.col("lng"), 6371.0, "atan2")
    far = F.coalesce(compact_distance(km * 1000, gap=""), F.lit(""))
    named = left.select("query_id", "rank", F.coalesce("name", F.lit("")).alias("_name"), far.alias("_far"))
    return named.join(place_matches(left, right), ["query_id", "rank"]).select("query_id", "rank", F.concat_ws("|", "_name", "match", "_far").alias("row"))


#: Provider: (id, name, address, lat, lng, types) within its answers.
SHAPES = {
    "legacy": ("place_id", "name", "formatted_address", "geometry.location.lat", "geometry.location.lng", "types"),
    "new": ("id", "displayName.text", "formattedAddress", "location.latitude", "location.longitude", "types"),
    "forward": ("mapbox_id", "name", "full_address", "coordinates.latitude", "coordinates.longitude", "poi_category"),
}


def one_shape(results: DataFrame, provider: str) -> DataFrame:
    """query_id, rank and the provider's answers in one shape; texts that are missing are empty, coordinates 0, types an empty list."""
    key, name, address, lat, lng, types = map(F.col, SHAPES[provider])
    text = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    return results.select("query_id", "rank", text(key, "id"), text(name, "name"), text(address, "address"), F.coalesce(lat, F.lit(0.0)).alias("lat"), F.coalesce(lng, F.lit(0.0)).alias("lng"), F.coalesce(types, F.array().cast("array<string>")).alias("types"))


def latest_round(log: DataFrame) -> DataFrame:
    """Entries of each key's latest round: that of its last entry that has one."""
    last = log.where("roundId is not null").groupBy(F.col("key").alias("_key")).agg(F.max_by("roundId", "seq").alias("_round"))
    return log.join(last, (F.col("key") == F.col("_key")) & (F.col("roundId") == F.col("_round"))).drop("_key", "_round")


def row_states(log: DataFrame) -> DataFrame:
    """key, state, reason of the latest round: its first state entry, else `problem` if it has tickets."""
    now = latest_round(log)
    state = F.col("type") == "state"
    g = now.groupBy("key").agg(F.min_by(F.when(state, F.col("state")), F.when(state, F.col("seq"))).alias("s"), F.min_by(F.when(state, F.col("reason")), F.when(state, F.col("seq"))).alias("r"), F.count_if(F.col("type") == "ticket").alias("tickets"))
    return g.select("key", F.coalesce("s", F.when(F.col("tickets") > 0, "problem"), F.lit("untested")).alias("state"), F.col("r").alias("reason"), "tickets")


def remove_ticket(log: DataFrame, key: str, ticket: str) -> DataFrame:
    """The log without one ticket of a key's latest round."""
    current = latest_round(log.where(F.col("key") == key)).select(F.col("seq").alias("_seq"), F.col("type").alias("_type"), F.col("id").alias("_id")).where((F.col("_type") == "ticket") & (F.col("_id") == ticket))
    return log.join(current.select("_seq"), F.col("seq") == F.col("_seq"), "left_anti")


def append(log_path: str, entries: DataFrame) -> None:
    entries.write.mode("append").parquet(log_path)


def last_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    """The last n turns of each conversation. Spark limits the groups before the shuffle, so a hot conversation brings n rows a task."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def recent_queries(history: DataFrame, most: int = 100) -> DataFrame:
    """Distinct queries, the most recently used first. history: seq, query."""
    return history.groupBy("query").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")).limit(most)
