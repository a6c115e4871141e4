"""Place search: filters over candidates, condition scoring, tiers and outlier cut.

candidates: id, relevance, distance, reach_sec, floors, and what a filter names; hits: id, condition, closeness, one row for each condition met.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkfield.functions.reference import DISTANCE_LEVELS, RELEVANCE, RELEVANCE_UNKNOWN, SPEEDS


@dataclass(frozen=True)
class Weights:
    relevance: float = 0.30
    condition: float = 0.50
    anchor: float = 0.20
    floors: float = 0.40


#: The headless variant: no floors, near places weigh most.
LITE = Weights(relevance=0.20, condition=0.70, anchor=1.00, floors=0.0)


@dataclass(frozen=True)
class Reach:
    """How a condition's distance is tested: by building, not at all, by minutes or by metres."""

    level: str
    by_building: bool = False
    pushback: bool = False
    radius_m: float | None = None
    minutes: float | None = None
    profile: str | None = None

    @property
    def reference_m(self) -> float:
        """Metres at which closeness falls to 0."""
        return self.radius_m or (self.minutes or 0) * SPEEDS.get(self.profile or "walking", 80) or 250.0


def reach_of(distance: dict | None, default: str = "very_close") -> Reach:
    """Explicit metres go before minutes, and both before the level's table row."""
    given = distance or {}
    level = given.get("level") or default
    kind, radius, minutes = DISTANCE_LEVELS.get(level, ("none", None, None))
    if kind == "building_id":
        return Reach(level, by_building=True)
    if kind == "none":
        return Reach(level, pushback=True)
    profile = given.get("profile") or "walking"
    if given.get("meters") is not None:
        return Reach(level, radius_m=given["meters"])
    if given.get("minutes") is not None:
        return Reach(level, minutes=given["minutes"], profile=profile)
    if kind != "circle" and given.get("method") == "isochrone":
        return Reach(level, minutes=minutes, profile=profile)
    return Reach(level, radius_m=radius)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def closeness(nearest: Column, reference_m: float) -> Column:
    """1 at no distance, 0 at the reference; a half where the distance is unknown."""
    return F.when(nearest.isNull(), 0.5).otherwise(clamp(1 - nearest / reference_m))


def weighted(*parts: tuple[float, Column]) -> Column:
    """Mean of the known parts by weight; 0 if none is known."""
    used = [(w, v) for w, v in parts if w > 0]
    top = sum((F.when(v.isNotNull(), w * v).otherwise(0.0) for w, v in used), F.lit(0.0))
    return F.coalesce(F.try_divide(top, sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in used), F.lit(0.0))), F.lit(0.0))


def relevance_score(relevance: Column) -> Column:
    out = F.lit(RELEVANCE_UNKNOWN)
    for name, value in RELEVANCE.items():
        out = F.when(relevance == name, value).otherwise(out)
    return out


def anchor_score(distance: Column, reach_sec: Column, reference_m: float | None, minutes: float | None) -> Column:
    """By travel time where it is known and limited, else by distance; null if neither is."""
    by_time = F.when(reach_sec.isNotNull(), clamp(1 - reach_sec / max(1.0, minutes * 60))) if minutes is not None else F.lit(None).cast("double")
    by_place = F.when(distance.isNotNull(), clamp(1 - distance / reference_m)) if reference_m else F.lit(None).cast("double")
    return F.coalesce(by_time, by_place)


def floor_gap(floors: Column, value=None, least=None, most=None) -> Column:
    """Floors outside of what is asked for."""
    if value is not None:
        return F.abs(floors - value)
    gap = F.lit(0)
    if most is not None:
        gap = F.greatest(gap, floors - most)
    return F.greatest(gap, least - floors) if least is not None else gap


def floor_pass(floors: Column, value=None, least=None, most=None, negate: bool = False, tolerance: int = 0) -> Column:
    """Hard floor test; an unknown floor passes only a negated test or one with just an upper bound."""
    fits = floor_gap(floors, value, least, most) <= (tolerance if value is not None else 0)
    return F.when(floors.isNull(), F.lit(negate or (most is not None and least is None and value is None))).otherwise(~fits if negate else fits)


def condition_hits(candidates: DataFrame, nearest: DataFrame, label: str, reference_m: float, negate: bool = False) -> DataFrame:
    """Rows (id, condition, closeness) of one condition. nearest: (id, nearest) of candidates with a match; negated: those without."""
    if negate:
        return candidates.join(nearest, "id", "left_anti").select("id", F.lit(label).alias("condition"), F.lit(1.0).alias("closeness"))
    return candidates.join(nearest, "id").select("id", F.lit(label).alias("condition"), closeness(F.col("nearest"), reference_m).alias("closeness"))


def evaluate(candidates: DataFrame, hits: DataFrame, conditions: list[str], weights: Weights = Weights(), reference_m: float | None = None, minutes: float | None = None, evaluated: list[str] = (), soft_floors: dict | None = None) -> DataFrame:
    """candidates with hit, total, score, qual_score (without the anchor part) and class (full, partial, none).

    total counts the conditions that some candidate meets, or that are listed as evaluated (the headless variant); repeated labels count each.
    If none is left every candidate is full.
    """
    seen = hits.groupBy("condition").agg(F.count("*").alias("_n")).select(F.col("condition").alias("_label"))
    asked = candidates.sparkSession.createDataFrame([(c,) for c in conditions], "label string")
    some = asked.join(seen, asked.label == F.col("_label"), "left").agg(F.count_if(F.col("_label").isNotNull() | F.col("label").isin(list(evaluated))).alias("total"))
    copies = asked.groupBy("label").agg(F.count("*").alias("_times"))
    per = hits.join(F.broadcast(copies), F.col("condition") == F.col("label")).groupBy(F.col("id").alias("_id")).agg(F.sum("_times").alias("_hit"), F.sum(F.col("closeness") * F.col("_times")).alias("_sum"))  # copies: a row a condition
    c = candidates.join(per, F.col("id") == F.col("_id"), "left").crossJoin(F.broadcast(some))  # some: one row
    condition = F.when(F.col("total") > 0, F.coalesce("_sum", F.lit(0.0)) / F.col("total"))
    rel, near = relevance_score(F.col("relevance")), anchor_score(F.col("distance"), F.col("reach_sec"), reference_m, minutes)
    soft = clamp(1 - floor_gap(F.col("floors"), **soft_floors) / 6.0) if soft_floors else F.lit(None).cast("double")
    parts = [(weights.relevance, rel), (weights.condition, condition), (weights.floors, soft)]
    hit = F.coalesce("_hit", F.lit(0))
    kind = F.when(hit == F.col("total"), "full").when(hit > 0, "partial").otherwise("none")
    return c.withColumn("hit", hit).withColumn("score", F.round(weighted(*parts, (weights.anchor, near)), 3)).withColumn("qual_score", F.round(weighted(*parts), 3)).withColumn("class", kind).drop("_id", "_hit", "_sum")


def tiers(scored: DataFrame) -> DataFrame:
    """scored with rank and tier: full1, full2, full3, then full; partial and none have no rank. Candidates are capped before this."""
    w = Window.partitionBy("class").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.when(F.col("class") == "full", F.row_number().over(w)))
    return ranked.withColumn("tier", F.when(F.col("rank") <= 3, F.concat(F.lit("full"), F.col("rank"))).otherwise(F.col("class")))


def cap(candidates: DataFrame, most: int = 150) -> DataFrame:
    """The nearest `most`; unknown distances last."""
    return candidates.orderBy(F.coalesce("distance", F.lit(9999.0)), "id").limit(most)


def outliers(scored: DataFrame, least: float = 0.3, cut: float = 3.5, gap: float = 0.05) -> DataFrame:
    """Rows of qual_score >= least; of four and more only those whose modified z-score is beyond cut (with no spread: above the median by
    more than gap), unless that is none or all."""
    rows = scored.where(F.col("qual_score") >= least)
    # scores have three decimals: their counts, a thousand rows at most, give both medians and the number flagged from one pass over the candidates
    scores = rows.groupBy(F.col("qual_score").alias("_q")).agg(F.count("*").alias("_k"))
    mid = scores.agg(F.percentile("_q", 0.5, F.col("_k")).alias("_med"), F.sum("_k").alias("_n"))
    off = scores.crossJoin(F.broadcast(mid))  # one row
    mad = off.agg(F.percentile(F.abs(F.col("_q") - F.col("_med")), 0.5, F.col("_k")).alias("_mad"))
    up = F.col("_q") - F.col("_med")
    flagged = off.crossJoin(F.broadcast(mad)).withColumn("_out", F.when(F.col("_mad") < 1e-9, up > gap).otherwise(F.try_divide(0.6745 * up, F.col("_mad")) > cut))  # one row
    total = flagged.agg(F.sum(F.when(F.col("_out"), F.col("_k")).otherwise(0)).alias("_flagged"))
    keep = flagged.crossJoin(F.broadcast(total)).where((F.col("_n") < 4) | (F.col("_flagged") == 0) | (F.col("_flagged") == F.col("_n")) | F.col("_out")).select("_q")  # one row
    return rows.join(F.broadcast(keep), F.col("qual_score") == F.col("_q")).drop("_q")  # a row a score


def rate(candidates: DataFrame, ratings: DataFrame, strict: bool = False) -> DataFrame:
    """candidates with relevance from ratings (name, relevance); 'no' goes, and in the strict variant all but definitely and probably."""
    rated = candidates.drop("relevance").join(ratings.select(F.col("name").alias("_name"), "relevance"), F.col("name") == F.col("_name"), "left").drop("_name")
    rated = rated.withColumn("relevance", F.coalesce("relevance", F.lit("unknown")))
    return rated.where(F.col("relevance").isin("definitely", "probably")) if strict else rated.where(F.col("relevance") != "no")


def drop_categories(candidates: DataFrame, removed: DataFrame, keep_null: bool = True) -> DataFrame:
    """candidates without those whose categories (array) meet their group's removed ones; a group that would be left empty stays whole.

    candidates: group, poi_category; removed: group, remove (array)."""
    joined = candidates.join(removed.select(F.col("group").alias("_g"), "remove"), F.col("group") == F.col("_g"), "left")
    gone = F.when(F.col("poi_category").isNull() | (F.size("poi_category") == 0), F.lit(not keep_null)).otherwise(F.coalesce(F.arrays_overlap("poi_category", "remove"), F.lit(False)))
    marked = joined.withColumn("_gone", gone)
    alive = marked.groupBy(F.col("group").alias("_h")).agg(F.max(~F.col("_gone")).alias("_alive"))
    return marked.join(alive, F.col("group") == F.col("_h")).where(~F.col("_gone") | ~F.col("_alive")).drop("_g", "remove", "_gone", "_h", "_alive")


def drop_blocked(candidates: DataFrame, prefixes: list[str]) -> DataFrame:
    """Without names that begin with a blocked prefix, whatever the case. The list is a parameter."""
    return candidates.where(~F.coalesce(F.exists(F.array(*(F.lit(p.lower()) for p in prefixes)), lambda p: F.startswith(F.lower("name"), p)), F.lit(False))) if prefixes else candidates


def drop_building_names(candidates: DataFrame, intent: str) -> DataFrame:
    """For flats, without names that end like office buildings."""
    return candidates.where(~F.coalesce(F.col("name").rlike("(ビル|ビルヂング|ビルディング)$"), F.lit(False))) if intent in ("mansion", "apartment") else candidates


def in_scope(candidates: DataFrame, inside: Column, near: Column | None = None) -> DataFrame:
    """Rows inside; if there are none those `near` (the headless variant: inside the scope with a margin), by default all."""
    n = candidates.agg(F.count_if(inside).alias("_in"))
    return candidates.crossJoin(F.broadcast(n)).where(inside | ((F.col("_in") == 0) & (F.lit(True) if near is None else near))).drop("_in")  # n: one row


def resolve_category(queries: DataFrame, subnames: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(query, category) where exactly one category fits: its sub-name is the query, or one of its synonyms (synonym, id) lies inside it. subnames: name, id.

    Synonyms meet the pieces of a query of their lengths, so that nothing is compared with everything."""
    asked = queries.select(F.trim("query").alias("query")).where("query <> ''").distinct()
    hit = asked.join(subnames.select("name", "id"), F.col("query") == F.col("name")).select("query", "id")
    if synonyms is not None:
        most = synonyms.agg(F.max(F.length("synonym")).alias("n")).first()["n"] or 0  # a number
        pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("query") - n + 1, F.lit(1))), lambda k: F.substring(F.col("query"), k, F.lit(n)))
        if most:
            parts = asked.select("query", F.explode(F.array_distinct(F.concat(*map(pieces, range(1, most + 1))))).alias("piece"))
            hit = hit.unionByName(parts.join(synonyms, F.col("piece") == F.col("synonym")).select("query", "id"))
    return hit.groupBy("query").agg(F.count_distinct("id").alias("n"), F.min("id").alias("category")).where("n = 1").drop("n")


def travel_times(matrix: DataFrame) -> DataFrame:
    """Least seconds to each destination over all sources (dst, src, sec)."""
    return matrix.groupBy("dst").agg(F.min("sec").alias("sec"))


def confidence(tiered: DataFrame) -> DataFrame:
    """One row: counts of full and partial matches and a label."""
    n = tiered.agg(F.count_if(F.col("class") == "full").alias("full"), F.count_if(F.col("class") == "partial").alias("partial"))
    return n.withColumn("label", F.when(F.col("full") == 1, "decisive").when(F.col("full") > 1, "ambiguous").when(F.col("partial") > 0, "tentative").otherwise("none"))


def basis(tiered: DataFrame) -> DataFrame:
    """Rows that suggestions are drawn from: full matches, else partial ones, else all."""
    n = tiered.agg(F.max(F.when(F.col("class") == "full", 2).when(F.col("class") == "partial", 1).otherwise(0)).alias("_best"))
    best = F.when(F.col("_best") == 2, F.col("class") == "full").when(F.col("_best") == 1, F.col("class") == "partial").otherwise(True)
    return tiered.crossJoin(F.broadcast(n)).where(best).drop("_best")  # n: one row


def category_set(candidates: DataFrame) -> DataFrame:
    """The distinct categories of all candidates."""
    return candidates.select(F.explode("poi_category").alias("category")).distinct()


def subnames(categories: DataFrame) -> DataFrame:
    """(name, ids): category ids by their part after `>`."""
    return categories.groupBy(F.element_at(F.split("id", ">"), F.when(F.contains("id", F.lit(">")), 2).otherwise(1)).alias("name")).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def did_you_mean(guesses: DataFrame, variants: DataFrame, most: int = 5) -> DataFrame:
    """(text, lat, lng): guesses first, then variants, one for each cell of some 30 metres, `most` in all. Both have pos, their order."""
    both = guesses.select(F.lit(0).alias("_s"), "pos", "text", "lat", "lng").unionByName(variants.select(F.lit(1).alias("_s"), "pos", "text", "lat", "lng"))
    cell = [F.floor(F.col(c) * 3000 + 0.5) for c in ("lat", "lng")]
    one = both.withColumn("_r", F.row_number().over(Window.partitionBy(*cell).orderBy("_s", "pos"))).where("_r = 1")
    return one.orderBy("_s", "pos").limit(most).select("text", "lat", "lng")


def merged(listed: DataFrame, merges: DataFrame) -> DataFrame:
    """Rows left of clusters (group, pos, id, name, distance) after a model's merges (group, step, a, b: positions): of a pair the longer name stays, then the nearer.

    A pair with a row that is already gone does nothing. Merges of a cluster are applied in order of step; clusters are of bounded size.
    """
    size = F.length(F.coalesce("name", F.lit("")))
    own = listed.select("group", F.col("pos").alias("p"), size.alias("n"), F.coalesce(F.col("distance").cast("double"), F.lit(9e9)).alias("d"))
    side = lambda c: own.select("group", F.col("p").alias(c), F.struct("p", "n", "d").alias(f"{c}_row"))
    loser = F.when((F.col("a_row.n") > F.col("b_row.n")) | ((F.col("a_row.n") == F.col("b_row.n")) & (F.col("a_row.d") <= F.col("b_row.d"))), F.col("b")).otherwise(F.col("a"))
    steps = merges.join(side("a"), ["group", "a"]).join(side("b"), ["group", "b"]).select("group", F.struct("step", "a", "b", loser.alias("x")).alias("m"))
    gone = F.aggregate(F.array_sort(F.collect_list("m")), F.array().cast("array<bigint>"), lambda out, m: F.when(F.array_contains(out, m["a"].cast("bigint")) | F.array_contains(out, m["b"].cast("bigint")), out).otherwise(F.array_append(out, m["x"].cast("bigint"))))
    dropped = steps.groupBy("group").agg(gone.alias("g")).select("group", F.explode("g").alias("pos"))
    return listed.join(dropped, ["group", "pos"], "left_anti")


def centroid(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
