"""What a model is asked, and what its answers do to tables. A model is any callable from a JSON text to a JSON text; answers that are no JSON, or of
another shape, count as none, and a step without an answer keeps everything.

Payloads are built and applied with DataFrame operations; models.ask() asks each distinct payload once, on the workers.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.functions.reference import CATEGORIES, DIAGNOSED, UNCLEAR
from larkfield.operators import models, search
from larkfield.operators.querylog import LISTS, ROLES
from larkfield.plans.schema import expand, problems, with_defaults, with_inferred_reach

Model = Callable[[str], str]
#: Names that one rating request holds; requests of one batch job.
RATED, JOB = 40, 100_000
#: Levels of relevance, what a refinement does, checks of a place and their verdicts.
LEVELS = ("definitely", "probably", "unknown", "no")
ACTIONS = ("done", "narrow", "research")
CHECKS, VERDICTS = ("exists", "name_current", "address_current", "tags_correct"), ("ok", "ng", "unknown")


class RateLimited(Exception):
    """Raised by a model that asks to be called again later."""


def with_backoff(model: Model, waits: tuple[float, ...] = (1.0, 2.0, 4.0)) -> Model:
    """model, called again after each of the waits (seconds) while it is rate limited."""

    def run(payload: str) -> str:
        for wait in waits:
            try:
                return model(payload)
            except RateLimited:
                time.sleep(wait)
        return model(payload)

    return run


def _json(**columns: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())))


def _answers(rows: DataFrame, model: Model, schema: str) -> DataFrame:
    """(payload, value) of rows' payloads."""
    return models.parsed(models.ask(rows, model), schema).select(F.col("payload").alias("_payload"), "value")


def parse_queries(texts: DataFrame, model: Model, attempts: int = 3) -> DataFrame:
    """(text, request, problems): each distinct text as a search request (JSON, all defaults set, the reach its wording states), and what makes it
    unusable. Without an answer the request is null."""

    def complete(text: str, answer: str | None) -> tuple[str | None, list[str]]:
        try:
            request = with_inferred_reach(with_defaults(expand(json.loads(answer))), text)
        except Exception:
            return None, ["no answer"]
        return json.dumps(request, ensure_ascii=False, sort_keys=True), problems(request)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [complete(json.loads(p)["text"], a) for p, a in zip(frame["payload"], frame["answer"])]
            yield pd.DataFrame({"text": [json.loads(p)["text"] for p in frame["payload"]], "request": [r for r, _ in done], "problems": [x for _, x in done]})

    asked = models.ask(texts.where("text is not null").select(_json(text=F.col("text")).alias("payload")), model, attempts=attempts)
    return asked.mapInPandas(run, "text string, request string, problems array<string>")


def refined(request: dict, delta: dict) -> dict:
    """request with a refinement: new conditions are added (one with the text of an old one replaces it), other parts replace theirs."""
    out = json.loads(json.dumps(request))
    delta = expand(delta or {})
    own = {c.get("text") for c in delta.get("conditions") or []}
    if delta.get("conditions"):
        out["conditions"] = [c for c in out.get("conditions") or [] if c.get("text") not in own] + delta["conditions"]
    for part in ("proximity", "target"):
        if delta.get(part):
            out[part] = (out.get(part) or {}) | delta[part]
    return out


def parse_refinement(request: dict, hint: str, model: Model) -> dict:
    """The request after a hint; the request itself without a usable answer."""
    try:
        return with_defaults(refined(request, json.loads(model(json.dumps({"request": request, "hint": hint}, ensure_ascii=False)))))
    except Exception:
        return request


def filter_categories(candidates: DataFrame, model: Model) -> DataFrame:
    """candidates (group, poi_category) without those of categories that the model removes from their group; a group that would be left empty
    stays whole. The model gets {group, categories} and gives {remove: [...]}."""
    groups = candidates.select("group", F.explode("poi_category").alias("c")).groupBy("group").agg(F.array_sort(F.collect_set("c")).alias("c"))
    asked = groups.select("group", _json(group=F.col("group"), categories=F.col("c")).alias("payload"))
    removed = asked.join(_answers(asked, model, "remove array<string>"), F.col("payload") == F.col("_payload")).select("group", F.coalesce("value.remove", F.array().cast("array<string>")).alias("remove"))
    return search.drop_categories(candidates, removed)


def rate_names(candidates: DataFrame, model: Model, batch: int = RATED) -> DataFrame:
    """(intent, name, relevance) of the distinct (intent, name): rated once each, `batch` names a request. The model gets {intent, names} and gives
    {ratings: [...]}, a level for each name in order; unknown for names without one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for intent, own in frame.groupby("intent", sort=False):
                names = own["name"].tolist()
                for k in range(0, len(names), batch):
                    part = names[k : k + batch]
                    try:
                        got = json.loads(model(json.dumps({"intent": intent, "names": part}, ensure_ascii=False)))["ratings"]
                    except Exception:
                        got = []
                    got = got if len(got) == len(part) else ["unknown"] * len(part)
                    yield pd.DataFrame({"intent": intent, "name": part, "relevance": [x if x in LEVELS else "unknown" for x in got]})

    return candidates.select("intent", "name").where("intent is not null and name is not null").distinct().mapInPandas(run, "intent string, name string, relevance string")


def merge_clusters(listed: DataFrame, model: Model) -> DataFrame:
    """listed (group, pos, id, name, distance) without the rows that the model's pairs merge away. The model gets {names} of a group, in row order, and
    gives {merge: [[a, b], ...]}, positions. Groups are clusters of one search, of bounded size."""
    groups = listed.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("rows")).where(F.size("rows") > 1)
    asked = groups.select("group", _json(group=F.col("group"), names=F.col("rows.name"), positions=F.col("rows.pos")).alias("payload"))
    pairs = asked.join(_answers(asked, model, "merge array<array<bigint>>"), F.col("payload") == F.col("_payload")).select("group", F.posexplode("value.merge").alias("step", "m"))
    merges = pairs.where(F.size("m") == 2).select("group", "step", F.col("m")[0].alias("a"), F.col("m")[1].alias("b"))
    return search.merged(listed, merges)


def suggested(texts: DataFrame, model: Model) -> DataFrame:
    """(text, pos, name): landmarks that the model suggests for a text, to be grounded in the places there are. It gives {names: [...]}."""
    asked = texts.where("text is not null").select("text", _json(text=F.col("text")).alias("payload")).distinct()
    return asked.join(_answers(asked, model, "names array<string>"), F.col("payload") == F.col("_payload")).select("text", F.posexplode("value.names").alias("pos", "name"))


def classify_feedback(texts: DataFrame, model: Model) -> DataFrame:
    """(text, action): what an utterance about results asks for, done, narrow or research; empty if the model says none of these."""
    asked = texts.where("text is not null").select("text", _json(text=F.col("text")).alias("payload")).distinct()
    known = F.col("value.action").isin(*ACTIONS)
    return asked.join(_answers(asked, model, "action string"), F.col("payload") == F.col("_payload")).select("text", F.when(known, F.col("value.action")).otherwise("").alias("action"))


def converse(turns: DataFrame, model: Model, most: int = 10) -> DataFrame:
    """(conv_id, reply): the model's reply to the last `most` turns (conv_id, turn, role, text) of each conversation; empty without one."""
    from larkfield.operators.compare import last_turns

    rows = last_turns(turns, most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    asked = rows.select("conv_id", _json(messages=F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))).alias("payload"))
    return asked.join(_answers(asked, model, "reply string"), F.col("payload") == F.col("_payload")).select("conv_id", F.coalesce("value.reply", F.lit("")).alias("reply"))


def describe(tiered: DataFrame, model: Model, most: int = 5) -> str:
    """The model's sentence about the first `most` results and how many there are; empty without one. A few rows come to the driver."""
    n = tiered.agg(F.count("*").alias("n"), F.count_if(F.col("class") == "full").alias("full")).first()
    first = [r["name"] for r in tiered.orderBy(F.desc("score"), "id").limit(most).collect()]
    try:
        return str(json.loads(model(json.dumps({"results": n["n"], "full": n["full"], "first": first}, ensure_ascii=False)))["text"])
    except Exception:
        return ""


def commentary(payload: DataFrame, model: Model) -> str:
    """The model's text on a log's aggregates (one row, payload); empty without one."""
    try:
        return str(json.loads(model(payload.first()["payload"]))["text"])
    except Exception:
        return ""


def column_roles(rows: DataFrame, model: Model, sample: int = 5) -> dict[str, str]:
    """The role of each column, as the model reads it from the header and the first rows; (none) for unknown ones."""
    known = {r for names, _ in ROLES.values() for r in names} | set(LISTS) | {"proximity", "location"}
    try:
        said = json.loads(model(json.dumps({"columns": rows.columns, "rows": [list(map(str, r)) for r in rows.limit(sample).collect()]}, ensure_ascii=False)))
    except Exception:
        said = {}
    said = said if isinstance(said, dict) else {}
    return {c: said[c] if said.get(c) in known else "(none)" for c in rows.columns}


def diagnose(rows: DataFrame, certain: DataFrame, model: Model) -> DataFrame:
    """(query_id, reason, step): why two providers' results differ. rows: query_id, query, mine, theirs (arrays of a diagnosis' lines). A query whose
    first result is corroborated (certain: query_id) needs no model: reason null, step `match`. Else the model gives {reason}; one that isn't known
    counts as null, step `model`; unclear queries have step `unclear`."""
    known = [*DIAGNOSED, *UNCLEAR]
    sure = certain.select("query_id").distinct().withColumn("_sure", F.lit(True))
    both = rows.join(sure, "query_id", "left")
    asked = both.where("_sure is null").select("query_id", _json(query=F.col("query"), mine=F.col("mine"), theirs=F.col("theirs")).alias("payload"))
    said = asked.join(_answers(asked, model, "reason string"), F.col("payload") == F.col("_payload")).select("query_id", F.when(F.col("value.reason").isin(known), F.col("value.reason")).alias("reason"))
    said = said.select("query_id", "reason", F.when(F.col("reason").isin(UNCLEAR), "unclear").otherwise("model").alias("step"))
    return said.unionByName(both.where("_sure").select("query_id", F.lit(None).cast("string").alias("reason"), F.lit("match").alias("step")))


def check_places(rows: DataFrame, model: Model) -> DataFrame:
    """(id, a verdict for each check, coord_match): the model's verdicts on single places (id, name, address, tags, found_address). coord_match is
    decided without it: the address found at the place's coordinates equals its own; unknown without one."""
    from larkfield.functions.text import normalised_address

    asked = rows.select("id", "address", "found_address", _json(name=F.col("name"), address=F.col("address"), tags=F.col("tags")).alias("payload"))
    got = asked.join(_answers(asked, model, ", ".join(f"{c} struct<verdict:string,note:string>" for c in CHECKS)), F.col("payload") == F.col("_payload"), "left")
    verdict = lambda c: F.when(F.col(f"value.{c}.verdict").isin(*VERDICTS), F.col(f"value.{c}.verdict")).otherwise("unknown").alias(c)
    mine, found = normalised_address("address"), normalised_address("found_address")
    match = F.when(F.coalesce("found_address", F.lit("")) == "", "unknown").when((mine != "") & (F.endswith(mine, found) | F.endswith(found, mine)), "ok").otherwise("ng")
    return got.select("id", *map(verdict, CHECKS), match.alias("coord_match"))


def batch_requests(rows: DataFrame, size: int = 30, per_job: int = JOB) -> DataFrame:
    """(job, custom_id, queries): the distinct queries in requests of `size`, in order of hash, and requests in jobs of `per_job`."""
    from larkfield.sources.tables import with_row_index

    distinct = rows.select(F.coalesce("query", F.lit("")).alias("query")).distinct().withColumn("_h", F.xxhash64("query"))
    numbered = with_row_index(distinct.repartitionByRange("_h", "query").sortWithinPartitions("_h", "query"), "_n")
    grouped = numbered.groupBy(F.floor(F.col("_n") / size).alias("_r")).agg(F.array_sort(F.collect_list(F.struct("_n", "query"))).alias("q"))  # `size` queries each
    return grouped.select(F.floor(F.col("_r") / per_job).alias("job"), F.concat(F.lit("batch-"), F.col("_r").cast("string")).alias("custom_id"), F.col("q.query").alias("queries"))


def batch_labels(requests: DataFrame, answers: DataFrame, default: str = "others") -> DataFrame:
    """(query, label) from a job's answers (custom_id, labels); the default for requests that failed or have another number of labels, and unknown labels."""
    known = F.when(F.size("queries") == F.size("labels"), F.col("labels"))
    both = requests.join(answers, "custom_id", "left").select(F.posexplode("queries").alias("k", "query"), known.alias("labels"))
    label = F.get("labels", F.col("k"))
    return both.select("query", F.when(label.isin(CATEGORIES), label).otherwise(default).alias("label"))
