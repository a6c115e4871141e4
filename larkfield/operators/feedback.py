"""The feedback log's entries: labels, drafts, accepted proposals, history, and the row filter over current states.

Log entries: seq, type (state or ticket; null in entries of the first format), key, roundId, id, state, reason, problemType, dataIssue,
dataSubtype, action, searchEngineIssues, note, query, fileName, rowIndex, timestamp, and result, googleOk of the first format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.functions.reference import DATA_ACTIONS, DATA_ISSUES, DIAGNOSED, MISSING_KINDS, UNCLEAR, USUAL_ACTION
from larkfield.functions.text import leading_number
from larkfield.operators.compare import latest_round

ENTRY = ["key", "roundId", "type", "state", "reason", "problemType", "dataIssue", "dataSubtype", "action", "searchEngineIssues", "note"]


def _of(table: dict, value: Column) -> Column:
    """The table's value, null if it has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() if kv[1] is not None for x in kv)), value)


def ticket_label(problem: Column, issue: Column, subtype: Column, action: Column, engine: Column) -> Column:
    """`poi coverage(Bus stop) → Add` for data problems, the issues joined by commas for others."""
    kind = F.when(subtype != "general", F.concat(F.lit("("), _of(MISSING_KINDS, subtype), F.lit(")")))
    data = F.concat(F.coalesce(_of(DATA_ISSUES, issue), issue, F.lit("")), F.coalesce(kind, F.lit("")), F.lit(" → "), F.coalesce(_of(DATA_ACTIONS, action), action, F.lit("")))
    return F.when(problem == "data", data).otherwise(F.coalesce(F.array_join(engine, ", "), F.lit("")))


def badge(state: Column, tickets: Column) -> Column:
    return F.when(state == "no_issue", "✅").when(state == "out_of_scope", "➖").when(state == "problem", F.concat(F.lit("🐞×"), tickets.cast("string"))).otherwise("")


def ticket_of_reason(reason: Column) -> Column:
    """struct of a ticket for a diagnosis' reason; no reason: nothing was found on either side, recorded as a missing place."""
    issue, kind = _of({k: v for k, (v, _) in DIAGNOSED.items()}, reason), _of({k: v for k, (_, v) in DIAGNOSED.items()}, reason)
    bare, known = F.coalesce(reason, F.lit("")) == "", issue.isNotNull()
    data = bare | known
    return F.struct(
        F.when(data, "data").otherwise("search_engine").alias("problemType"),
        F.when(bare, "poi_missing").otherwise(issue).alias("dataIssue"),
        F.when(bare, "general").otherwise(kind).alias("dataSubtype"),
        F.when(bare, "add").otherwise(_of(USUAL_ACTION, issue)).alias("action"),
        F.when(~data, F.array(reason)).alias("searchEngineIssues"),
        F.when(bare, "AI diagnosis: no match on either side").when(known, "AI diagnosis").otherwise("AI diagnosis (unexpected tag)").alias("note"),
    )


def tickets_of_drafts(drafts: DataFrame) -> DataFrame:
    """Drafts that are complete, as tickets: data problems need issue and action, others an issue at least; only a missing place has a subtype."""
    data = F.col("problemType") == "data"
    whole = (data & F.col("dataIssue").isNotNull() & F.col("action").isNotNull()) | ((F.col("problemType") == "search_engine") & (F.size("searchEngineIssues") > 0))
    kept = drafts.where(whole)
    return kept.withColumns({
        "dataSubtype": F.when(data & (F.col("dataIssue") == "poi_missing"), F.coalesce("dataSubtype", F.lit("general"))),
        "dataIssue": F.when(data, F.col("dataIssue")), "action": F.when(data, F.col("action")),
        "searchEngineIssues": F.when(~data, F.col("searchEngineIssues")), "note": F.nullif(F.trim("note"), F.lit("")), "type": F.lit("ticket"),
    })


def accepted(proposals: DataFrame) -> DataFrame:
    """Log entries of accepted proposals (key, roundId, scope, outOfScopeReason, tickets): out of scope and no issue give a state, else each ticket."""
    out, bare = F.coalesce(F.col("scope") == "out_of_scope", F.lit(False)), F.coalesce(F.size("tickets"), F.lit(0)) <= 0
    t = lambda name, kind="string": F.when(~out, F.col(f"t.{name}")).cast(kind).alias(name)
    each = proposals.withColumn("t", F.explode_outer(F.when(~out, F.col("tickets")))).withColumn("_state", F.when(out, "out_of_scope").when(bare, "no_issue"))
    return each.select(
        "key", "roundId", F.when(F.col("_state").isNull(), "ticket").otherwise("state").alias("type"), F.col("_state").alias("state"), F.when(out, F.coalesce("outOfScopeReason", F.lit(UNCLEAR[0]))).alias("reason"),
        t("problemType"), t("dataIssue"), t("dataSubtype"), t("action"), t("searchEngineIssues", "array<string>"), t("note"),
    )


def round_tickets(log: DataFrame, key: str, round_id: str) -> DataFrame:
    return log.where((F.col("type") == "ticket") & (F.col("key") == key) & (F.col("roundId") == round_id))


def history(log: DataFrame) -> DataFrame:
    """The log as its table and file show it, seq kept for the order (the table is newest first): timestamp, fileName, rowIndex from 1, query, result, reason, note, googleOk."""
    ticket, state = F.coalesce(F.col("type") == "ticket", F.lit(False)), F.coalesce(F.col("type") == "state", F.lit(False))
    old = F.when(F.col("result") == "good", "👍").when(F.col("result") == "unclear", "Unclear").when(F.col("result") == "bad", "👎").otherwise(F.coalesce("result", F.lit("")))
    now = F.when(F.col("state") == "no_issue", "✅ No Issue").when(F.col("state") == "out_of_scope", "➖ Out of scope").otherwise(F.col("state"))
    label = ticket_label(*(F.col(c) for c in ("problemType", "dataIssue", "dataSubtype", "action", "searchEngineIssues")))
    text = lambda c: F.coalesce(c, F.lit(""))
    return log.select(
        "seq", "timestamp", text(F.col("fileName")).alias("fileName"), text((F.col("rowIndex") + 1).cast("string")).alias("rowIndex"), "query",
        F.when(ticket, F.concat(F.lit("🐞 Ticket ("), F.when(F.col("problemType") == "data", "Data").otherwise("Search Engine"), F.lit(")"))).when(state, now).otherwise(old).alias("result"),
        F.when(ticket, label).otherwise(text(F.col("reason"))).alias("reason"), F.when(ticket, text(F.col("note"))).otherwise("").alias("note"),
        F.when(ticket | state, "-").otherwise(F.coalesce(F.nullif("googleOk", F.lit("")), F.lit("-"))).alias("googleOk"),
    )


def current(log: DataFrame) -> DataFrame:
    """(key, state, reason, issues) of each key's latest round: its first state entry, else `problem` with the issues of its tickets."""
    now = latest_round(log)
    state, ticket = F.col("type") == "state", F.col("type") == "ticket"
    first = F.min_by(F.when(state, F.struct("state", "reason")), F.when(state, F.col("seq")))
    issues = F.array_compact(F.concat(F.array("dataIssue"), F.coalesce("searchEngineIssues", F.array().cast("array<string>"))))
    g = now.groupBy("key").agg(first.alias("s"), F.flatten(F.collect_set(F.when(ticket, issues))).alias("i"), F.count_if(ticket).alias("tickets"))
    return g.where((F.col("tickets") > 0) | F.col("s").isNotNull()).select(
        "key", F.when(F.col("s").isNotNull(), F.col("s.state")).otherwise("problem").alias("state"), F.col("s.reason").alias("reason"), F.when(F.col("s").isNull(), F.array_sort(F.array_distinct("i"))).alias("issues"), F.when(F.col("s").isNull(), F.col("tickets")).otherwise(0).alias("tickets")
    )


def select_rows(rows: DataFrame, states: DataFrame, result: str | None = None, reason: str | None = None, types: list[str] | None = None, least_count: float | None = None, text: str | None = None, order: str = "row_idx", descending: bool = False) -> DataFrame:
    """rows (row_idx, key, query_type, query_count and any others) that pass all filters given, in order of row_idx or query_count.

    result: a state or `untested`; reason: one of a problem's issues or the reason of being out of scope; a count that is no number is 0;
    text is looked for in all columns, without case.
    """
    number = F.coalesce(leading_number(F.col("query_count").cast("string")), F.lit(0.0))
    own = rows.columns
    if types is not None:
        rows = rows.where(F.coalesce("query_type", F.lit("")).isin(types))
    if least_count is not None:
        rows = rows.where(number >= least_count)
    if text and text.strip():
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in own))), F.lit(text.strip().lower())))
    if result or reason:
        rows = rows.join(states.select(F.col("key").alias("_key"), F.col("state").alias("_state"), F.col("reason").alias("_reason"), F.col("issues").alias("_issues")), F.col("key") == F.col("_key"), "left")
        if result:
            rows = rows.where(F.col("_key").isNull() if result == "untested" else F.col("_state") == result)
        if reason:
            rows = rows.where(((F.col("_state") == "problem") & F.array_contains("_issues", reason)) | ((F.col("_state") == "out_of_scope") & (F.col("_reason") == reason)))
    by = number if order == "query_count" else F.col("row_idx")
    return rows.orderBy(by.desc() if descending else by.asc(), "row_idx").select(*own)
