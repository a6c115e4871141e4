"""Writers: CSV files, output names and the trend report."""

from __future__ import annotations

import html
import math
import json
import os
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def output_path(folder: str, source: str, suffix: str, when: str, ext: str = "csv") -> str:
    """<stem>_<suffix>_<time>.<ext>; one run shares its time."""
    return f"{folder.rstrip('/')}/{os.path.splitext(os.path.basename(source.rstrip('/')))[0]}_{suffix}_{when}.{ext}"


def write_csv(df: DataFrame, path: str, quote_all: bool = False, single: bool = False) -> None:
    """CSV with header and doubled quotes. single: one file, for results of bounded size."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", quote_all).option("emptyValue", "").csv(path)


def _lean(value: Column, kind: T.DataType) -> Column:
    """The value without what says nothing: empty texts and lists are null, at every depth of structs."""
    if isinstance(kind, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x: _lean(x, kind.elementType)) if isinstance(kind.elementType, T.StructType) else value
        return F.when(F.size(value) > 0, inner)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_lean(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return value


def minified(df: DataFrame) -> DataFrame:
    """(json): each row as JSON without nulls, empty texts and empty lists."""
    return df.select(F.to_json(F.struct(*(_lean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields)), {"ignoreNullFields": "true"}).alias("json"))


def response(ranked: DataFrame, meta: dict, most: int = 150) -> str:
    """A search's answer as JSON: its results in order of rank, `most` at most as the search itself caps them, and what is known of the run."""
    rows = minified(ranked.orderBy("rank").limit(most)).collect()
    return json.dumps({"results": [json.loads(r["json"]) for r in rows], "meta": {"count": len(rows), **meta}}, ensure_ascii=False)


#: Columns of the search feedback file, in order.
FEEDBACK_COLUMNS = ["ts", "query", "label", "candidate_id", "name", "lat", "lng", "rank", "score", "tier", "relevance", "w_rel", "w_cond", "w_anchor", "decisiveness", "gold_min"]


def write_feedback(feedback: DataFrame, path: str) -> None:
    """Search feedback as CSV, every value quoted; columns it lacks are empty. The header's byte order mark tells spreadsheets the encoding."""
    have = set(feedback.columns)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("") for c in FEEDBACK_COLUMNS]
    line = F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in cells))
    head = feedback.sparkSession.createDataFrame([("\ufeff" + ",".join(FEEDBACK_COLUMNS),)], "value string").select("value", F.lit(0).alias("part"), F.lit("").alias("at"))
    body = feedback.select(line.alias("value"), F.lit(1).alias("part"), F.col("ts").cast("string").alias("at"))
    head.unionAll(body).coalesce(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)  # a log of one person's judgements


#: Colours of a report's charts, in order.
COLOURS = ("#3366aa", "#cc6633", "#449966", "#997733", "#775599", "#aa4455", "#558899", "#888888")


def line_chart(values: list[float], width: int = 600, height: int = 120) -> str:
    """The values in order as a line."""
    top, n = max([1, *values]), max(1, len(values) - 1)
    points = " ".join(f"{width * k / n:.1f},{height - height * v / top:.1f}" for k, v in enumerate(values))
    return f'<svg width="{width}" height="{height}"><polyline fill="none" stroke="{COLOURS[0]}" stroke-width="2" points="{points}"/></svg>'


def bar_chart(labels: list[str], values: list[float], width: int = 600, high: int = 16) -> str:
    """A labelled bar for each value."""
    top = max([1, *values])
    rows = "".join(f'<rect x="160" y="{k * high}" width="{(width - 160) * v / top:.1f}" height="{high - 4}" fill="{COLOURS[0]}"/><text x="0" y="{k * high + high - 6}" font-size="11">{html.escape(str(t))}</text>' for k, (t, v) in enumerate(zip(labels, values)))
    return f'<svg width="{width}" height="{max(1, len(values)) * high}">{rows}</svg>'


def pie_chart(labels: list[str], values: list[float], size: int = 160) -> str:
    """Shares of the whole as slices, with a legend; nothing to share gives no slice."""
    whole, turn, parts, half = sum(values), 0.0, [], size / 2
    for k, v in enumerate(values):
        share = v / whole if whole else 0.0
        if share >= 1:
            parts.append(f'<circle cx="{half}" cy="{half}" r="{half}" fill="{COLOURS[k % len(COLOURS)]}"/>')
        elif share > 0:
            ends = [(half + half * math.sin(2 * math.pi * t), half - half * math.cos(2 * math.pi * t)) for t in (turn, turn + share)]
            parts.append(f'<path d="M{half},{half} L{ends[0][0]:.2f},{ends[0][1]:.2f} A{half},{half} 0 {int(share > 0.5)} 1 {ends[1][0]:.2f},{ends[1][1]:.2f} Z" fill="{COLOURS[k % len(COLOURS)]}"/>')
        turn += share
    legend = "".join(f'<li style="color:{COLOURS[k % len(COLOURS)]}">{html.escape(str(t))}: {v:g}</li>' for k, (t, v) in enumerate(zip(labels, values)))
    return f'<svg width="{size}" height="{size}">{"".join(parts)}</svg><ul>{legend}</ul>'


def report(title: str, sections: list[tuple[str, DataFrame]], commentary: str = "", most: int = 500, charts: dict[str, str] = {}) -> str:
    """An HTML page with a chart and a table for each small aggregate, `most` rows each at most. charts: line, bar or pie by section, over its `count`
    by its first column; without one its rows have bars."""
    parts = [f"<h1>{html.escape(title)}</h1>"]
    if commentary:
        parts.append(f"<p>{html.escape(commentary)}</p>")
    for name, df in sections:
        rows = df.limit(most).collect()
        counted = "count" in df.columns
        top = max([1, *(r["count"] for r in rows if counted)])
        kind = charts.get(name) if counted else None
        labels, values = [r[0] for r in rows], [float(r["count"] or 0) for r in rows] if counted else []
        chart = line_chart(values) if kind == "line" else bar_chart(labels, values) if kind == "bar" else pie_chart(labels, values) if kind == "pie" else ""
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + (f'<td><svg width="100" height="8"><rect width="{100 * r["count"] / top:.1f}" height="8"/></svg></td>' if counted and not kind else "") + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2>{chart}<table><tr>{head}</tr>{body}</table>")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>{"".join(parts)}</body></html>'
