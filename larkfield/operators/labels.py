"""Wordings of results: floors, reasons, summaries. Conditions are known when a query is planned, so reasons are one expression a condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.operators.search import floor_pass

CLOSE = ("adjacent", "very_close")
LEVEL_WORDS = {"adjacent": "目の前", "very_close": "すぐ隣"}


def floor_label(spec: dict | None, reason: bool = False) -> str:
    """`5階以上`; as a reason `5階建て以上`."""
    unit = "階建て" if reason else "階"
    for key, word in (("value", ""), ("min", "以上"), ("max", "以下")):
        if spec and spec.get(key) is not None:
            return f"{spec[key]}{unit}{word}"
    return "階数"


def landmark_phrase(name: Column, level: str = "very_close") -> Column:
    return F.concat(F.lit("すぐ近くに" if level in CLOSE else "近くに"), name, F.lit("がある"))


def reasons(request: dict, floors: Column, hits: Column) -> Column:
    """array of why a candidate is one: its floors, and each condition in hits (labels); a condition of the same building holds for all that are left."""
    parts = []
    if spec := (request.get("target") or {}).get("floors"):
        ok = floors.isNotNull() & floor_pass(floors, spec.get("value"), spec.get("min"), spec.get("max"), bool(spec.get("negate")))
        parts.append(F.when(ok, F.concat(F.lit(f"✔️ {floor_label(spec, True)}{'ではない' if spec.get('negate') else ''}（"), floors.cast("string"), F.lit("階相当）"))))
    for c in request.get("conditions") or []:
        label, level = c.get("text") or c.get("type"), (c.get("distance") or {}).get("level")
        near = "同じビルに" if level == "same_building" else "すぐ近くに" if level in CLOSE else "近くに"
        end = ("（がない）" if c.get("type") == "poi" else "（ではない）") if c.get("negate") else ""
        parts.append(F.when(F.lit(level == "same_building") | F.coalesce(F.array_contains(hits, label), F.lit(False)), f"✔️ {near}{label}{end}"))
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def results_summary(rows: DataFrame, request: dict, label: str, most: int = 5) -> str:
    """Facts for a wording: certainty, number of candidates, and the best full matches (rows: id, class, score, name, floors, hits)."""
    n = rows.where(F.col("class").isin("full", "partial")).count()
    best = rows.where("class = 'full'").orderBy(F.desc("score"), "id").limit(most).select("name", "score", F.array_join(reasons(request, F.col("floors"), F.col("hits")), "、").alias("why")).collect()
    return "\n".join([f"確度: {label}", f"候補総数: {n}件", *(f"{k}. {r['name'] or '(名称不明)'}（スコア{r['score'] or 0:g}）{r['why']}" for k, r in enumerate(best, 1))])


def criteria(request: dict) -> str:
    """One line on what is looked for, one on the conditions."""
    around = "・".join(a["text"] for a in (request.get("proximity") or {}).get("anchors") or [] if a.get("text"))
    named = [c.get("text") or c.get("type") for c in request.get("conditions") or []]
    head = f"🔎 {around + '周辺で' if around else ''}「{(request.get('target') or {}).get('text') or ''}」を検索"
    return head + (f"\n条件: {' / '.join(filter(None, named))}" if any(named) else "")


def _span(within: dict) -> str | None:
    if within.get("level"):
        return LEVEL_WORDS.get(within["level"], within["level"])
    first = lambda *keys: next((within[k] for k in keys if within.get(k) is not None), None)
    low, high, metres, by = first("minMinutes"), first("maxMinutes", "minutes"), first("maxMeters", "meters"), within.get("profile") or "walking"
    if low is not None:
        return f"{by} {low}〜{high}分" if high is not None else f"{by} {low}分以上"
    return f"{by} {high}分以内" if high is not None else f"{metres}m以内" if metres is not None else None


def facts(request: dict) -> str:
    """All that a request settles, a line each."""
    near, target = request.get("proximity") or {}, request.get("target") or {}
    lines = [
        ("基準地点", "・".join(a.get("text") or "" for a in near.get("anchors") or [])), ("範囲", _span(near["within"]) if near.get("within") else None), ("方角", near.get("bearing_filter")),
        ("エリア", (near.get("scope") or {}).get("text")), ("探すもの", target.get("text")), ("階数", floor_label(target["floors"], True) if target.get("floors") else None),
    ]
    for k, c in enumerate(request.get("conditions") or [], 1):
        d = c.get("distance") or {}
        far = LEVEL_WORDS.get(d["level"], d["level"]) if d.get("level") else f"{d['minutes']}分以内" if d.get("minutes") else ""
        lines.append((f"条件{k}", f"{c.get('text') or c.get('type')}{f'（{far}）' if far else ''}"))
    return "\n".join(f"{k}: {v}" for k, v in lines if v)
