"""The search request as a plan: short keys, defaults and validation, on the driver."""

from __future__ import annotations

import copy

import regex

from larkfield.functions.reference import NATURAL
from larkfield.functions.text import inferred_reach

#: Short keys of requests.
SHORT_KEYS = {
    "prox": "proximity", "anc": "anchors", "ty": "type", "tx": "text", "spc": "specificity", "sub": "subtype", "sc": "scope", "brg": "bearing_filter", "wi": "within", "pf": "profile", "pfi": "profile_inferred",
    "mnMi": "minMinutes", "mxMi": "maxMinutes", "mxMe": "maxMeters", "lv": "level", "tgt": "target", "qi": "query_intent", "tt": "text_type", "q": "queries", "fl": "floors", "v": "value", "mn": "min", "mx": "max",
    "ng": "negate", "cat": "category_tag", "cond": "conditions", "dir": "direction", "d": "distance", "m": "method", "mi": "minutes", "me": "meters",
}
LINES, LOOSE = ("road", "rail"), ("nearby", "somewhat_nearby", "far")


def expand(node):
    """Short keys as long ones, at every depth."""
    if isinstance(node, dict):
        return {SHORT_KEYS.get(k, k): expand(v) for k, v in node.items()}
    return [expand(x) for x in node] if isinstance(node, list) else node


def _queries(part: dict) -> list[str]:
    given, text = part.get("queries") or [], part.get("text")
    return given if not text or text in given else [text, *given]


def with_defaults(request: dict, level: str = "very_close", most: int = 3, natural: bool | None = None) -> dict:
    """A full copy of the request: every optional part present, conditions beyond `most` (0 to 5) set aside by name, loose levels along lines
    tightened, less so for natural targets (None: as the target's wording tells)."""
    out = copy.deepcopy(request)
    if natural is None:
        natural = bool(regex.search(NATURAL, (out.get("target") or {}).get("text") or ""))
    if near := out.get("proximity"):
        near.update({k: near.get(k) for k in ("bearing_filter", "scope", "within")})
        for anchor in near.get("anchors") or []:
            anchor["specificity"], anchor["subtype"] = anchor.get("specificity") or "specific", anchor.get("subtype") or {}
        if isinstance(near["within"], dict):
            near["within"]["profile_inferred"] = near["within"].get("profile_inferred") is True
    if target := out.get("target"):
        target["query_intent"], target["queries"] = target.get("query_intent") or "specific", _queries(target)
        if isinstance(target.get("floors"), dict):
            target["floors"]["negate"] = target["floors"].get("negate") is True
    conditions = out.get("conditions") or []
    room = max(0, min(5, most))
    out["dropped_conditions"] = [t for c in conditions[room:] if (t := c.get("text") or c.get("type"))]
    out["conditions"] = conditions[:room]
    for c in out["conditions"]:
        usual = ("very_close" if natural else "roadside") if c.get("type") in LINES else level
        d = {"method": "radius", "level": usual, "profile": None, "minutes": None, "meters": None} | {k: v for k, v in (c.get("distance") or {}).items() if v is not None}
        d["profile_inferred"] = d.get("profile_inferred") is True
        if c.get("type") in LINES and d["meters"] is None and d["minutes"] is None and d["level"] in LOOSE:
            d["level"] = usual
        c |= {"distance": d, "queries": _queries(c), "direction": c.get("direction"), "negate": c.get("negate") is True}
    out["result_area"] = out.get("result_area") or False
    out["unsupported_features"] = [x for x in out.get("unsupported_features") or [] if x]
    return out


def with_inferred_reach(request: dict, text: str) -> dict:
    """The request with the reach its text states, unless it has one or a condition of something else has that distance."""
    out, found = copy.deepcopy(request), inferred_reach(text)
    near = out.get("proximity")
    if not near or not found or any((near.get("within") or {}).values()):
        return out
    own = {a.get("text") for a in near.get("anchors") or []} | {(out.get("target") or {}).get("text")}
    key, value = ("minutes", found["maxMinutes"]) if "maxMinutes" in found else ("meters", found["maxMeters"])
    if not any((c.get("distance") or {}).get(key) == value and c.get("text") not in own for c in out.get("conditions") or []):
        near["within"] = found
    return out


def problems(request: dict) -> list[str]:
    """What makes a request unusable; empty if nothing does."""
    found = []
    if not (request.get("target") or {}).get("text") and not (request.get("target") or {}).get("queries"):
        found.append("the target has no text")
    if not (request.get("proximity") or {}).get("anchors") and not (request.get("proximity") or {}).get("scope"):
        found.append("there is no anchor and no scope")
    found += [f"condition {k} has no type" for k, c in enumerate(request.get("conditions") or []) if not c.get("type")]
    return found
