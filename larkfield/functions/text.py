"""Name, address and intent text functions. Chains that need Unicode normalisation run as Arrow batches; the rest are column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkfield.functions.reference import BUILDING_WORDS, BUS_STOP_WORDS, CATEGORIES, LODGING_WORDS, NATURAL, SHELTER_WORDS

# Characters, suffixes and patterns that results depend on.
ZERO_WIDTH = "​‌‍﻿"
NUMERAL = {"〇": 0, "○": 0, "零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100}
CORPORATE = ["地方独立行政法人", "独立行政法人", "医療法人社団", "医療法人", "社会福祉法人", "学校法人", "宗教法人", "特定非営利活動法人", "一般社団法人", "一般財団法人", "公益社団法人", "公益財団法人", "株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "(株)", "（株）", "(有)", "（有）"]
VARIANTS = str.maketrans("髙﨑邊邉齋齊澤龍國學", "高崎辺辺斎斉沢竜国学")
PREFECTURE = r"(?:北海道|東京都|京都府|大阪府|[一-鿿々]{2,3}県)"
DASHES = "‐‑‒–—―−ー-"
PLACE_QUERY = r"[都道府県][市区町村]|[市区]$|[町村]$|丁目|番地|番町"
POI_QUERY = r"駅$|空港$|港$|病院$|クリニック$|学校$|大学$|図書館$|神社$|寺$|寺院$|ホテル$|旅館$|銀行$|警察署$|消防署$|郵便局$"
FLOORS_MIN, FLOORS_MAX, FLOORS_VALUE = (r"(\d{1,3})\s*階\s*(?:建て|建|だて|立て)?\s*(?:以上|超|より上|より高)", r"(\d{1,3})\s*階\s*(?:建て|建|だて|立て)?\s*(?:以下|未満|まで|より低)", r"(\d{1,3})\s*階\s*(?:建て|建|だて|立て|の)")
TOWER, TALL, LOW = r"(タワマン|タマワン|タワーマンション|タワマンション|超高層|高層(マンション|ビル|階|階建)?)", r"(背の高い|(高い|でかい)(建物|ビル|マンション))", r"(低層|背の低い|平屋)"
WALK, RIDE, DRIVE, MINUTES, KM, METRES = r"(?:徒歩|歩いて)\s*(\d{1,3})\s*分", r"(?:自転車|チャリ)(?:で)?\s*(\d{1,3})\s*分", r"(?:車|クルマ)(?:で)?\s*(\d{1,3})\s*分", r"(\d{1,3})\s*分以内", r"(\d+(?:\.\d+)?)\s*(?:km|ｋｍ|キロ(?:メートル)?)\s*以内", r"(\d+(?:\.\d+)?)\s*(?:m|ｍ|メートル)\s*以内"

_CORPORATE = re.compile("|".join(map(re.escape, CORPORATE)))
_KA = regex.compile(r"(?<=\p{Han})[ヶケガ](?=\p{Han})")
_COUNTY = re.compile(rf"^({PREFECTURE})[^\d\s,、\-]{{1,6}}郡(?=[^\d\s,、\-市]{{1,6}}[町村])")
_FLOOR = re.compile(r"\d+\s*(?:階|f)|b\d+|地下\d*階?", re.I)


def numeral(text: str) -> str:
    """A Chinese numeral as digits: by place if it has units, else digit by digit; unchanged if it is neither."""
    if not any(c in UNITS for c in text):
        return "".join(str(NUMERAL.get(c, c)) for c in text)
    total = digit = 0
    for c in text:
        if c in UNITS:
            total, digit = total + (digit or 1) * UNITS[c], 0
        elif c in NUMERAL:
            digit = NUMERAL[c]
        else:
            return text
    return str(total + digit)


def plain_name(name: str | None) -> str:
    """For comparing providers: NFKC, one form of each character, no corporate form, punctuation, symbol or space, lower case."""
    text = _KA.sub("が", unicodedata.normalize("NFKC", name or "").translate(VARIANTS))
    return "".join(c for c in _CORPORATE.sub("", text) if unicodedata.category(c)[0] not in "PS" and not c.isspace()).lower()


def search_name(name: str | None) -> str:
    """For finding places: NFKC, katakana, digits before address units, no space, middle dot, dash or bracket, lower case."""
    text = unicodedata.normalize("NFKC", (name or "").translate(dict.fromkeys(map(ord, ZERO_WIDTH))))
    text = "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in text)
    text = re.sub(r"[〇零一二三四五六七八九十百]+(?=丁目|丁|番地|番|号|条)", lambda m: numeral(m[0]), text)
    return re.sub(r"[\s・‐-―−()\[\]「」【】\-]", "", text).lower()


def plain_address(address: str | None) -> str:
    """For comparing providers: from the prefecture on, without county, division words and post code, one kind of dash between numbers, and
    without a building's name unless a floor is named."""
    text = _KA.sub("が", unicodedata.normalize("NFKC", address or "").translate(VARIANTS))
    if m := re.search(PREFECTURE, text):
        text = text[m.start() :]
    text = _COUNTY.sub(r"\1", text)
    text = re.sub(r"[〇○零一二三四五六七八九十]+(?=丁目|番地|番|号)", lambda m: numeral(m[0]) if m[0].count("十") < 2 else m[0], text)
    for pattern, to in ((r"大字|小字", ""), ("字", ""), (r"〒?\d{3}-?\d{4}", ""), (r"日本[、,]?", ""), (r"(?i),?\s*Japan", ""), (f"[{DASHES}]", "-"), (r"(\d)の(?=\d)", r"\1-"), (r"丁目|番地|番", "-"), ("号", "")):
        text = re.sub(pattern, to, text)
    m = re.match(r"(.*?\d[\d-]*)(.{1,50})?$", text)
    if m and m[2] and not _FLOOR.search(m[2]):
        text = m[1]
    return re.sub("-+", "-", re.sub(r"[\s,、]+", "", text)).lower()


def bare_name(name: str | None) -> str:
    """NFKC without white space, lower case."""
    return "".join(unicodedata.normalize("NFKC", name or "").split()).lower()


def _series(f):
    def run(values: pd.Series) -> pd.Series:
        return values.map(f)

    return F.pandas_udf(run, StringType())


normalised_name, normalised_search_name, normalised_address, compact_name = _series(plain_name), _series(search_name), _series(plain_address), _series(bare_name)


def clean_name(name: Column) -> Column:
    return F.translate(name, ZERO_WIDTH, "")


def query_type(query: Column) -> Column:
    return F.when(query.rlike(PLACE_QUERY), "place").when(query.rlike(POI_QUERY), "poi").otherwise("both")


def prefecture(address: Column) -> Column:
    return F.nullif(F.regexp_extract(address, PREFECTURE, 0), F.lit(""))


def inferred_floors(text: Column) -> Column:
    """struct(value, min, max) that the wording asks for; null if it asks for none."""
    number = lambda p: F.regexp_extract(text, p, 1).try_cast("int")
    out = lambda **k: F.struct(*(k.get(n, F.lit(None)).cast("int").alias(n) for n in ("value", "min", "max")))
    return (
        F.when(text.rlike(FLOORS_MIN), out(min=number(FLOORS_MIN)))
        .when(text.rlike(FLOORS_MAX), out(max=number(FLOORS_MAX)))
        .when(text.rlike(FLOORS_VALUE), out(value=number(FLOORS_VALUE)))
        .when(text.rlike(TOWER), out(min=F.lit(20)))
        .when(text.rlike(TALL), out(min=F.lit(10)))
        .when(text.rlike(LOW), out(max=F.lit(3)))
    )


def inferred_reach(text: str) -> dict | None:
    """The reach around the anchor that a request's wording states."""
    for pattern, profile, guessed in ((WALK, "walking", False), (RIDE, "cycling", False), (DRIVE, "driving", False), (MINUTES, "walking", True)):
        if m := re.search(pattern, text or ""):
            return {"profile": profile, "maxMinutes": int(m[1]), "profile_inferred": guessed}
    for pattern, scale in ((KM, 1000), (METRES, 1)):
        if m := re.search(pattern, text or ""):
            return {"maxMeters": int(float(m[1]) * scale + 0.5)}
    return None


def short_hash(text: Column) -> Column:
    """32-bit hash of the text's characters (of the basic plane) in base 36: h = h * 33 xor c, from 5381."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.expr("cast(0 as bigint)") + F.ascii(c))
    h = F.aggregate(codes, F.lit(5381).cast("bigint"), lambda a, c: ((a * 33).bitwiseAND(0xFFFFFFFF)).bitwiseXOR(c))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def leading_number(text: Column) -> Column:
    """The number a text begins with; null if it begins with none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1), F.lit("")).cast("double")


def choice_number(text: Column) -> Column:
    """A chosen number, in half- or full-width digits or as an ordinal word."""
    half = F.translate(text, "０１２３４５６７８９", "0123456789")
    words = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5}
    out = F.nullif(F.regexp_extract(half, r"(\d{1,2})", 1), F.lit("")).cast("int")
    return F.coalesce(out, *(F.when(text.rlike(f"^{k}|{k}(番|つ)"), v) for k, v in words.items()))


def _any_word(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(low, w))


def asks_bus_stop(query: Column) -> Column:
    return _any_word(query, BUS_STOP_WORDS)


def asks_shelter(query: Column) -> Column:
    return _any_word(query, SHELTER_WORDS)


def asks_building(query: Column) -> Column:
    """Whether a query names a kind of building; with case."""
    return F.exists(F.array(*map(F.lit, BUILDING_WORDS)), lambda w: F.contains(query, w))


def natural_target(text: Column) -> Column:
    return text.rlike(NATURAL)


def asked_class(query: Column) -> Column:
    """The class of places that a normalised query's category word stands for; null if none."""
    return F.when(_any_word(query, [search_name(w) for w in LODGING_WORDS]), "lodging")


def is_address_type(kind: Column) -> Column:
    return F.coalesce(F.lower(F.trim(kind)) == "address", F.lit(False))


def unfenced(answer: Column) -> Column:
    """A model's answer without code fences and the language they state."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    bare = F.btrim(strip(answer), F.lit("`"))
    return strip(F.when(F.startswith(strip(answer), F.lit("```")), F.regexp_replace(bare, "^json", "")).otherwise(answer))


def labels_of_numbers(numbers: Column) -> Column:
    """Categories for a model's numbers, counted from 1; others for any that stands for none."""
    return F.transform(numbers, lambda n: F.coalesce(F.get(F.array(*map(F.lit, CATEGORIES)), n - 1), F.lit("others")))


def near_label(km: Column, most_km: float = 5.0) -> Column:
    """Whether a result lies near the centre, with one decimal: `1.2km (within 5km)`; null if the distance is unknown."""
    return F.concat(F.call_function("format_number", km, F.lit("0.0")), F.when(km > most_km, f"km (over {most_km:g}km)").otherwise(f"km (within {most_km:g}km)"))
