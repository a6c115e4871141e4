"""External models over distinct inputs: any callable from a list of texts to a list of labels, run in batches with a retry ladder."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from larkfield.functions.reference import CATEGORIES
from larkfield.functions.text import PLACE_QUERY, POI_QUERY

Classifier = Callable[[list[str]], list[str]]


def stub(queries: list[str]) -> list[str]:
    """A deterministic stand-in: by the wording of place and facility queries."""
    import re

    return ["broken_query" if not q.strip() else "address" if re.search(PLACE_QUERY, q) else "poi" if re.search(POI_QUERY, q) else "others" for q in queries]


def classify_batch(model: Classifier, queries: list[str], default: str = "others") -> list[str]:
    """Labels of a batch; if it fails or has another length, one by one; what still fails, and unknown labels, are the default."""

    def one(qs: list[str]) -> list[str] | None:
        try:
            got = model(qs)
        except Exception:
            return None
        return list(got) if got is not None and len(got) == len(qs) else None

    labels = one(queries) or [x[0] if (x := one([q])) else default for q in queries]
    return [x if x in CATEGORIES else default for x in labels]


def load(name: str) -> Callable:
    """A model by module:function."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def answered(requests: DataFrame, model: Classifier) -> DataFrame:
    """(custom_id, labels) of batch requests (custom_id, queries); no row for a request that fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, queries in zip(frame["custom_id"], frame["queries"]):
                try:
                    out.append((name, list(model(list(queries)))))
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=["custom_id", "labels"])

    return requests.select("custom_id", "queries").mapInPandas(run, "custom_id string, labels array<string>")


def classify(rows: DataFrame, model: Classifier = stub, batch: int = 30, column: str = "query", workers: int | None = None) -> DataFrame:
    """(query, label) of the distinct queries: each is classified once. workers: batches asked at once, by default as many as there are partitions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["query"].tolist()
            yield pd.DataFrame({"query": texts, "label": [x for k in range(0, len(texts), batch) for x in classify_batch(model, texts[k : k + batch])]})

    distinct = rows.select(F.coalesce(F.col(column), F.lit("")).alias("query")).distinct()
    return (distinct.repartition(workers) if workers else distinct).mapInPandas(run, "query string, label string")


def ask(rows: DataFrame, model: Callable[[str], str], column: str = "payload", attempts: int = 3) -> DataFrame:
    """(payload, answer) of the distinct payloads (JSON): a model that takes and gives JSON is asked until it answers with valid JSON, `attempts`
    times at most; null if it never does, so that callers fall back to keeping everything."""

    def one(payload: str) -> str | None:
        for _ in range(attempts):
            try:
                answer = model(payload)
                json.loads(answer)
                return answer
            except Exception:
                continue
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"payload": frame["payload"], "answer": pd.Series([one(p) for p in frame["payload"]], dtype=object)})

    return rows.select(F.col(column).alias("payload")).where("payload is not null").distinct().mapInPandas(run, "payload string, answer string")


def parsed(answers: DataFrame, schema: str | DataType) -> DataFrame:
    """answers with their JSON as columns of a struct `value`; null where there is no answer or it has another shape."""
    return answers.withColumn("value", F.from_json("answer", schema))
