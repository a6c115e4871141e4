"""A corpus pipeline: toxic documents go, then exact and near copies, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All but the last
return the columns of documents. Each case that an operator's docstring defines holds for its stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.llm import exact_dedup, near_dedup, packing, toxicity
from larkfield.llm.common import clear, mark, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold. Labels teach the model, from the rows that aren't held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_of(docs, model) < toxicity.TARGET)


def _kept(docs: DataFrame, dedup: Callable[..., DataFrame]) -> DataFrame:
    """The rows that dedup keeps, each on its own: rows are told apart by their place in docs, a stored table, so that no other row of an id goes with one."""
    place = f"row_{uuid.uuid4().hex}"  # no column of docs has this name
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    gone = dedup(placed, key=place).where("not kept").select(F.col("row").alias(place))
    return placed.join(gone, place, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, exact_dedup.exact_dedup)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, near_dedup.near_dedup)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("packing", pack)]
#: The stages hold a trained model and a tokenizer, which SQL can't express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again; only the last one's tables stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, since, keep=1)  # the stage's own tables, and the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
