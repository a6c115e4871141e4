"""The ten operators' queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from larkfield.llm import bpe, embed_dedup, exact_dedup, html_extract, licenses, near_dedup, packing, resharding, token_counts, toxicity

WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark, sf_dir):
    return bpe.encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), emit="digest")


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row")


def op4_embedding_dedup(spark, sf_dir):
    return embed_dedup.embed_dedup(table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark, sf_dir):
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_bagminhash(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).drop("row")


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_resharding(spark, sf_dir):
    return resharding.reshard(table(spark, sf_dir, "documents")).drop("row")


def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_exact_dedup, op4_embedding_dedup, op5_html_extraction, op6_bagminhash, op7_packing, op8_licenses, op9_resharding, op10_token_counts)}
ORACLE_SQL = {"op3_exact_dedup": exact_dedup.ORACLE, "op4_embedding_dedup": embed_dedup.ORACLE}
