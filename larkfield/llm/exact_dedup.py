"""Exact deduplication by content sort, with DataFrame functions only.

Sampled splitters range-partition rows by their normalised text (its leading characters, then its hash), each partition is sorted externally by
the whole text, equal texts lie adjacent, and neighbouring rows are compared in full: a run is a stretch of equal texts, ordered by preference,
and its first row is the one that stays. Rows keep their place in the run, so nothing is looked up by a hash afterwards.

A text of more than max(HOT_ROWS, rows / HOT_PARTS) rows is hot; there are HOT_PARTS of them at most, whatever the table. Its rows are dealt to so
many parts that none holds more than that, and the parts' runs, one row each, are compared by their whole texts once more.

Cases: null counts as empty; texts are compared without the characters of [\\x20\\x09-\\x0D]; of equal texts the row with the most
code points stays, then the smallest doc_id, a null doc_id last; of rows that repeat a doc_id and text exactly one stays; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkfield.llm.common import text_of, written

#: Rows of one text that a part may hold, and the number of hot texts at most.
HOT_ROWS, HOT_PARTS = 64, 4000
#: Leading characters that range splitters hold.
LEAD = 48


def normalised(text):
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), r"[\t-\r]+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), and `row` (key, or a number of its own), one row per row of docs.

    key: a bigint column that tells rows apart.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.col(key) if key else F.monotonically_increasing_id()).alias("row"), text_of(text_col).alias("text"))
    norm = rows.select("doc_id", "row", normalised(F.col("text")).alias("norm"), F.length("text").alias("chars")).withColumn("hash", F.xxhash64("norm"))
    most = max(HOT_ROWS, docs.count() // HOT_PARTS)
    counts = docs.select(F.xxhash64(normalised(text_of(text_col))).alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = [(r["hash"], -(-r["n"] // most)) for r in counts.collect()]  # HOT_PARTS rows at most
    parts = spark.createDataFrame(hot, "hash bigint, parts bigint")
    dealt = norm.join(F.broadcast(parts), "hash", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), "parts"), F.lit(-1)))
    # splitters are leading characters, a hash and a part, so that the sample of them that the driver sees stays small; texts are sorted and compared whole
    lead = dealt.withColumn("lead", F.substring("norm", 1, LEAD))
    run = Window.partitionBy("lead", "hash", "part", "norm")  # within its range partition: sorted, no other shuffle
    order = [F.desc("chars"), F.col("doc_id").isNull(), "doc_id", "row"]
    ranked = lead.repartitionByRange("lead", "hash", "part").select(
        "doc_id", "row", "part", "norm", F.first(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).over(run.orderBy(*order)).alias("best"), F.count("*").over(run).alias("n")
    )
    head = (F.col("part") >= 0) & (F.col("row") == F.col("best.row"))
    runs = written(ranked.select("doc_id", "row", "part", "best", "n", F.sha2("norm", 256).alias("text_sha256"), F.when(head, F.col("norm")).alias("norm")), "runs")
    if not hot:
        return _result(runs)
    heads = runs.where("norm is not null").select(F.col("best.row").alias("run"), "norm", "best", "n")  # a row a part of a hot text
    whole = heads.groupBy(F.col("norm").alias("same")).agg(F.min("best").alias("all_best"), F.sum("n").alias("all_n"))
    merged = written(heads.join(whole, F.col("norm") == F.col("same")).select("run", "all_best", "all_n"), "hot")
    joined = runs.join(F.broadcast(merged), F.col("best.row") == F.col("run"), "left")  # 2 * HOT_PARTS rows at most
    return _result(joined.withColumns({"best": F.coalesce("all_best", "best"), "n": F.coalesce("all_n", "n")}))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "row")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256
  FROM d
)
"""
