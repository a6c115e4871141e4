"""Readers: query-log CSV files, and the roles that the star-schema tables take in queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_query_log(spark: SparkSession, path: str, required: tuple[str, ...] = ("query",), trim: bool = False) -> DataFrame:
    """A CSV with header, doubled quotes and quoted line breaks; all strings, missing cells empty. Raises if a required column lacks.

    trim: trims headers and cells and drops rows that are blank throughout.
    """
    df = spark.read.csv(path, header=True, escape='"', multiLine=True, encoding="UTF-8")
    if trim:
        df = df.select(*(F.regexp_replace(F.regexp_replace(F.col(f"`{c}`"), r"^[\s　]+|[\s　]+$", ""), "\r", "").alias(c.strip()) for c in df.columns))
    df = df.na.fill("")
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.where(F.concat(*df.columns) != "") if trim else df


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """df with a dense row number in reading order: a count per partition first, then offsets. No shuffle of the rows."""
    tagged = df.withColumn("_id", F.monotonically_increasing_id())
    counts = sorted((r["p"], r["n"]) for r in tagged.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in counts)])
    offsets = df.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(counts, starts)], "_p bigint, _start bigint")  # a row a partition
    return tagged.join(F.broadcast(offsets), F.shiftright("_id", 33) == F.col("_p")).withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_p", "_start")


#: SQL that both engines read alike: the query log's columns from events.
LOG_SQL = """
SELECT event_id AS row_idx, props AS query, event_type AS ai_classification,
       CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 89 = 0 THEN substr(CAST(ts AS VARCHAR(40)), 1, 10) ELSE concat(substr(CAST(ts AS VARCHAR(40)), 1, 19), ' UTC') END AS datetime,
       CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN '139.7' WHEN event_id % 17 = 0 THEN 'a,b'
            ELSE concat(CAST(128 + user_id * 7919 % 17 AS VARCHAR(9)), '.', CAST(10 + user_id % 90 AS VARCHAR(9)), ',', CAST(31 + user_id * 104729 % 13 AS VARCHAR(9)), '.', CAST(10 + event_id % 90 AS VARCHAR(9))) END AS proximity,
       CASE WHEN event_id % 3 = 0 THEN '139,35,140,36' WHEN event_id % 3 = 1 THEN '  ' ELSE '' END AS bbox,
       CASE WHEN event_id % 5 = 0 THEN 'cafe' ELSE '' END AS poi_category, '' AS poi_category_exclusions,
       CASE WHEN event_id % 7 = 0 THEN 'tokyo' ELSE '' END AS near, CASE WHEN event_id % 2 = 0 THEN 'walking' ELSE '' END AS navigation_profile
FROM events"""

#: Places and items from customers and suppliers: integer arithmetic, so both engines get the same doubles.
PLACES_SQL = "SELECT c_custkey AS id, c_name AS name, 139 + (c_custkey * 7919 % 1000) / CAST(10000 AS DOUBLE) AS lng, 35 + (c_custkey * 104729 % 1000) / CAST(10000 AS DOUBLE) AS lat, c_nationkey AS grp FROM customer"
ITEMS_SQL = "SELECT s_suppkey AS id, s_name AS name, 139 + (s_suppkey * 6007 % 1000) / CAST(10000 AS DOUBLE) AS lng, 35 + (s_suppkey * 3571 % 1000) / CAST(10000 AS DOUBLE) AS lat, s_nationkey AS grp, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 60 AS DOUBLE) END AS height FROM supplier"


def from_sql(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """One of the SELECTs above over its table."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=table(spark, sf_dir, name))


def query_log(spark, sf_dir):
    return from_sql(spark, sf_dir, LOG_SQL, "events")


def places(spark, sf_dir):
    return from_sql(spark, sf_dir, PLACES_SQL, "customer")


def items(spark, sf_dir):
    return from_sql(spark, sf_dir, ITEMS_SQL, "supplier")
