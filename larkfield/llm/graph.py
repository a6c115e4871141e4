"""Connected components: by alternating large-star and small-star steps over DataFrames, and by union-find inside one block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import clear, mark, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Each node points its (larger | not larger) neighbours at its least neighbour.

    The minimum is combined on the map side, and the join back to the edges is a plain equi-join that AQE splits where one hub holds most edges.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "w"))
    joined = both.join(least, both.u == least.w)
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: bigint): component is the least node reachable.

    Self links and nulls are ignored, repeated and reversed links count once, an empty table gives an empty result. Each round is
    written to the shared folder; only its row count and a checksum come to the driver.
    """
    spark, since = edges.sparkSession, mark()
    e = written(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = None
    for _ in range(most_rounds):
        e = written(_star(_star(e, True), False), name)
        clear(spark, since, keep=1)  # the round before
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.count_distinct("u").alias("d")).first()
        if now["n"] == now["d"] and now == seen or now["n"] == 0:  # each node has one parent and nothing moved
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


class Links:
    """Union-find over the rows of one block, and their link counts."""

    def __init__(self, n: int):
        self.parent, self.count = np.arange(n), np.zeros(n, dtype=np.int64)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        p = self.parent
        while True:
            a, b = p[u], p[v]
            differ = a != b
            if not differ.any():
                return
            u, v, a, b = u[differ], v[differ], a[differ], b[differ]
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while True:
                q = p[p]
                if (q == p).all():
                    break
                p[:] = q
