"""Resharding by minimum-cost flow.

Each old shard's bytes and each new shard's capacity are nodes; a byte that stays in its shard costs nothing, one that moves costs one.
The flow of least cost says how many bytes go from each old shard to each new one. Rows take their places along each old shard's byte
line: block totals give the blocks' offsets (first pass), a running sum inside a block the rows' (second pass), and the flow's cuts the
new shard. Only shards that gain or lose rows are rewritten.

Rows larger than a FINE-th of a shard, of which there are FINE a shard at most, are placed one by one: they stay where they are while they fit,
the others go, largest first, where most room is left by the rows that stay; the flow fills up the rest. So, law `bytes`, a shard's size differs
from its capacity by two FINE-ths about, unless single rows are larger than a shard.

Old shards from the number of new ones on have no place to stay: they cost the same and are one source, their lines laid end to end. The driver
sees a number for each old shard and for each block of some BLOCK_ROWS rows in it.

Cases: a null text has size 1; rows of an equal text, a third of the table perhaps, are placed each on its own, as are rows that repeat a doc_id; a
null old shard counts as one that has no place to stay; ids of any type, null too, are passed on unread; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkfield.llm.common import text_of, written

#: Rows that one block of the running sums holds about.
BLOCK_ROWS = 50_000
#: Parts of a shard that a row may be large for the byte line; FINE * shards larger rows can exist at most.
FINE = 1000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[dict[int, int]]:
    """Least-cost transfers that empty `supply` into `capacity` (successive shortest paths with potentials). cost(i, j) >= 0 a unit.

    Returns for each source {target: amount}. Raises if the capacities don't hold the supply.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the supply")
    n, m = len(supply), len(capacity)
    flow: list[dict[int, int]] = [{} for _ in supply]
    into: list[dict[int, int]] = [{} for _ in capacity]
    left, free = list(supply), list(capacity)
    price_s, price_t = [0] * n, [0] * m
    while any(left):
        dist_s = [0 if left[i] else None for i in range(n)]
        dist_t: list[int | None] = [None] * m
        from_t: list[int] = [-1] * m
        from_s: list[int] = [-1] * n
        queue = [(0, 0, i) for i in range(n) if left[i]]
        heapq.heapify(queue)
        while queue:
            d, side, k = heapq.heappop(queue)
            if d > (dist_t if side else dist_s)[k]:
                continue
            if not side:
                for j in range(m):
                    x = d + cost(k, j) + price_s[k] - price_t[j]
                    if dist_t[j] is None or x < dist_t[j]:
                        dist_t[j], from_t[j] = x, k
                        heapq.heappush(queue, (x, 1, j))
            else:
                for i in into[k]:
                    x = d - cost(i, k) + price_t[k] - price_s[i]
                    if dist_s[i] is None or x < dist_s[i]:
                        dist_s[i], from_s[i] = x, k
                        heapq.heappush(queue, (x, 0, i))
        far = max(x for x in dist_t if x is not None)
        end = min((j for j in range(m) if free[j]), key=lambda j: (dist_t[j] + price_t[j], j))
        path, j = [], end
        while True:
            i = from_t[j]
            path.append((i, j, 1))
            if from_s[i] < 0:
                break
            path.append((i, from_s[i], -1))
            j = from_s[i]
        amount = min(left[i], free[end], *(flow[a][b] for a, b, sign in path if sign < 0))
        for a, b, sign in path:
            now = flow[a].get(b, 0) + sign * amount
            flow[a][b] = into[b][a] = now
            if not now:
                del flow[a][b], into[b][a]
        left[i] -= amount
        free[end] -= amount
        price_s = [p + (far if x is None else x) for p, x in zip(price_s, dist_s)]
        price_t = [p + (far if x is None else x) for p, x in zip(price_t, dist_t)]
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def place_large(rows: list[tuple[int, int]], capacity: list[int], small: list[int]) -> tuple[list[int], list[int]]:
    """New shards of (old shard, size) rows, largest first, and the bytes they take in each. small: bytes of each old shard's other rows."""
    taken, shard, moving = [0] * len(capacity), [-1] * len(rows), []
    for k, (old, size) in enumerate(rows):
        if old < len(capacity) and taken[old] + size <= capacity[old]:
            shard[k] = old
            taken[old] += size
        else:
            moving.append(k)
    room = [(t + min(c - t, small[j] if j < len(small) else 0) - c, j) for j, (t, c) in enumerate(zip(taken, capacity))]
    heapq.heapify(room)
    for k in moving:
        over, j = room[0]
        heapq.heapreplace(room, (over + rows[k][1], j))
        shard[k] = j
        taken[j] += rows[k][1]
    return shard, taken


def room_left(capacity: list[int], taken: list[int], small: int) -> list[int]:
    """Bytes of `small` that each shard gets, so that all end as near to their capacity as the taken bytes let them."""
    low, high = -max([0, *capacity]), small + max([0, *taken])
    fill = lambda level: [max(0, c + level - t) for c, t in zip(capacity, taken)]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if sum(fill(mid)) >= small else (mid + 1, high)
    out, over = fill(low), sum(fill(low)) - small
    for j, n in enumerate(out):  # the level is whole bytes
        cut = min(over, 1, n)
        out[j], over = n - cut, over - cut
    return out


def by_file(df: DataFrame) -> DataFrame:
    """df with `old_shard`: the rank of the file a row was read from, by path."""
    files = sorted(r[0] for r in df.select(F.input_file_name().alias("f")).distinct().collect())  # a row a file
    table = df.sparkSession.createDataFrame([(f, k) for k, f in enumerate(files)], "old_file string, old_shard int")
    return df.withColumn("old_file", F.input_file_name()).join(F.broadcast(table), "old_file").drop("old_file")  # a row a file


def reshard(docs: DataFrame, shards: int = 16, old: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacities: list[int] | None = None, key: str | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (gapless from 0), grown_shard, old_shard, moved, row (key, or a number of its own).

    old: the column with a row's old shard, an int from 0; None: the file it lies in. capacities: bytes of each new shard, in sum
    the table's size; None: an even share each. key: a column that tells rows apart.
    """
    spark = docs.sparkSession
    own = [F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), (F.col(key) if key else F.monotonically_increasing_id()).alias("row")]
    base = docs.select(*own, F.col(old).cast("int").alias("old_shard")) if old else by_file(docs.select(*own))
    sized = written(base.select("doc_id", "row", "old_shard", (F.octet_length("text") + 1).cast("bigint").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")), "reshard")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    room = capacities or even_capacities(total, shards)
    most, limit = len(room), max(1, total // (len(room) * FINE))
    sized = sized.withColumn("old", F.coalesce("old_shard", F.lit(2**31 - 1)))
    by_old = sized.groupBy("old").agg(F.count_if(F.col("size") <= limit).alias("rows"), F.sum(F.when(F.col("size") <= limit, F.col("size")).otherwise(0)).alias("bytes")).collect()  # a row an old shard
    small = [0] * most
    for r in by_old:
        if r["old"] < most:
            small[r["old"]] = r["bytes"]
    big = sorted((-r["size"], r["text_crc32"], str(r["row"]), r["row"], r["old"]) for r in sized.where(F.col("size") > limit).collect())  # FINE a shard at most
    shard_of, taken = place_large([(r[-1], -r[0]) for r in big], room, small)
    chosen = spark.createDataFrame([(r[-2], s) for r, s in zip(big, shard_of)], f"row {sized.schema['row'].dataType.simpleString()}, shard int")
    columns = ["doc_id", "row", "size", "text_crc32", "old_shard", "old", "block", "at", "shard"]
    large = sized.where(F.col("size") > limit).join(F.broadcast(chosen), "row").withColumns({"block": F.lit(-1), "at": F.lit(0).cast("bigint")}).select(*columns)  # FINE a shard at most
    blocks = spark.createDataFrame([(r["old"], max(1, -(-r["rows"] // BLOCK_ROWS))) for r in by_old], "old int, blocks int")
    rest = sized.where(F.col("size") <= limit).join(blocks, "old").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int")).drop("blocks")
    totals = sorted((r["old"], r["block"], r["n"]) for r in rest.groupBy("old", "block").agg(F.sum("size").alias("n")).collect())  # a number a block
    supply, bases = [0] * (most + 1), []  # the last: old shards that have no place to stay
    for o, b, n in totals:
        line = min(o, most)
        bases.append((o, b, supply[line]))
        supply[line] += n
    flow = min_cost_flow(supply, room_left(room, taken, sum(supply)), lambda i, j: int(i != j))
    lines = []  # pieces of a byte line: what stays comes first
    for o, to in enumerate(flow):
        at, cuts = 0, []
        for j in sorted(to, key=lambda j: (j != o, j)):
            cuts.append((at, at + to[j], j))
            at += to[j]
        lines.append((o, cuts))
    lines = spark.createDataFrame(lines, "line int, cuts array<struct<a:bigint,b:bigint,shard:int>>")
    starts = spark.createDataFrame(bases, "old int, block int, base bigint")
    inside = Window.partitionBy("old", "block").orderBy("text_crc32", "row")
    # starts isn't broadcast by force: it has a row a block, and beyond Spark's limit the join shares the window's shuffle; lines: a row a new shard
    rows = rest.join(starts, ["old", "block"]).withColumn("line", F.least("old", F.lit(most))).join(F.broadcast(lines), "line")
    at = F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    rows = rows.withColumn("at", at).withColumn("shard", F.element_at(F.filter("cuts", lambda c: (c["a"] <= F.col("at")) & (F.col("at") < c["b"])), 1)["shard"])
    nth = F.row_number().over(Window.partitionBy("old", "block", "shard").orderBy("at", "text_crc32", "row"))
    rows = written(rows.select(*columns).unionByName(large).withColumn("nth", nth), "reshard")
    counts = sorted((r["shard"], r["old"], r["block"], r["n"]) for r in rows.groupBy("shard", "old", "block").agg(F.count("*").alias("n")).collect())  # a block lies in a few shards
    slots, filled = [], {}
    for s, o, b, n in counts:
        slots.append((s, o, b, filled.get(s, 0)))
        filled[s] = filled.get(s, 0) + n
    first = spark.createDataFrame(slots, "shard int, old int, block int, first bigint")
    return rows.join(first, ["shard", "old", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", (~F.col("old_shard").eqNullSafe(F.col("shard"))).alias("moved"), "row"
    )


def rewrite(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> list[int]:
    """Write the new shards that gained or lost rows under `path` (shard=k/), and return their numbers; the others' files may stay.

    placed: of reshard with the same key, which tells rows of docs apart. The list has a number a shard at most.
    """
    moved = placed.where("moved")
    touched = moved.select(F.col("shard").alias("s")).union(moved.select(F.col("old_shard").alias("s"))).where("s is not null").distinct()
    affected = sorted(r["s"] for r in touched.collect())
    places = placed.where(F.col("shard").isin(affected)).select(F.col("row").alias("_row"), F.col("shard").alias("shard"), F.col("slot").alias("_slot"))
    rows = docs.drop("shard").join(places, F.col(key) == F.col("_row")).drop("_row")
    rows.repartitionByRange(F.col("shard"), F.col("_slot")).sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").mode("overwrite").parquet(path)
    return affected
