"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors form a class first. Unit vectors are rotated into the order of their second moment's eigenvectors, so leading dimensions hold
the most. Cuts from a bounded sample (SAMPLE rows; they only balance the work) part space into blocks, in any dimension, so dense places get
more of them; a block's centre and its exact radius over all dimensions say which other blocks it can have links with. Runs of blocks are
groups, and each pair of groups that can have links is one cell's work: g groups make g * (g + 1) / 2 cells, so a vector travels about as often as
the root of twice the cells, as it came in. Groups are as few as memory and the cluster's cores let them be.

In a cell, tiles that lie too far apart are left out, others compared by the leading dimensions plus the product of the suffix norms, an upper bound
of the cosine; pairs it leaves accumulate the rest, with the bound checked again on the way. A cell returns each vector's number of links and
its least linked fellow there, never the links: output is linear in its rows.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do those of a null vec_id; vectors of
different lengths don't link; rows that repeat a vec_id are vectors of their own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import written
from larkfield.llm.graph import Links, components

THRESHOLD = 0.95
#: Rows sampled for the cuts; vectors a block holds about, and blocks at most; rows of a tile.
SAMPLE, BLOCK_ROWS, MOST_BLOCKS, TILE = 20_000, 1024, 2048, 512
#: Bytes of a group's vectors in double precision at most; vectors of a group below which more cells don't pay.
GROUP_BYTES, LEAST_ROWS = 1 << 25, 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; scaled first so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def eigenbasis(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the unit vectors' second moment, largest first. Moments are summed by entry: dim * dim numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(0), dim))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim, dtype=np.int32)), pa.array(total.ravel())], names=["k", "v"])

    moment = np.zeros(dim * dim)
    for r in vectors.select("embedding").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        moment[r["k"]] = r["v"]
    values, axes = np.linalg.eigh(moment.reshape(dim, dim))
    return np.ascontiguousarray(axes[:, np.argsort(-values)])


def widest_gap(values: np.ndarray) -> float:
    """The middle of the widest gap in the middle two fifths of sorted values: parts of like size that cut through few clusters."""
    n = len(values)
    middle = values[int(0.3 * n) : max(int(0.3 * n) + 2, int(np.ceil(0.7 * n)))]
    at = int(np.diff(middle).argmax()) if len(middle) > 1 else 0
    return float(middle[at : at + 2].mean())


def cuts(sample: np.ndarray, blocks: int) -> tuple[list[tuple[int, float]], np.ndarray]:
    """A complete binary tree, level by level, (dimension, cut) of each inner node; and the leaves' centres. `blocks` is a power of two."""
    tree: list[tuple[int, float]] = []
    level = [np.arange(len(sample))]
    while len(level) < blocks:
        nxt = []
        for own in level:
            part = sample[own]
            dim = int(part.var(0).argmax()) if len(own) else 0
            cut = widest_gap(np.sort(part[:, dim])) if len(own) else 0.0
            tree.append((dim, cut))
            low = part[:, dim] < cut if len(own) else np.zeros(0, bool)
            nxt += [own[low], own[~low]]
        level = nxt
    return tree, np.array([sample[own].mean(0) if len(own) else np.zeros(sample.shape[1]) for own in level])


def block_of(x: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    if not tree:
        return node
    dims, places = np.array([d for d, _ in tree]), np.array([c for _, c in tree])
    for _ in range((len(tree) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] >= places[node])
    return node - len(tree)


def can_link(centre_a, radius_a, centre_b, radius_b, threshold: float) -> np.ndarray:
    """Whether balls of unit vectors lie so near that two of them can have cosine >= threshold: a matrix."""
    gap = np.sqrt(np.maximum(0, (centre_a * centre_a).sum(1)[:, None] + (centre_b * centre_b).sum(1) - 2 * centre_a @ centre_b.T))
    return gap <= radius_a[:, None] + radius_b + (2 - 2 * threshold) ** 0.5 + 1e-6


def compare(x: np.ndarray, side: np.ndarray, weight: np.ndarray, threshold: float, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weight of linked rows, least row linked) for rows x of one group (side all equal) or of two, across them only. Rows are unit vectors, rotated."""
    n, dim = x.shape
    lead = max(1, min(dim, max(8, dim // 4)))
    mid = max(lead, min(dim, dim // 2))
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x[:, :lead], x[:, :lead])) + 1e-12)
    rest_mid = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x[:, :mid], x[:, :mid])) + 1e-12)
    upper = np.hstack([x[:, :lead], rest[:, None]]).astype(np.float32)
    order = np.lexsort((x[:, 0], block if block is not None else side))
    groups = [order[side[order] == s] for s in np.unique(side)]
    tiles = [[g[k : k + TILE] for k in range(0, len(g), TILE)] for g in groups]
    centres = [np.array([x[t].mean(0) for t in ts]) for ts in tiles]
    radii = [np.array([np.sqrt(((x[t] - c) ** 2).sum(1).max()) for t, c in zip(ts, cs)]) for ts, cs in zip(tiles, centres)]
    links = Links(n)
    alone = len(groups) == 1
    others = 0 if alone else 1
    near = can_link(centres[0], radii[0], centres[others], radii[others], threshold)
    for i, j in zip(*np.nonzero(np.triu(near) if alone else near)):
        a, b = tiles[0][i], tiles[others][j]
        maybe = upper[a] @ upper[b].T >= threshold - 1e-5
        if alone and i == j:
            maybe = np.triu(maybe, 1)
        if not maybe.any():
            continue
        r, c = np.nonzero(maybe)
        if len(r) > maybe.size // 16:  # dense: counts by matrix products, and only rows of different components are joined
            hit = maybe & (x[a] @ x[b].T >= threshold)
            links.count[a] += (hit @ weight[b].astype(np.float64)).astype(np.int64)
            links.count[b] += (weight[a].astype(np.float64) @ hit).astype(np.int64)
            r, c = np.nonzero(hit & (links.parent[a][:, None] != links.parent[b]))
            links.join(a[r], b[c])
            continue
        u, v = a[r], b[c]
        dot = np.einsum("ij,ij->i", x[u, :mid], x[v, :mid])
        on = dot + rest_mid[u] * rest_mid[v] >= threshold - 1e-9
        u, v, dot = u[on], v[on], dot[on]
        hit = dot + np.einsum("ij,ij->i", x[u, mid:], x[v, mid:]) >= threshold
        u, v = u[hit], v[hit]
        np.add.at(links.count, u, weight[v])
        np.add.at(links.count, v, weight[u])
        links.join(u, v)
    return links.count, links.parent


def embed_dedup(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per row of embeddings."""
    spark = embeddings.sparkSession
    kind = "float" if embeddings.schema[vec_col].dataType.elementType.simpleString() == "float" else "double"
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(vec_col).cast(f"array<{kind}>").alias("embedding"))
    inf = F.lit(float("inf"))
    fine = F.coalesce(
        (F.size("embedding") > 0) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < inf)) & F.exists("embedding", lambda e: e != 0) & F.col("vec_id").isNotNull(), F.lit(False)
    )
    keyed = rows.select("vec_id", "row", "embedding", fine.alias("fine"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    good = keyed.where("fine")
    classes = good.groupBy("k1", "k2").agg(F.first("embedding").alias("embedding"), F.min(F.struct("vec_id", "row")).alias("least"), F.count("*").alias("copies"))
    classes = written(classes.select("k1", "k2", "embedding", F.col("least.row").alias("rep"), F.col("least.vec_id").alias("vec_id"), "copies"), "vectors")
    lengths = sorted((r["d"], r["n"]) for r in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect())  # a row a length
    found = spark.createDataFrame([], "rep bigint, n bigint, root bigint")
    for dim, n in lengths:
        found = found.unionByName(_within(classes.where(F.size("embedding") == dim), dim, n, threshold, kind))
    found = written(found, "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    result = classes.select("k1", "k2", "rep", "vec_id", "copies").join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = result.groupBy(F.col("component").alias("c")).agg(F.min("vec_id").alias("component_id"))
    result = result.join(least, F.col("component") == F.col("c")).select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", "k1", "k2").join(result, ["k1", "k2"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(keyed.where("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))


def grouped(sizes: list[int], groups: int, most: int) -> list[tuple[int, int]]:
    """(first group, number of groups) of each block: `groups` runs of about equal rows; a block beyond `most` rows has groups of its own, dealt by hash."""
    out, number, run, share = [], -1, most + 1, max(1, min(most, -(-sum(sizes) // groups)))
    for n in sizes:
        if n > most:
            out.append((number + 1, -(-n // most)))
            number, run = number + out[-1][1], most + 1
            continue
        if run + n > share and run + n - share > share - run:  # nearer its share without this block
            number, run = number + 1, 0
        out.append((number, 1))
        run += n
    return out


def _within(classes: DataFrame, dim: int, n: int, threshold: float, kind: str) -> DataFrame:
    """rep, n (weight of its links in a cell), root (least rep it is linked to there), for vectors of one length."""
    basis = eigenbasis(classes, dim)
    most = max(LEAST_ROWS, GROUP_BYTES // (8 * dim))
    groups = max(1, -(-n // most), min(round(2.5 * classes.sparkSession.sparkContext.defaultParallelism**0.5), n // LEAST_ROWS))
    blocks = 1 << max(0, min(MOST_BLOCKS, -(-n // BLOCK_ROWS) if groups > 1 else 1) - 1).bit_length()
    top = int(min(1.0, SAMPLE / n) * 2**64) - 2**63 - 1  # k1 is a hash: below a cut of its range lie about SAMPLE of the n rows
    sample = classes.where(F.col("k1") <= F.lit(top)).select("embedding").collect() if blocks > 1 else []
    tree, centres = cuts(unit(np.array([r["embedding"] for r in sample])) @ basis, blocks) if sample else ([], np.zeros((1, dim)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, size = np.zeros(blocks), np.zeros(blocks, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(0), dim)) @ basis
                b = block_of(x, tree)
                np.maximum.at(far, b, np.sqrt(((x - centres[b]) ** 2).sum(1)))
                size += np.bincount(b, minlength=blocks)
        own = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(far[own]), pa.array(size[own])], names=["block", "far", "size"])

    if not tree:  # one block
        own, radius, size = [0], np.zeros(1), [n]
    else:
        stats = sorted((r["block"], r["far"], r["size"]) for r in classes.select("embedding").mapInArrow(measure, "block int, far double, size bigint").groupBy("block").agg(F.max("far").alias("far"), F.sum("size").alias("size")).collect())  # a row a block
        own, radius, size = [b for b, _, _ in stats], np.array([f for _, f, _ in stats]), [k for _, _, k in stats]
    dealt = grouped(size, groups, most)
    last = max(first + k for first, k in dealt)
    near = can_link(centres[own], radius, centres[own], radius, threshold) if tree else np.ones((1, 1), bool)
    first, parts = np.zeros(blocks, dtype=np.int64), np.ones(blocks, dtype=np.int64)
    meets: dict[int, np.ndarray] = {}  # groups that a block can have links with
    for i, b in enumerate(own):
        first[b], parts[b] = dealt[i]
        meets[b] = np.unique(np.concatenate([np.arange(f, f + k) for j, (f, k) in enumerate(dealt) if near[i, j]]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, copies, vectors = batch.columns
            raw = matrix(vectors, dim)
            b = block_of(unit(raw) @ basis, tree)
            group = first[b] + rep.to_numpy() % parts[b]
            times = np.array([len(meets[k]) for k in b.tolist()])
            row = np.repeat(np.arange(len(b)), times)
            other = np.concatenate([meets[k] for k in b.tolist()])
            cell = np.minimum(group[row], other) * last + np.maximum(group[row], other)
            data = raw.astype("<f4" if kind == "float" else "<f8")
            x = pa.array([v.tobytes() for v in data], pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(group[row]), pa.array(b[row].astype(np.int32)), rep.take(pa.array(row)), copies.take(pa.array(row)), x], names=["cell", "group", "block", "rep", "copies", "x"])

    rows = classes.select("rep", "copies", "embedding").mapInArrow(deal, "cell bigint, group bigint, block int, rep bigint, copies bigint, x binary")

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        order = np.argsort(column("rep"), kind="stable")
        cell, group, rep = int(column("cell")[0]), column("group")[order], column("rep")[order]
        if cell // last != cell % last and len(np.unique(group)) < 2:
            hit = np.zeros(len(rep), bool)
            count = root = np.zeros(len(rep), np.int64)
        else:
            raw = np.frombuffer(b"".join(c for part in table.column("x").chunks for c in part.to_pylist()), "<f4" if kind == "float" else "<f8").reshape(-1, dim)
            count, root = compare(unit(raw[order]) @ basis, group, column("copies")[order], threshold, column("block")[order])
            hit = count > 0
        return pa.table({"rep": pa.array(rep[hit], pa.int64()), "n": pa.array(count[hit], pa.int64()), "root": pa.array(rep[root[hit]], pa.int64())})

    return rows.groupBy("cell").applyInArrow(run, "rep bigint, n bigint, root bigint")


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
