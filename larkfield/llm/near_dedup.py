"""Near duplicates by BagMinHash: weighted MinHash signatures of five-word shingle multisets, banding, and exact verification.

A shingle of weight w is a Poisson process over [0, w) x time, drawn level by level: [0, 1), [1, 2), [2, 4), [4, 8) and so on, each
level from its own hash, its points placed by further hash bits and thinned to those below w. Two documents see the same points
where their weights overlap, so the first point of each register agrees with the probability of the weighted Jaccard similarity.
All first arrivals of a step are drawn at once, and only those early enough to be some register's first go on.

Equal multisets form a class first, by digest. Representatives that share a band meet in turns: each with its bucket's least member, then
those outside their bucket's largest component with a member of it, and last, in buckets that still hold several components, every pair
across them: by a join in buckets of up to SMALL, else in blocks of bounded size that count common shingles by matrix products. So each candidate
pair is either verified or already joined, yet a bucket of n near copies costs a few n rows. Verified links (multiset overlap >=
threshold) give components.

Cases: null and empty texts and texts without a word link with nothing; one to four words are one shingle; texts are never cut; rows of a
null doc_id link with nothing; rows that repeat a doc_id are documents of their own, whatever their texts; ties go to the smallest doc_id, of
its rows to the first; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import map_texts, mix64, text_of, written
from larkfield.llm.graph import Links, components

WORD = re.compile(r"\w+")
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 6
#: Words a worker remembers before it starts anew; bytes of text it sketches at once. They bound its memory, not its results.
CACHE_WORDS, SKETCH_BYTES = 150_000, 250_000
#: Members of a bucket whose remaining pairs are joined one by one; outsiders and members of a block in larger ones; shingles a matrix product counts at once.
SMALL, BLOCK_FEW, BLOCK_MANY, COLUMNS = 32, 128, 512, 4096
_ODD = np.array([(2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for k in range(64)], dtype=np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Multisets of word shingles as sorted 64-bit hashes with counts."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.words = size, {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known = self.words
        words = WORD.findall(text.lower())
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h, np.zeros(0, np.int64)
        k = min(self.size, len(h))
        with np.errstate(over="ignore"):
            s = np.full(len(h) - k + 1, k, dtype=np.uint64)
            for i in range(k):
                s += h[i : len(h) - k + 1 + i] * _ODD[i]
        s = np.sort(mix64(s))
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        return s[first], np.diff(np.append(first, len(s)))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = 0.0) -> float:
    """Weighted Jaccard similarity of two multisets; 0 where their sizes alone rule out `least`."""
    na, nb = int(a[1].sum()), int(b[1].sum())
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (na + nb - both)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash signatures (uint64, one row per bag, m registers); bags must not be empty."""
    out = np.zeros((len(bags), m), dtype=np.uint64)
    todo, reach = np.arange(len(bags)), np.log(m) + 2.0
    while len(todo):
        n = np.array([len(bags[i][0]) for i in todo])
        item = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo])
        doc = np.repeat(np.arange(len(todo)), n)
        bound = reach / np.array([bags[i][1].sum() for i in todo])
        cells, times, points = [], [], []
        low, size, level = 0, 1, 0
        while True:  # level by level: the interval [low, low + size) of the weight axis
            on = weight > low
            if not on.any():
                break
            with np.errstate(over="ignore"):
                seed = mix64(item[on] + np.uint64(level + 1) * np.uint64(0xD1B54A32D192ED03))
            d, w, t, k = doc[on], weight[on], np.zeros(int(on.sum())), 0
            while len(seed):
                # the next arrivals of each process: one where there are many processes, a run of them where few are left
                more = min(256, max(1, 100_000 // len(seed)))
                with np.errstate(over="ignore"):
                    h = mix64(seed[:, None] + np.arange(k + 1, k + 1 + more, dtype=np.uint64) * _GOLDEN)
                arrive = t[:, None] + np.cumsum(-np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53), 1) / (m * size)
                early = arrive < bound[d][:, None]
                row = np.nonzero(early)[0]
                p = mix64(h[early] ^ np.uint64(0xA0761D6478BD642F))
                hit = low + ((p >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) < w[row]
                cells.append((d[row] * m + (p & np.uint64(0xFFFFFFFF)).astype(np.int64) % m)[hit])
                times.append(arrive[early][hit])
                points.append(p[hit])
                on = early[:, -1]
                seed, d, w, t, k = seed[on], d[on], w[on], arrive[on, -1], k + more
            low, size, level = low + size, low + size, level + 1
        cell, time, point = np.concatenate(cells), np.concatenate(times), np.concatenate(points)
        late = np.argsort(-time, kind="stable")  # written last, the earliest point of a register stays
        sig, full = np.zeros(len(todo) * m, dtype=np.uint64), np.zeros(len(todo) * m, dtype=bool)
        sig[cell[late]] = point[late]
        full[cell] = True
        done = full.reshape(-1, m).all(1)
        out[todo[done]] = sig.reshape(-1, m)[done]
        todo, reach = todo[~done], reach * 2
    return out


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """row, doc_id, mark (a hash of the text), digest of the shingle multiset (null without shingles) and its band hashes, written to the shared folder."""
    source = docs.select((F.col(key) if key else F.monotonically_increasing_id()).alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    source = source.select("row", "doc_id", F.xxhash64("text").alias("mark"), "text")
    shift = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def start():
        shingles = Shingles()

        def work(texts: list[str]) -> list:
            bags = [shingles.of(t) for t in texts]
            some = [i for i, x in enumerate(bags) if len(x[0])]
            digest: list = [None] * len(bags)
            hashes: list = [None] * len(bags)
            sig = signatures([bags[i] for i in some], bands * rows) if some else []
            for i, s in zip(some, sig):
                with np.errstate(over="ignore"):
                    band = mix64((mix64(s).reshape(bands, rows) * _ODD[:rows]).sum(1, dtype=np.uint64) + shift)
                digest[i] = hashlib.blake2b(bags[i][0].tobytes() + bags[i][1].astype("<i8").tobytes(), digest_size=16).digest()
                hashes[i] = band.view(np.int64)
            return [digest, hashes]

        return work

    return written(map_texts(source, {"digest": "binary", "bands": "array<bigint>"}, start, SKETCH_BYTES), "sketches")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of `pairs` (a, b), those whose texts' shingle multisets overlap by `threshold` or more; texts: id, text."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, recent = Shingles(), {}

        def bag(k: int, text: str):
            if k not in recent:
                if len(recent) > 64:
                    recent.clear()
                recent[k] = shingles.of(text)
            return recent[k]

        for frame in frames:
            keep = [overlap(shingles.of(x), bag(b, y), threshold) >= threshold for b, x, y in zip(frame["b"], frame["text_a"], frame["text_b"])]
            yield frame.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, "a bigint, b bigint")


def _parted(shared: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their component by `links`; and the buckets of several components: n members, n_few outside the largest (big), a member of it (pick)."""
    comps = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "rep")
    placed = written(shared.select("bucket", "rep").join(comps, "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp")), "placed")
    parts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("rep", "bucket"), "rep")).alias("pick"))
    parted = parts.groupBy("bucket").agg(F.max(F.struct("n", "comp", "pick")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    return placed, written(parted.select("bucket", "n", (F.col("n") - F.col("most.n")).alias("n_few"), F.col("most.comp").alias("big"), F.col("most.pick.rep").alias("pick")), "parted")


def in_blocks(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join all members of a bucket that are linked across components.

    Outsiders and members of a bucket are dealt to blocks of about BLOCK_FEW x BLOCK_MANY; a block takes the pairs whose first common band is its
    bucket's, counts their common shingles and returns a spanning forest of the links: as many rows as it has members at most.
    """
    ways = mixed.withColumn("few_chunks", F.ceil(F.col("n_few") / BLOCK_FEW).cast("int")).withColumn("many_chunks", F.ceil(F.col("n") / BLOCK_MANY).cast("int"))
    few = ways.where("comp <> big").select("bucket", "rep", "comp", "big", F.lit(True).alias("is_few"), F.pmod(F.xxhash64("rep"), "few_chunks").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("many_chunks") - 1)).alias("y"))
    many = ways.select("bucket", "rep", "comp", "big", F.lit(False).alias("is_few"), F.explode(F.sequence(F.lit(0), F.col("few_chunks") - 1)).alias("x"), F.pmod(F.xxhash64(F.lit(1), "rep"), "many_chunks").cast("int").alias("y"))
    rows = few.unionByName(many).join(texts, F.col("rep") == F.col("id")).drop("id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        a, b = frame[frame["is_few"]].sort_values("rep"), frame[~frame["is_few"]].sort_values("rep")
        if not len(a) or not len(b):
            return nothing
        bucket, big = frame["bucket"].iloc[0], frame["big"].iloc[0]
        bands_a, bands_b = np.stack(a["bands"].tolist()), np.stack(b["bands"].tolist())
        ra, rb, ca, cb = (x.to_numpy() for x in (a["rep"], b["rep"], a["comp"], b["comp"]))
        wanted = (ca[:, None] != cb) & ((cb == big) | (ra[:, None] < rb))
        for k in range(int(np.flatnonzero(bands_a[0] == bucket)[0])):
            wanted &= bands_a[:, k][:, None] != bands_b[:, k]
        if not wanted.any():
            return nothing
        shingles = Shingles()
        units_a, units_b = [_units(shingles.of(t)) for t in a["text"]], [_units(shingles.of(t)) for t in b["text"]]
        known = np.unique(np.concatenate(units_a))
        both = np.zeros(wanted.shape, dtype=np.float32)
        for k in range(0, len(known), COLUMNS):
            part = known[k : k + COLUMNS]
            both += _rows(units_a, part) @ _rows(units_b, part).T
        size_a, size_b = (np.array([len(u) for u in us]) for us in (units_a, units_b))
        i, j = np.nonzero(wanted & (both >= threshold * (size_a[:, None] + size_b - both) - 1e-6))
        if not len(i):
            return nothing
        nodes, at = np.unique(np.concatenate([ra[i], rb[j]]), return_inverse=True)
        forest = Links(len(nodes))
        forest.join(at[: len(i)], at[len(i) :])
        return pd.DataFrame({"a": nodes, "b": nodes[forest.parent]}).query("a != b")

    return rows.groupBy("bucket", "x", "y").applyInPandas(run, "a bigint, b bigint")


def _units(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set: an element of weight w is w units, so that the least of two weights is the number of common units."""
    items, n = bag
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        return np.sort(np.where(nth > 0, mix64(np.repeat(items, n) + nth.astype(np.uint64) * _GOLDEN), np.repeat(items, n)))


def _rows(units: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(units), len(part)), dtype=np.float32)
    for r, u in enumerate(units):
        at = np.searchsorted(part, u)
        at[at == len(part)] = 0
        out[r, at[part[at] == u]] = 1
    return out


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """doc_id, rep_id (least doc_id of its equal multisets), cluster_id (least doc_id reachable by links), kept, and `row` (key, or a number of
    its own), one row per row. One row of each cluster is kept. key: a bigint column that tells rows apart."""
    sketch = sketches(docs, bands, rows, id_col, text_col, key)
    known = sketch.where("digest is not null and doc_id is not null")
    reps = known.groupBy("digest").agg(F.min(F.struct("doc_id", "row", "mark")).alias("least"), F.first("bands").alias("bands"))
    reps = written(reps.select("digest", F.col("least.row").alias("rep"), F.col("least.doc_id").alias("doc_id"), F.col("least.mark").alias("mark"), "bands"), "classes")
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    centers = members.groupBy("bucket").agg(F.min("rep").alias("center"), F.count("*").alias("n")).where("n > 1").select("bucket", "center")
    shared = written(members.join(centers, "bucket"), "buckets")  # members of buckets of two and more
    ids = reps.join(shared.select("rep").distinct(), "rep").select(F.col("rep").alias("id"), "doc_id", "mark")
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    texts = written(source.join(ids, ["doc_id", "mark"]).select("id", "text").dropDuplicates(["id"]), "candidates")  # a text is known by its id and hash
    first = written(shared.where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct(), "pairs")
    links = written(verified(first, texts, threshold), "links")
    placed, parted = _parted(shared, links)
    some = placed.join(parted, "bucket").where("comp <> big").select(F.greatest("rep", "pick").alias("a"), F.least("rep", "pick").alias("b")).distinct()
    second = written(some.join(first, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(written(verified(second, texts, threshold), "links"))
    placed, parted = _parted(shared, links)
    mixed = placed.join(parted, "bucket")
    few = mixed.where("comp <> big").select("bucket", F.col("rep").alias("a"), F.col("comp").alias("comp_a"))
    many = mixed.select(F.col("bucket").alias("bucket_b"), F.col("rep").alias("b"), F.col("comp").alias("comp_b"), "big", "n")
    across = (few.bucket == many.bucket_b) & (F.col("comp_a") != F.col("comp_b")) & ((F.col("comp_b") == F.col("big")) | (F.col("a") < F.col("b")))
    pairs = few.join(many.where(F.col("n") <= SMALL), across).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    third = written(pairs.join(first.unionByName(second), ["a", "b"], "left_anti"), "pairs")
    large = in_blocks(mixed.where(F.col("n") > SMALL), texts.join(reps.select(F.col("rep").alias("id"), "bands"), "id"), threshold)
    links = links.unionByName(verified(third, texts, threshold)).unionByName(large)
    final = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    classes = reps.select("digest", "rep", "doc_id").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("digest").alias("class"), F.col("doc_id").alias("rep_id"), F.struct("doc_id", F.col("rep").alias("row")).alias("first"), F.coalesce("component", "rep").alias("comp"))
    # written: apart from its aggregate the join below can be split where one component holds most classes
    classes = written(classes, "clustered")
    firsts = written(classes.groupBy(F.col("comp").alias("whole")).agg(F.min("first").alias("least")), "firsts")
    classes = classes.join(firsts, F.col("comp") == F.col("whole")).select("class", "rep_id", "least")
    alone = sketch.where("digest is null or doc_id is null").select("doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("cluster_id"), F.lit(True).alias("kept"), "row")
    rest = known.select("doc_id", "row", "digest").join(classes, F.col("digest") == F.col("class")).select("doc_id", "rep_id", F.col("least.doc_id").alias("cluster_id"), (F.col("row") == F.col("least.row")).alias("kept"), "row")
    return rest.unionByName(alone)
