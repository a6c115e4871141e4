"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of hashed rows for the word, its prefixes and its ending, so inflected forms share their stem's rows.
Filters of several widths slide over the words, max pooling keeps each filter's strongest response, and a logistic layer gives the logit.
Thresholds are calibrated for each language, as guessed from the text's own function words, on rows kept out of the fit; a text's score
is the logistic of its logit shifted so that its language's threshold is TARGET.

Fitting reads a bounded sample of labelled rows (sample_toxic and sample_clean, by hash of the id); scoring reads every whole text. What
the fit does follows the sample alone, never the table: with fewer than LEAST_HELD toxic rows kept out the thresholds come from the fit's own rows,
a language with fewer than LEAST_LANGUAGE rows of either class uses the common threshold, and small samples get more passes (LEAST_PASSES).

Cases: null and empty texts get the score of a text without words; texts are never cut; null labels are no labels; of several labels of one
id the sample takes the toxic one, of several texts the greatest; without labels of both classes every score is the base rate (0 without any);
repeated rows get equal scores; ids and all other columns are passed on unread, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import map_texts, steps, text_of

WORD = re.compile(r"\w+")
WIDTHS = (1, 2, 3)
#: predicted is 1 from this score on.
TARGET = 0.7
#: Words whose embeddings a worker remembers before it starts anew, 64 bytes each beside the word; characters of text it scores at once. They bound its memory, not its results.
CACHE_WORDS, SCORE_CHARS = 200_000, 125_000
#: Toxic rows that calibrate apart from the fit at least; rows of each class that a language's own threshold takes; row passes of a fit at least, and passes at most.
LEAST_HELD, LEAST_LANGUAGE, LEAST_PASSES, MOST_PASSES = 8, 15, 40_000, 60
#: Checksums that those of a whole word, a prefix and an ending go on from.
WHOLE, FRONT, BACK = (zlib.crc32(c) for c in (b"=", b"^", b"$"))
#: Function words that tell the languages apart.
LANGUAGES = {
    "en": frozenset("the of and to in is that it for was on are as with be by at this have from".split()),
    "fr": frozenset("le la les de des du et un une est que qui dans pour par sur pas au avec plus".split()),
    "de": frozenset("der die das und den von zu mit sich ist im dem nicht ein eine als auch auf für".split()),
    "es": frozenset("el los las y que del en una por con para su al lo como más pero no se".split()),
}


def language(words: list[str]) -> str:
    """The language whose function words are most frequent; 'other' if there are none."""
    hits = {k: 0 for k in LANGUAGES}
    for k, table in LANGUAGES.items():
        hits[k] = sum(map(table.__contains__, words))
    best = max(hits, key=hits.get)
    return best if hits[best] else "other"


@dataclass
class Model:
    buckets: int = 1 << 15
    dim: int = 16
    filters: int = 12
    seed: int = 7
    embed: np.ndarray = None
    conv: dict[int, np.ndarray] = field(default_factory=dict)
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray = None
    out_bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    base: float | None = None

    # features -----------------------------------------------------------------
    FEATURES = 7

    def features(self, word: str) -> list[int]:
        """Buckets of the word, its prefixes of 3 to 6 characters and its last 3 and 4."""
        n, b, crc = len(word), self.buckets, zlib.crc32
        if word.isascii():  # bytes are characters: no text is joined and encoded for each part
            w = word.encode()
            return [crc(w, WHOLE) % b, *(crc(w[:k], FRONT) % b if n >= k else b for k in (3, 4, 5, 6)), *(crc(w[-k:], BACK) % b if n > k else b for k in (3, 4))]
        parts = ["=" + word, *("^" + word[:k] if n >= k else "" for k in (3, 4, 5, 6)), *("$" + word[-k:] if n > k else "" for k in (3, 4))]
        return [crc(p.encode("utf-8", "surrogatepass")) % b if p else b for p in parts]

    def start(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.embed = np.vstack([rng.normal(0, 0.08, (self.buckets, self.dim)), np.zeros((1, self.dim))]).astype(np.float32)
        for w in WIDTHS:
            self.conv[w] = rng.normal(0, (w * self.dim) ** -0.5, (w, self.dim, self.filters)).astype(np.float32)
            self.bias[w] = np.zeros(self.filters, np.float32)
        self.out = rng.normal(0, 0.2, len(WIDTHS) * self.filters).astype(np.float32)

    def pooled(self, proj: list[np.ndarray], starts: np.ndarray, n: np.ndarray):
        """Max of each filter over each text (rows of proj[k] by word, one slice per offset) and where it is; 0 where a text is shorter than the filter."""
        values, places = [], []
        for w, p in zip(WIDTHS, proj):
            total = len(p[0])
            if total < w:
                values.append(np.zeros((len(n), self.filters), np.float32))
                places.append(np.zeros((len(n), self.filters), np.int64))
                continue
            s = p[0][: total - w + 1].copy()
            for k in range(1, w):
                s += p[k][k : total - w + 1 + k]
            best = np.zeros((len(n), self.filters), np.float32)
            at = np.zeros((len(n), self.filters), np.int64)
            for i in np.flatnonzero(n >= w):
                a, b = starts[i], starts[i] + n[i] - w + 1
                part = s[a:b]
                where = part.argmax(0)
                at[i] = a + where
                best[i] = part[where, np.arange(self.filters)]
            values.append(best + self.bias[w] * (n >= w)[:, None])
            places.append(at)
        return values, places

    # training -------------------------------------------------------------------
    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.01, holdout: int = 5) -> "Model":
        """Adam on the logistic loss; every `holdout`-th row of each class is kept for the thresholds."""
        self.base = float(labels.mean()) if len(labels) else 0.0
        if len(set(labels.tolist())) < 2:
            return self
        self.start()
        rng = np.random.default_rng(self.seed)
        index: dict[str, int] = {}
        rows, guess = [], []  # a text's words as numbers: each distinct word is held once
        for text in texts:
            words = WORD.findall(text.lower())
            guess.append(language(words))
            rows.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
        feats = np.array([self.features(w) for w in index] or [[self.buckets] * self.FEATURES], dtype=np.int64)
        order = np.zeros(len(labels), dtype=np.int64)
        for y in (0, 1):
            order[labels == y] = np.arange((labels == y).sum())
        held = order % holdout == holdout - 1
        if (labels[held] == 1).sum() < LEAST_HELD:  # too few to calibrate on apart
            held = np.zeros(len(labels), dtype=bool)
        train = np.flatnonzero(~held)
        # rows of buckets that only one or two texts touch stay zero: they would only learn those texts
        seen = np.zeros(self.buckets + 1, dtype=np.int64)
        for i in train:
            if len(rows[i]):
                seen[np.unique(feats[np.unique(rows[i])])] += 1
        rare = (seen < 3)
        rare[self.buckets] = True
        self.embed[rare] = 0
        weight = np.where(labels == 1, min(4.0, (labels == 0).sum() / max(1, (labels == 1).sum())), 1.0).astype(np.float32)
        params = {"embed": self.embed, "out": self.out, **{f"c{w}": self.conv[w] for w in WIDTHS}, **{f"b{w}": self.bias[w] for w in WIDTHS}}
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
        bias_m = [0.0, 0.0]
        step = 0
        epochs = max(epochs, min(MOST_PASSES, LEAST_PASSES // max(1, len(train))))  # small samples need more passes
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
                n = np.array([len(rows[i]) for i in part])
                flat = np.concatenate([rows[i] for i in part]) if n.sum() else np.zeros(0, np.int64)
                uniq, inv = np.unique(flat, return_inverse=True)
                emb = self.embed[feats[uniq]].sum(1)
                starts = np.cumsum(n) - n
                proj = [[(emb @ self.conv[w][k])[inv] for k in range(w)] for w in WIDTHS]
                values, places = self.pooled(proj, starts, n)
                pre = np.concatenate(values, 1)
                act = np.maximum(pre, 0)
                drop = (rng.random(act.shape) < 0.8).astype(np.float32) / 0.8
                h = act * drop
                logit = h @ self.out + self.out_bias
                y = labels[part]
                g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight[part] / len(part)).astype(np.float32)
                grad = {"out": h.T @ g + 1e-4 * self.out}
                dh = np.outer(g, self.out) * drop * (pre > 0)
                demb = np.zeros_like(emb)
                for x, w in enumerate(WIDTHS):
                    d = dh[:, x * self.filters : (x + 1) * self.filters] * (n >= w)[:, None]
                    grad[f"b{w}"] = d.sum(0)
                    grad[f"c{w}"] = np.zeros_like(self.conv[w])
                    i, f = np.nonzero(d)
                    dv, at = d[i, f], places[x][i, f]
                    for k in range(w):
                        u = inv[at + k]
                        gk = np.zeros((self.filters, self.dim), np.float32)
                        np.add.at(gk, f, dv[:, None] * emb[u])
                        grad[f"c{w}"][k] = gk.T
                        np.add.at(demb, u, dv[:, None] * self.conv[w][k].T[f])
                touched = np.flatnonzero(np.abs(demb).sum(1))
                b = feats[uniq[touched]]
                gb = np.repeat(demb[touched][:, None], self.FEATURES, 1).reshape(-1, self.dim)
                buckets, bi = np.unique(b.ravel(), return_inverse=True)
                ge = np.zeros((len(buckets), self.dim), np.float32)
                np.add.at(ge, bi, gb)
                ge[rare[buckets]] = 0
                step += 1
                lr = rate * min(1.0, step / 20) * (1 - 0.9 * epoch / epochs)
                c1, c2 = 1 - 0.9 ** min(step, 500), 1 - 0.999**step
                m, v = moment["embed"]
                m[buckets] = 0.9 * m[buckets] + 0.1 * ge
                v[buckets] = 0.999 * v[buckets] + 0.001 * ge * ge
                self.embed[buckets] -= lr * (m[buckets] / c1) / (np.sqrt(v[buckets] / c2) + 1e-8)
                for k, gr in grad.items():
                    m, v = moment[k]
                    m *= 0.9
                    m += 0.1 * gr
                    v *= 0.999
                    v += 0.001 * gr * gr
                    params[k] -= lr * (m / c1) / (np.sqrt(v / c2) + 1e-8)
                gb0 = float(g.sum())
                bias_m = [0.9 * bias_m[0] + 0.1 * gb0, 0.999 * bias_m[1] + 0.001 * gb0 * gb0]
                self.out_bias -= lr * (bias_m[0] / c1) / (bias_m[1] / c2 + 1e-16) ** 0.5
        # thresholds: by guessed language where it has enough rows of both classes, else over all
        check = np.flatnonzero(held) if held.any() else train
        logits = self.logits([texts[i] for i in check])
        guess = np.array(guess)[check]
        y = labels[check]
        everywhere = _threshold(logits, y)
        self.thresholds = {"": everywhere}
        for k in (*LANGUAGES, "other"):
            own = guess == k
            if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= LEAST_LANGUAGE:
                self.thresholds[k] = _threshold(logits[own], y[own])
        return self

    # scoring ----------------------------------------------------------------------
    def logits(self, texts: list[str], cache: dict | None = None) -> np.ndarray:
        return self.raw(texts, cache)[0]

    def raw(self, texts: list[str], cache: dict | None = None):
        """Logits and guessed languages. cache: a worker's embeddings by word."""
        if cache is None:
            cache = {}
        index = cache.setdefault("index", {})
        logits, langs = np.zeros(len(texts), np.float64), []
        kernel = cache.get("kernel")
        if kernel is None:
            kernel = cache["kernel"] = np.concatenate([self.conv[w][k] for w in WIDTHS for k in range(w)], 1)
        for a, b in steps([len(t) for t in texts], SCORE_CHARS):
            if len(index) > CACHE_WORDS:
                index.clear()
                cache["table"] = None
            lists = [WORD.findall(t.lower()) for t in texts[a:b]]
            langs += [language(x) for x in lists]
            flat = [w for x in lists for w in x]
            at = np.fromiter(map(index.get, flat, repeat(-1)), np.int64, len(flat))
            if len(lacking := np.flatnonzero(at < 0)):
                met = [flat[i] for i in lacking.tolist()]
                new = list(dict.fromkeys(met))
                rows = self.embed[np.array([self.features(w) for w in new])].sum(1)
                n0, table = len(index), cache.get("table")
                if table is None or n0 + len(new) > len(table):
                    bigger = np.zeros((max(n0 + n0 // 2, n0 + len(new), 1 << 12), self.dim), np.float32)
                    if table is not None:
                        bigger[:n0] = table[:n0]
                    cache["table"] = table = bigger
                table[n0 : n0 + len(new)] = rows
                index.update(zip(new, range(n0, n0 + len(new))))
                at[lacking] = [index[w] for w in met]
            n = np.array([len(x) for x in lists])
            starts = np.cumsum(n) - n
            p = cache["table"][at] @ kernel if len(at) else np.zeros((0, kernel.shape[1]), np.float32)
            proj, c, f = [], 0, self.filters
            for w in WIDTHS:
                proj.append([p[:, (c + k) * f : (c + k + 1) * f] for k in range(w)])
                c += w
            values, _ = self.pooled(proj, starts, n)
            logits[a:b] = np.maximum(np.concatenate(values, 1), 0) @ self.out + self.out_bias
        return logits, langs

    def score(self, texts: list[str], cache: dict | None = None) -> np.ndarray:
        if self.embed is None:
            return np.full(len(texts), self.base or 0.0)
        logits, langs = self.raw(texts, cache)
        cut = np.array([self.thresholds.get(k, self.thresholds[""]) for k in langs]) if langs else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(logits - cut + np.log(TARGET / (1 - TARGET)), -40, 40)))


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The cut of best F1; among equal ones the middle of the widest gap."""
    order = np.argsort(logits)
    x, t = logits[order], y[order]
    positives = np.append(np.cumsum(t[::-1])[::-1], 0)  # at or above each cut
    above = np.arange(len(x), -1, -1)
    f1 = 2 * positives / np.maximum(1, above + t.sum())
    edges = np.concatenate([[x[0] - 1.0], (x[1:] + x[:-1]) / 2, [x[-1] + 1.0]])
    gap = np.concatenate([[0.0], x[1:] - x[:-1], [0.0]])
    gap[0] = gap[-1] = 1e-9
    best = max(range(len(f1)), key=lambda i: (round(f1[i], 9), gap[i]))
    return float(edges[best])


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = 1500, sample_clean: int = 2500, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most sample_toxic + sample_clean labelled rows that aren't held out, the least by hash of the id."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    parts = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, sample_toxic), (0, sample_clean))]
    chosen = parts[0].union(parts[1]).groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen), "_id")  # at most the two sample sizes
    got = rows.groupBy("_id").agg(F.first("_y").alias("_y"), F.max("_text").alias("_text")).toPandas().sort_values("_id")
    return Model().fit(got["_text"].tolist(), got["_y"].to_numpy(dtype=np.int64))


def scored(docs: DataFrame, model: Model, text_col: str = "text", column: str = "_score") -> DataFrame:
    """docs without its text, with the score as last column: a narrow map, no shuffle. The model is a few MB at any input size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own, cache = shared.value, {}
        return lambda texts: [own.score(texts, cache)]

    return map_texts(docs.select(*(c for c in docs.columns if c != text_col), text_of(text_col)), {column: "double"}, start, SCORE_CHARS)


def score_of(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score as a column of docs. Only texts go to Python; a row's other columns stay where they are, of any type and name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, cache = shared.value, {}
        for texts in batches:
            yield pa.array(np.concatenate([own.score(texts.slice(a, b - a).to_pylist(), cache) for a, b in steps(pc.binary_length(texts).to_pylist(), SCORE_CHARS)] or [np.zeros(0)]), pa.float64())

    return score(text_of(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per row of docs."""
    rows = scored(docs.select("doc_id", text_of().alias("text")), fit(docs, labels, **bounds))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= TARGET).cast("int").alias("predicted"))
