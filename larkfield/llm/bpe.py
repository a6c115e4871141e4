"""BPE encoding and decoding with numpy merge rounds.

Distinct pre-tokens of a step are encoded together: their symbols lie in one flat array, and each round finds for every word the
adjacent pair of lowest rank (binary search over sorted pair keys, then a segmented minimum) and merges it, until no word has a
pair left. Words that are done leave the array. A worker keeps the ids of pre-tokens it has met, up to CACHE_WORDS of them.

Cases: null and empty texts have no ids; the strings of special tokens inside a text give the special ids; texts are never cut;
repeated rows give repeated results; a doc_id of any type, null too, is passed on unread; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import islice, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import map_texts, text_of

#: Pre-tokens a worker remembers before it forgets most; bounds its memory, not its results.
CACHE_WORDS = 450_000
#: Bytes of text that are encoded at once.
STEP_BYTES = 500_000
#: Below this code point lower-casing, composition and classes are those of Python's tables; a text beyond it goes through the library's own normalizer.
PLAIN = 0x250
#: Marks of pre-tokens that are not plain words; beyond PLAIN, so no plain word begins with them.
STAND_INS, SPECIAL = "\ufdd0", "\ufdd1"


def _byte_chars() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def _classes(letter: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == letter)


class WordBpe:
    """Encoder and decoder of a tokenizers file with a BPE model with word ends (word_bpe_49k.json's layout)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * self.size
        for text, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = text.encode()
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = (np.array([self.vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # a rank is even-handed if no pair with its product ranks before it: then all its places in a word may merge in one round
        first = np.full(self.size, len(pairs), dtype=np.int64)
        np.minimum.at(first, left, np.arange(len(pairs)))
        np.minimum.at(first, right, np.arange(len(pairs)))
        self.together = first[made] > np.arange(len(pairs))
        chars = _byte_chars()
        self.byte_char = chars
        self.byte_ids = np.array([self.vocab.get(c, -1) for c in chars], dtype=np.int64)
        self.last_ids = np.array([self.vocab.get(c + self.suffix, -1) for c in chars], dtype=np.int64)
        self.char_byte = {c: b for b, c in enumerate(chars)}
        letters, numbers = _classes("L"), _classes("N")
        self.words = re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{numbers}]|[^\\s{letters}{numbers}]+".replace("\\s", r"\t-\r \x85\xa0"))
        self.odd = re.compile(f"[^\x00-{chr(PLAIN - 1)}]")
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.start, self.count, self.n = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64), 0

    def forget(self) -> None:
        """Keep a third of the words, those met first: frequent ones are among them."""
        self.n = min(self.n, CACHE_WORDS // 3)
        self.index = dict(islice(self.index.items(), self.n))
        self.used = int(self.start[self.n - 1] + self.count[self.n - 1]) if self.n else 0

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty byte words: (all ids in order, ids per word)."""
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(n)
        sym = self.byte_ids[data]
        sym[ends - 1] = self.last_ids[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), n)
        done_sym, done_word = [], []
        none = len(self.made)
        rank = np.full(len(sym), none, dtype=np.int64)
        look = np.arange(len(sym))  # places whose pair is new
        while len(sym):
            look = look[look + 1 < len(sym)]
            look = look[word[look] == word[look + 1]]
            key = sym[look] * self.size + sym[look + 1]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank[look] = np.where(self.keys[at] == key, self.ranks[at], none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(sym)))
            if (best == none).any():
                over = np.repeat(best == none, sizes)
                done_sym.append(sym[over])
                done_word.append(word[over])
                stay = ~over
                sym, word, rank = sym[stay], word[stay], rank[stay]
                if not len(sym):
                    break
                sizes, best = sizes[best < none], best[best < none]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # left to right, places may not overlap: in a run of adjacent hits every second one counts
            lead = np.maximum.accumulate(np.where(np.append(True, hit[1:] != hit[:-1] + 1), np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - lead) % 2 == 0]
            low = rank[hit]
            alone = ~self.together[low]
            if alone.any():  # only the leftmost place of such a word
                w = word[hit]
                hit = hit[~alone | np.append(True, w[1:] != w[:-1])]
                low = rank[hit]
            sym[hit] = self.made[low]
            rank[hit] = none
            rank[hit[hit > 0] - 1] = none
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            now = hit - np.arange(len(hit))  # a hit's place after the removals before it
            rank[now] = none
            near = np.zeros(len(sym), dtype=bool)
            near[now] = True
            near[now[now > 0] - 1] = True
            look = np.flatnonzero(near)
        sym = np.concatenate(done_sym) if done_sym else sym
        word = np.concatenate(done_word) if done_word else word
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        known = sym >= 0  # a byte that the vocabulary lacks has no id
        return sym[known].astype(np.int32), np.bincount(word[known], minlength=len(words))

    def _learn(self, new: list[str]) -> None:
        chars = self.char_byte
        raw = [bytes(chars[c] for c in w[1:]) if w[0] == STAND_INS else w.encode() for w in new]
        ids, count = self.merge(raw)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        while self.n + len(new) > len(self.start):
            self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + len(new)] = self.used + np.cumsum(count) - count
        self.count[self.n : self.n + len(new)] = count
        self.index.update(zip(new, range(self.n, self.n + len(new))))
        self.used, self.n = self.used + len(ids), self.n + len(new)

    def _pretokens(self, text: str) -> list[str]:
        """Pre-tokens; those that the library made, of its stand-ins of bytes, are marked."""
        if not self.odd.search(text):
            return self.words.findall(text.lower())
        return [STAND_INS + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids per text)."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        words: list[str] = []
        per_text = np.zeros(len(texts), dtype=np.int64)
        index = self.index
        for k, text in enumerate(texts):
            before = len(words)
            parts = self.special_split.split(text) if "<|" in text and self.special_split else [text]
            for i, part in enumerate(parts):
                if i % 2:
                    words.append(SPECIAL + part)
                elif part:
                    words += self._pretokens(part)
            per_text[k] = len(words) - before
        at = np.fromiter(map(index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if len(lacking := np.flatnonzero(at < 0)):
            met = [words[i] for i in lacking.tolist()]
            new = set(met)
            special = [w for w in new if w[0] == SPECIAL]
            if rest := sorted(new.difference(special)):
                self._learn(rest)
            for w in special:
                if self.used == len(self.flat):
                    self.flat = np.append(self.flat, np.zeros_like(self.flat))
                if self.n == len(self.start):
                    self.start, self.count = np.append(self.start, np.zeros_like(self.start)), np.append(self.count, np.zeros_like(self.count))
                self.flat[self.used], self.start[self.n], self.count[self.n] = self.special[w[1:]], self.used, 1
                index[w] = self.n
                self.used, self.n = self.used + 1, self.n + 1
            at[lacking] = [index[w] for w in met]
        n = self.count[at]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        tops = np.append(0, ends)[np.cumsum(per_text)]
        return ids, np.diff(np.append(0, tops))

    def decode(self, ids) -> bytes:
        """UTF-8 of the decoded text: the tokens joined by one space, as the file names no decoder; special tokens stay."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in ids])


_loaded: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    """The worker's one encoder of a file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", emit: str = "ids") -> DataFrame:
    """Per row: the id column, n_tokens and, by emit, `ids` (array<int>) and `decoded` (string), or `digest` columns of both.

    A narrow map over the scan: no shuffle, memory bound by a step of text and the cache.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def start():
        bpe = encoder(path)

        def work(texts: list[str]) -> list:
            ids, count = bpe.encode(texts)
            each = np.split(ids, np.cumsum(count)[:-1])
            texts = map(bpe.decode, map(np.ndarray.tolist, each))
            if emit == "ids":
                return [count, each, [t.decode() for t in texts]]
            return [count, [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each], [hashlib.sha256(t).hexdigest() for t in texts]]

        return work

    return map_texts(rows, {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string"} if emit == "ids" else {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, start, STEP_BYTES)
