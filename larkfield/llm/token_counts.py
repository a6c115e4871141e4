"""Token counts from distinct pre-tokens.

A pre-token is a run of spaces with the characters after it, up to the next space or line feed. No piece of the model spans such a
border, so pieces are counted once for each distinct pre-token a worker meets and joined to each document's pre-token frequencies; a
document's ids are never made, only those of pre-tokens a worker hasn't met. The join is with the worker's own table, as a shuffle of (document,
pre-token) rows would move more bytes than the text.

Cases: null and empty texts count 0 tokens; texts are never cut; repeated rows give repeated results; a doc_id of any type, null too, is
passed on unread; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import mul

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import map_texts, text_of

#: Pre-tokens a worker remembers before it starts anew; bounds its memory, not its results.
CACHE_PRETOKENS = 400_000


class PieceCounter:
    """Counts a sentencepiece model's pieces; begin and end symbols are not counted."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        pieces = [p.piece for p in model.pieces if p.type in (1, 4)]
        inside = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        if inside or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("pieces of this model may span pre-tokens")
        self.prefix = "▁" if spec.add_dummy_prefix else ""
        spec.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.split = re.compile("▁*[^▁\n]+|▁+|\n")
        self.pieces: dict[str, int] = {}

    def frequencies(self, text: str) -> Counter:
        return Counter(self.split.findall(self.prefix + text.replace(" ", "▁"))) if text else Counter()

    def count(self, text: str) -> int:
        freq, known = self.frequencies(text), self.pieces
        if new := [t for t in freq if t not in known]:
            if len(known) > CACHE_PRETOKENS:
                known.clear()
                new = list(freq)
            known.update(zip(new, map(len, self.library.encode(new, num_threads=1))))
        return sum(map(mul, freq.values(), map(known.__getitem__, freq)))


_loaded: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) per row: a narrow map, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def start():
        pieces = counter(path)

        def work(texts: list[str]) -> list:
            n = list(map(pieces.count, texts))
            return [[len(t.encode()) for t in texts], n, [k > limit for k in n]]

        return work

    return map_texts(rows, {"n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}, start)
