"""Packing by concatenation: two-pass prefix sums over partition totals, then fixed windows.

Pass 1 encodes each document once and writes its ids with the partition it was read in and its token offset there. The driver turns
the totals, one number a partition, into global offsets. Pass 2 cuts each document at the multiples of the window; its pieces are
the boundary records between neighbouring sequences. No shuffle; nothing is gathered by sequence.

Cases: a null or empty text is its end token alone; a text of any length is cut freely, never shortened; repeated rows are packed
each on their own; a doc_id of any type, null too, is passed on unread; an empty table gives no pieces; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.bpe import STEP_BYTES, encoder
from larkfield.llm.common import map_texts, text_of, written

PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, opens boolean, closes boolean"


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, part_start (tokens before it in its partition), doc_tokens, ids (little-endian unsigned 32-bit), written to the shared folder."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def start():
        bpe, part, at = encoder(path), TaskContext.get().partitionId(), 0

        def work(texts: list[str]) -> list:
            nonlocal at
            ids, count = bpe.encode(texts)
            total = count + 1
            ends = np.cumsum(total)
            data = np.insert(ids, np.cumsum(count), end_id).astype("<u4").tobytes()
            first, at = at + ends - total, at + int(ends[-1])
            return [np.full(len(texts), part), first, total, [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), total.tolist())]]

        return work

    return written(map_texts(rows, {"part": "int", "part_start": "bigint", "doc_tokens": "bigint", "ids": "binary"}, start, STEP_BYTES), "packing")


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, opens and closes (the piece begins or
    ends its document), and with_ids its ids. All sequences but the last are full windows."""
    table = tokenised(docs, path, end_id, id_col, text_col)
    spark = docs.sparkSession
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    sums = np.cumsum([0, *(n for _, n in totals)])
    bases = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, sums)], "part int, base bigint")
    placed = table.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("at"), "ids")  # bases: a row per input partition
    kind = table.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in PIECES.split(", ")), *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, at, data = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            edge = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, 4 * data.offset).astype(np.int64) if len(data) else np.zeros(1, np.int64)
            n, view = np.diff(edge) // 4, memoryview(data.buffers()[2] or b"")
            first = at // window
            count = (at + n - 1) // window - first + 1
            row = np.repeat(np.arange(len(data)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            a = np.maximum(sequence * window, at[row]) - at[row]
            b = np.minimum((sequence + 1) * window - at[row], n[row])
            pieces = [view[x:y] for x, y in zip((edge[row] + 4 * a).tolist(), (edge[row] + 4 * b).tolist())]
            out = [docs.take(pa.array(row)), a, b - a, pa.array(map(zlib.crc32, pieces), pa.int64()), n[row], sequence, (at[row] + a) % window, a == 0, b == n[row]]
            if with_ids:
                out.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=names)

    return placed.mapInArrow(run, f"doc_id {kind}, {PIECES}" + (", ids array<int>" if with_ids else ""))
