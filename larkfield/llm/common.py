"""Shared helpers: shared-folder tables, text batches and stable hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one in-memory step of a Python worker handles at once (a longer single text is a step of its own).
STEP_CHARS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, which is one process; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="larkfield-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: list[str] = []


def mark() -> int:
    """The number of tables written so far, for clear()."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables that this driver has written since a mark, but for the last `keep`, once what reads them is stored; returns their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def steps(lengths, most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Cut rows with these lengths into runs [a, b) of about `most` characters."""
    a = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


#: Arrow types of the columns that map_texts makes, by their SQL names.
ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
}


def map_texts(rows: DataFrame, made: dict[str, str], start: Callable[[], Callable], most: int = STEP_CHARS) -> DataFrame:
    """rows with their last column, a text without nulls, replaced by the columns `made` (name: SQL type). A narrow map, no shuffle.

    start() is called once a partition and gives a function of a list of texts that returns the columns' values; it gets about `most` bytes of
    text at once, so memory is bound by an Arrow batch and a step. All other columns stay the Arrow arrays they are: an id keeps all its bits,
    beside nulls too.
    """
    kept, types = rows.schema.fields[:-1], [ARROW[t] for t in made.values()]
    names = [*(f.name for f in kept), *made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {t}" for n, t in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for a, b in steps(pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist(), most):
                *own, texts = batch.slice(a, b - a).columns
                yield pa.RecordBatch.from_arrays([*own, *(x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(work(texts.to_pylist()), types))], names=names)

    return rows.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: a bijection of uint64 that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
