"""What the training-data operators share: tables in the shared folder, document keys, and Arrow helpers."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.session import checkpoint_root

#: Letters of a word: everything but the six white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: How many bytes of text a task works on at once.
CHUNK_BYTES = 1 << 18


#: Rows of an Arrow batch: texts may be long, and a batch is held by Spark and by Python at once.
BATCH_ROWS = "1024"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that ``stored`` wrote and nobody has deleted, by the path of each: the session, and whether a ``scratch`` block wrote it.
_tables: dict[str, tuple[SparkSession, bool]] = {}
_blocks: list[bool] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables stored inside serve what is made there only; ``release`` may delete them once that is written."""
    _blocks.append(True)
    try:
        yield
    finally:
        _blocks.pop()


def stored(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back: lineage ends there, and every executor reaches it."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables[path] = (spark, bool(_blocks))
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` gave and nothing will read again."""
    for table_ in tables:
        paths = {path for path in _tables for file in table_.inputFiles()[:1] if f"/{path.rsplit('/', 1)[-1]}/" in file}
        for path in paths:
            delete(path)


def delete(path: str) -> None:
    spark, _ = _tables.pop(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def release(spark: SparkSession, docs: DataFrame) -> None:
    """Between stages: delete the tables of ``scratch`` blocks but those that ``docs`` reads, and let Spark clean up finished shuffles.

    For callers that have written what the stages before gave. Shuffle files go when the driver no longer holds the plans
    they belong to.
    """
    mine = [path for path, (owner, inner) in _tables.items() if owner is spark and inner]
    if mine:
        read = {part for file in docs.inputFiles() for part in file.split("/") if part.startswith("llm-")}
        for path in mine:
            if path.rsplit("/", 1)[-1] not in read:
                delete(path)
    gc.collect()
    spark._jvm.java.lang.System.gc()


def doc_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What stands for a document in joins: its id, or a hash of its text where the id is null."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def text_tag(text: str = "text") -> Column:
    """A hash of the text of its own, beside ``doc_key``: it parts documents that share an id, and makes 128 bits of those without."""
    return F.xxhash64(F.lit(11), F.coalesce(F.col(text), F.lit("")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes each, at least one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching half-open ranges as maximal ones, in order."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def spans_of(cell: pa.Scalar) -> list[tuple[int, int]]:
    """The (a, b) ranges of a list cell, merged; none if it is null."""
    if not cell.is_valid:
        return []
    a, b = cell.values.flatten()
    return merged(list(zip(a.to_pylist(), b.to_pylist(), strict=True)))
