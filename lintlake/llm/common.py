"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rank import ensure_checkpoint_dir

BLOCK_BYTES = 4 * 1024 * 1024
"""Bytes of text that a task handles at once; it bounds memory and drops nothing."""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once, compressed and by columns, to a new table in the checkpoint folder, and read back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """Columns renamed to ``c0, c1, ...`` (so that none can clash) and a number ``row``; number the rows of what is written, or they may change."""
    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), F.monotonically_increasing_id().alias("row"))


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``numbered`` under their names again."""
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return raw[first : int(offsets[-1]) if len(offsets) else 0], offsets - first


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``most`` bytes of text (a longer text is a batch of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def release() -> None:
    """Give freed memory back to the system: a worker is reused by other stages, and would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def with_fields(kept: list[str], schema: T.StructType, **added: str) -> str:
    """DDL of the ``kept`` fields of a schema followed by the added ones."""
    parts = [f"`{c.replace('`', '``')}` {schema[c].dataType.simpleString()}" for c in kept]
    return ", ".join([*parts, *(f"`{k}` {v}" for k, v in added.items())])


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
