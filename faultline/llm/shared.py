"""Helpers that several operators use: hints by size, ASCII folding, text arrays and their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import once as let  # noqa: F401
from faultline.sources.storage import discard, new_path, scratch, small_batches, stored  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side of a join is hinted for broadcast only when its measured bytes are at most this: each executor holds its hash table, which takes several times that.
BROADCAST_BYTES = 512 << 10


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts that are all ASCII take the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def maybe_broadcast(df: DataFrame, bytes_measured: int) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows one, else with that of a shuffled join.

    The measured size decides alone: Spark's own choice goes by the compressed bytes of files, so it would join one way here and another there.
    """
    return F.broadcast(df) if bytes_measured <= BROADCAST_BYTES else df.hint("merge")


def hinted(df: DataFrame) -> DataFrame:
    """A stored ``df`` of plain columns, with a broadcast hint if the bytes of its values allow one."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(32))
    return maybe_broadcast(df, df.agg(F.sum(size)).first()[0] or 0)


def by_bytes(column: pa.Array, most: int = 8 << 20, rows: int = 1 << 20):
    """(start, stop) ranges of at most ``rows`` rows and about ``most`` bytes of text each; one row at least."""
    ends = np.cumsum(lengths(column))
    start = 0
    while start < len(column):
        base = int(ends[start - 1]) if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + most, "right"))))
        yield start, stop
        start = stop


def plain(column: pa.Array) -> pa.Array:
    """A string array that owns its offsets from 0, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
        if column.offset:
            column = column.take(pa.array(np.arange(len(column))))
    return column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a :func:`plain` array."""
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def lengths(column: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; a null has none."""
    return np.diff(buffers(plain(column))[0])


def strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A string array over bytes and offsets, without a copy of the bytes."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
