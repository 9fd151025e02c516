"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: runs of anything but the six ASCII white-space bytes. ``bytes.split()`` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def utf8(text: str | None) -> bytes:
    """The UTF-8 bytes of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def byte_rows(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string or binary column as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Split a batch so that no piece's column exceeds ``most`` bytes, but for single rows."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0), dtype=np.int64)
    start, ends = 0, np.cumsum(lengths)
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
