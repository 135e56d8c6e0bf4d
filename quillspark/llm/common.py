"""Helpers that several operators share: Arrow batches, digests, bounded pieces of work."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one step inside a task works on; a longer text makes a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 4 << 20
#: Bits of the largest bitmap that is broadcast to tell rows apart.
BITMAP_BITS = 1 << 27


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that memory in a task follows ``limit``, not the number of rows in a batch."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def bounded_batches(spark) -> None:
    """From here on the session hands Python no more than BATCH_BYTES at once (a longer row alone), so that memory does not follow rows a batch.

    Spark's own bound is 64 MB; a lower one of the caller's stays. Results never depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if 0 < int(str(spark.conf.get(name)).rstrip("bB")) <= BATCH_BYTES:
        return
    spark.conf.set(name, str(BATCH_BYTES))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts as strings; null is the empty text."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is the empty text."""
    return [t if t is not None else b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def sha256(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def mapped(df, function, schema: str, id_col: str = "doc_id", text_col: str = "text", limit: int = STEP_BYTES):
    """Runs ``function`` (record batch with columns id and text -> record batch) over all rows, piece by piece.

    Only the two columns are read, under fixed names, so other columns of the table never matter.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit=limit):
                yield function(part)

    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def row_key(*columns: str):
    """A 64-bit key of a row by what is in these columns, nulls told apart: equal rows have equal keys, however they are read."""
    from pyspark.sql import functions as F

    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def without_rows(df, keys, key: str):
    """The rows of ``df`` whose ``key`` is not in ``keys``, which is read more than once and so should be a written table.

    Long rows move only if they have to: a bitmap of the keys' hashes, of BITMAP_BITS bits (16 MB) at most, is broadcast. Rows
    that it does not hold stay where they are; the others, chance hits among them, are told apart by an ordinary anti join.
    """
    from pyspark.sql import functions as F

    n = keys.count()
    bits = min(BITMAP_BITS, max(1 << 15, 1 << (n * 256).bit_length()))
    place = F.pmod(F.xxhash64(key, F.lit("row")), F.lit(bits))
    bucket, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    maps = keys.select(bucket.alias("__bucket"), bit.alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    marked = df.withColumn("__bucket", bucket).join(F.broadcast(maps), "__bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    marked = marked.withColumn("__held", held).drop("__bucket", "__map")
    out = marked.filter("not __held").unionByName(marked.filter("__held").join(keys.select(key), key, "left_anti"))
    return out.drop("__held")
