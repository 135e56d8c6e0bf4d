"""Tar archives: one task reads one archive as a stream; writing is one archive for each partition."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "archive string, path string, size long, content binary"


def entries(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    """Regular files of an archive, packed or not; one that ends early is an error."""
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
        for member in tar:
            if member.isfile():
                content = tar.extractfile(member).read()
                if len(content) != member.size:
                    raise ValueError(f"{member.name} ends early")
                yield member.name, member.size, content


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all archives at a path; a list of archives is read in parallel, one batch an archive."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for archive, data in zip(frame["path"], frame["content"], strict=True):
                for name, size, content in entries(data):
                    yield pd.DataFrame({"archive": [archive], "path": [name], "size": [size], "content": [content]})

    return files.mapInPandas(run, ENTRIES)


def pack(rows: list[tuple[str, bytes]]) -> bytes:
    """One archive in pax form, entries in the given order, times zero."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name, content in rows:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


def pack_archives(files: DataFrame, files_each: int = 1000) -> DataFrame:
    """(archive, content): files (path, content) packed into archives of bounded numbers of files, by hash of the path."""
    n = F.lit(max(1, files_each))
    total = files.count()
    keyed = files.select(F.pmod(F.xxhash64("path"), F.lit(max(1, -(-total // files_each)))).alias("archive"), "path", "content").filter(n > 0)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("path")
        return pd.DataFrame({"archive": [f"part-{int(frame['archive'].iloc[0]):05d}.tar"], "content": [pack(list(zip(frame["path"], frame["content"], strict=True)))]})

    return keyed.groupBy("archive").applyInPandas(run, "archive string, content binary")
