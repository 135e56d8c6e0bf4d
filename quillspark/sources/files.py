"""File source: folders of mixed files, with the rules of what is taken, and their fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.decode import SNIFF_BYTES, claimed_type, sniff

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def wanted(relative: Column) -> Column:
    """Not hidden, not an office lock, not half written, in no folder that is hidden or a system's own."""
    parts = F.split(relative, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    return ~name.rlike(r"^(\.|~\$)|\.(tmp|temp|part|partial|crdownload|download|swp)$") & ~F.exists(folders, lambda d: d.rlike(r"^[.@#$]"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder: path, relative, modificationTime, length, content. Spark's readers leave empty files out, which are refused anyway."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _relative(files, root).filter(wanted(F.col("relative")))


def _relative(files: DataFrame, root: str) -> DataFrame:
    base = root.split("://", 1)[-1].rstrip("/")
    return files.withColumn("relative", F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + "".join(f"\\{c}" if not c.isalnum() else c for c in base) + "/", ""))


def watch_files(spark: SparkSession, root: str) -> DataFrame:
    """The same as a stream of new files."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(root)
    return _relative(files, root).filter(wanted(F.col("relative")))


def fingerprint(files: DataFrame, most_bytes: int = 100 << 20) -> DataFrame:
    """Adds checksum, media type, folder path and why a file is refused (null if it is taken).

    Files that are refused for their size are never read: the bound is pushed into the scan.
    """
    large = files.filter(F.col("length") > most_bytes).drop("content").withColumn("content", F.lit(None).cast("binary")).select(*files.columns)
    return _fingerprinted(files.filter(F.col("length") <= most_bytes), most_bytes).unionByName(_fingerprinted(large, most_bytes))


def _fingerprinted(files: DataFrame, most_bytes: int) -> DataFrame:
    head = F.substring("content", 1, SNIFF_BYTES)
    out = files.withColumn("checksum_sha256", F.sha2("content", 256)).withColumn("mime_type", sniff(head, claimed_type(F.col("path"))))
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large").when(F.col("mime_type").isNull(), "wrong type")
    folder = F.array_join(F.slice(F.split("relative", "/"), 1, F.size(F.split("relative", "/")) - 1), "/")
    return out.withColumn("folder_path", folder).withColumn("refused", reason)


def not_refused_before(files: DataFrame, refusals: DataFrame) -> DataFrame:
    """Files without those versions (path, length, modificationTime) that were refused; a changed file is a new version."""
    return files.join(refusals.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti")


def ingest_outcomes(fingerprinted: DataFrame, documents: DataFrame, user_id) -> DataFrame:
    """Adds ``outcome`` and ``document_id`` to files: what becomes of each.

    ``rejected`` with a reason; ``duplicate`` of the oldest document that the user has filed (copies in the trash do not count);
    ``finish`` of a pending document with the same bytes that an earlier pass left; ``file``. Of equal new files the first
    path is filed, the others are its duplicates, as yet without a document.
    """
    own = documents.filter((F.col("user_id") == user_id) & F.col("deleted_at").isNull() & F.col("checksum_sha256").isNotNull())
    oldest = lambda pending: F.min_by("id", F.when((F.col("status") == "pending_upload") == pending, F.struct("created_at", "id")))
    known = own.groupBy("checksum_sha256").agg(oldest(False).alias("__filed"), oldest(True).alias("__pending"))
    place = F.row_number().over(Window.partitionBy("checksum_sha256", F.col("refused").isNull()).orderBy("path"))
    rows = fingerprinted.withColumn("__n", place).join(known, "checksum_sha256", "left")
    outcome = F.when(F.col("refused").isNotNull(), "rejected").when(F.col("__filed").isNotNull() | (F.col("__n") > 1), "duplicate").when(F.col("__pending").isNotNull(), "finish").otherwise("file")
    return rows.withColumn("outcome", outcome).withColumn("document_id", F.when(F.col("refused").isNull(), F.coalesce("__filed", "__pending"))).drop("__n", "__filed", "__pending").select(*fingerprinted.columns, "outcome", "document_id")


def new_files(fingerprinted: DataFrame, documents: DataFrame, user_id) -> DataFrame:
    """Taken files whose bytes the user has not filed yet; of equal files the first path."""
    known = documents.filter(F.col("user_id") == user_id).select("checksum_sha256")
    fresh = fingerprinted.filter("refused is null").join(known, "checksum_sha256", "left_anti")
    first = fresh.groupBy("checksum_sha256").agg(F.min("path").alias("path"))
    return fresh.join(first, ["checksum_sha256", "path"], "left_semi")
