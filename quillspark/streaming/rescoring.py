"""When a user's uploads fall quiet their suggestions are scored anew: a stream that writes versions of a table, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.linkage import merge_groups
from ..operators.suggestions import member_key, written
from ..session import remove
from ..settings import ARCHIVE, LINKAGE, Linkage
from .archive import quiet_periods


class VersionedTable:
    """A table as numbered versions in a folder: a version counts once its writer has finished, and readers take the last one.

    A version's number is that of the batch that made it, and it is made from the one before. So a batch that is run again after a
    crash finds its version finished, or starts it over from the same rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 3):
        self.spark, self.path, self.schema, self.keep = spark, path.rstrip("/"), schema, keep
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, version: int) -> str:
        return f"{self.path}/version={version:012d}"

    def versions(self) -> list[int]:
        """The finished versions, the oldest first."""
        if not self._files.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._root)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and self._files.exists(done(f"{self.path}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        """The last finished version, or the last one before a number; empty if there is none."""
        some = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(self._at(some[-1])) if some else self.spark.createDataFrame([], self.schema)

    def write(self, version: int, make: Callable[[DataFrame], DataFrame]) -> bool:
        """Makes a version from the one before it; False if it was finished already."""
        if version in self.versions():
            return False
        make(self.read(version)).write.mode("overwrite").parquet(self._at(version))
        for old in self.versions()[: -self.keep]:
            remove(self.spark, self._at(old))
        return True


SUGGESTIONS = "member_key string, user_id string, document_ids array<string>, confidence double, band string, status string"


def rescored(stored: DataFrame, candidates: DataFrame, users: DataFrame, s: Linkage = LINKAGE) -> DataFrame:
    """The suggestions after a scoring of some users' (user_id) documents; those of others stay as they are."""
    theirs = stored.join(users, "user_id", "left_semi")
    others = stored.join(users, "user_id", "left_anti")
    groups = merge_groups(candidates.join(users, "user_id", "left_semi"), s)
    owner = candidates.select(F.col("id").alias("__first"), "user_id")
    found = groups.withColumn("__first", F.col("document_ids")[0]).join(owner, "__first").select(member_key(F.col("document_ids")).alias("member_key"), "document_ids", "confidence", "band", "user_id")
    after = written(theirs.drop("user_id"), found.drop("user_id"))
    # groups keep to one user, so a key has one owner
    owners = theirs.select("member_key", "user_id").unionByName(found.select("member_key", "user_id")).distinct()
    return after.join(owners, "member_key").select(*stored.columns).unionByName(others.select(*stored.columns))


def rescore_on_quiet(uploads: DataFrame, table: VersionedTable, candidates: Callable[[], DataFrame], *, quiet_s: int = ARCHIVE.debounce_s, late: str = "0 seconds", s: Linkage = LINKAGE) -> DataStreamWriter:
    """A query to start: uploads (user_id, at) of a user, once none has come for ``quiet_s``, make the next version of the table.

    ``candidates`` reads the documents as they stand when the batch runs (see ``suggestions.load_candidates``, with user_id as text).
    """
    quiet = quiet_periods(uploads.select(F.col("user_id").cast("string").alias("user_id"), "at"), "user_id", "at", quiet_s, late)

    def batch(rows: DataFrame, number: int) -> None:
        users = rows.select("user_id").distinct()
        if not users.isEmpty():
            table.write(number, lambda stored: rescored(stored, candidates(), users, s))

    return quiet.writeStream.outputMode("append").foreachBatch(batch)
