"""Sessions, the shared scratch folder and tables written between stages."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "quillspark") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset, and the session runs in
    one process (tests), a temporary folder is taken instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file systems, so that any store works."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written in the shared folder to cut lineage between the stages of one operator.

    Unlike executor-local caches these survive the loss of any executor. ``keep`` writes a
    table that is dropped when the block ends; ``result`` writes one that stays until the
    Python process ends, since the caller may read it at any time.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def _write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = f"{shared_dir(self.spark)}/quillspark/{name}-{uuid.uuid4().hex[:12]}"
        with self._shuffles_go():
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    @contextlib.contextmanager
    def _shuffles_go(self):
        """The written table cuts the lineage, so the shuffle files behind it are removed as soon as it stands."""
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before) if before is not None else self.spark.conf.unset(name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df, path = self._write(df, name)
        self.paths.append(path)
        return df

    def result(self, df: DataFrame, name: str) -> DataFrame:
        df, path = self._write(df, name)
        spark = self.spark

        def clean() -> None:
            with contextlib.suppress(Exception):
                remove(spark, path)

        atexit.register(clean)
        return df

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            with contextlib.suppress(Exception):
                remove(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Short rows from which much is made, dealt out by keys over all shuffle partitions: a small file alone would be few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
