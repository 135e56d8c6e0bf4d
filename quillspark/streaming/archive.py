"""Stateful operators on streams: quiet periods, first sights, stable files, sliding limits, state folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..settings import ARCHIVE


def quiet_periods(events: DataFrame, key: str, time: str, gap_s: int = ARCHIVE.debounce_s, late: str | None = None) -> DataFrame:
    """(key, start, fires_at, n): bursts of events that end when nothing comes for ``gap_s``; batch or stream."""
    rows = events.withWatermark(time, late) if late else events
    w = F.session_window(F.col(time), f"{gap_s} seconds")
    return rows.groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("fires_at"), "n")


def first_sights(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stable_files(sightings: DataFrame, stable_s: int = ARCHIVE.stable_s, forget_s: int = 7 * 86_400) -> DataFrame:
    """(path, size, mtime, since) once a file has kept its size and time for ``stable_s``; each version once.

    ``sightings`` is a stream of scans: path, size, mtime, seen_at. State per path is one version; a path
    that no scan has seen for ``forget_s`` is forgotten, and given again if it comes back.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        size, mtime, since, given = state.get if state.exists else (-1, None, None, False)
        out = []
        for frame in frames:
            for row in frame.sort_values("seen_at").itertuples():
                if (row.size, row.mtime) != (size, mtime):
                    size, mtime, since, given = row.size, row.mtime, row.seen_at, False
                elif not given and (row.seen_at - since).total_seconds() >= stable_s:
                    given = True
                    out.append((key[0], size, mtime, since))
        state.update((size, mtime, since, given))
        state.setTimeoutDuration(forget_s * 1000)
        yield pd.DataFrame(out, columns=["path", "size", "mtime", "since"])

    return sightings.groupBy("path").applyInPandasWithState(step, "path string, size long, mtime timestamp, since timestamp", "size long, mtime timestamp, since timestamp, given boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def rate_limited(events: DataFrame, key: str, time: str, order: list[str], most: int = ARCHIVE.rate_attempts, window_s: int = ARCHIVE.rate_window_s) -> DataFrame:
    """Adds ``attempts`` (of the key in the window up to and with this one) and ``refused``.

    Keys' histories are cut into spans of the window's length, each with the one before it as context, so that a
    key with very many events is many small groups.
    """
    t = F.unix_micros(F.col(time).cast("timestamp"))
    span = window_s * 1_000_000
    rows = events.withColumn("__t", t).withColumn("__s", F.floor(F.col("__t") / span)).withColumn("__own", F.lit(True))
    context = rows.withColumn("__s", F.col("__s") + 1).withColumn("__own", F.lit(False))
    w = Window.partitionBy(key, "__s").orderBy("__t").rangeBetween(-span + 1, 0)
    both = rows.unionByName(context).withColumn("attempts", F.count("*").over(w))
    return both.filter("__own").withColumn("refused", F.col("attempts") > most).drop("__t", "__s", "__own")


def fold_events(events: DataFrame, key: str, time: str, kind: str, id_col: str) -> DataFrame:
    """(key, last_kind, first_at, last_at, n): the state that a key's events, in order, leave behind."""
    return events.groupBy(key).agg(F.max_by(kind, F.struct(time, id_col)).alias("last_kind"), F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count("*").alias("n"))


def observed_import(entries: DataFrame, job: str) -> DataFrame:
    """A stream or table of import entries (action) that tells, as it runs, how many have been imported, skipped and failed."""
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return entries.observe(f"import:{job}", F.count(F.lit(1)).alias("seen"), count("imported"), count("skipped"), count("failed"))


class ImportProgress(StreamingQueryListener):
    """Where running imports stand: add it to ``spark.streams``, and ask ``of(job)`` at any time. Counts are added up batch by batch;
    a batch that is told twice counts once, and what a restarted query did before its restart is told by the caller."""

    def __init__(self):
        self.batches: dict[str, dict[tuple[str, int], dict[str, int]]] = {}
        self.ended: set[str] = set()
        self.running: dict[str, set[str]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        for name, row in progress.observedMetrics.items():
            if name.startswith("import:"):
                job = name.removeprefix("import:")
                self.batches.setdefault(job, {})[str(progress.id), progress.batchId] = row.asDict()
                self.running.setdefault(str(progress.id), set()).add(job)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception is None:
            self.ended |= self.running.get(str(event.id), set())

    def of(self, job: str) -> dict[str, int | bool]:
        rows = list(self.batches.get(job, {}).values())
        return {k: sum(r[k] for r in rows) for k in ("seen", "imported", "skipped", "failed")} | {"finished": job in self.ended}
