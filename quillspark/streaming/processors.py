"""Operators whose state is kept by key on a stream: pipeline steps, rate limits, files that are being written.

Each is a processor of ``transformWithStateInPandas`` with typed state, timers and expiry. The state store is RocksDB, so state lies on
disk with checkpoints in the query's checkpoint folder and a lost executor's keys are restored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.processing import STEPS, step_status
from ..settings import ARCHIVE

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that typed state needs; a session that already has one of RocksDB keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, _ROCKS)


def _utc_ms(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


def whole_ms(at: Column) -> Column:
    """Milliseconds since 1970 of a time, to the nearest one, halves away from zero."""
    us = F.unix_micros(at.cast("timestamp"))
    return F.call_function("div", us + F.when(us < 0, F.lit(-500)).otherwise(F.lit(500)), F.lit(1000).cast("long"))


# --- pipeline steps ---


class StepMachine(StatefulProcessor):
    """Folds the events of a document's steps as they come.

    Of a step's events the one with the greatest (time, number) decides its status and error, whenever it arrives (of equal ones the first to arrive); every start counts as an
    attempt. So the state after any batch is that of a batch fold over all events so far, in whatever order they came.
    A document that has been ready for ``forget_s`` without an event is forgotten.
    """

    def __init__(self, forget_s: int, timers: bool):
        self.forget_s, self.timers = forget_s, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "step string", "position int, status string, error string, attempts int, at timestamp, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {k[0]: list(v) for k, v in self.steps.iterator()}
        touched = set()
        for frame in rows:
            for e in frame.itertuples(index=False):
                for step, kind in step_events(e.step, e.kind, e.steps):
                    old = known.get(step) or [STEPS.index(step) if step in STEPS else len(STEPS), "queued", None, 0, None, -1]
                    attempts = old[3] + (kind == "running")
                    at = e.at.to_pydatetime()
                    if old[4] is None or (at, e.seq) > (old[4].replace(tzinfo=None), old[5]):
                        old = [old[0], kind, e.error if kind == "failed" else None, attempts, at, int(e.seq)]
                    else:
                        old[3] = attempts
                    known[step] = old
                    touched.add(step)
        for step in touched:
            self.steps.updateValue((step,), tuple(known[step]))
        status, next_step, done, attempts, error = step_status([(v[0], k, v[1], v[2], v[3]) for k, v in known.items()])
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if status == "ready":
                last = max(v[4] for v in known.values())
                self.handle.registerTimer(_utc_ms(pd.Timestamp(last)) + self.forget_s * 1000)
        yield pd.DataFrame({"document_id": [key[0]], "status": [status], "next_step": [next_step], "done": [done], "attempts": [attempts], "error": [error]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.steps.clear()
        return iter(())

    def close(self) -> None:
        pass


def step_events(step: str | None, kind: str, enabled) -> list[tuple[str, str]]:
    """The steps that an event is about, and what becomes of them: a plan queues the enabled ones and skips the others."""
    if kind == "planned":
        return [(s, "queued" if s in set(enabled) else "skipped") for s in STEPS]
    return [(step, {"started": "running"}.get(kind, kind))]


STATUS = "document_id string, status string, next_step string, done int, attempts int, error string"


def step_stream(events: DataFrame, *, late: str | None = "1 hour", forget_s: int = 86_400) -> DataFrame:
    """(document_id, status, next_step, done, attempts, error): where each touched document stands after a batch; output mode update.

    ``events`` is a stream of document_id, seq, at, step, kind, error, steps. Kinds: planned (with ``steps``, those that are enabled), queued,
    started, succeeded, skipped, failed. With ``late``, events behind the watermark are dropped, and ready documents are forgotten
    once it is ``forget_s`` past their last event; without it, none is dropped and none forgotten.
    """
    use_rocksdb(events.sparkSession)
    rows = events.select(F.col("document_id").cast("string").alias("document_id"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"), "step", "kind", "error", "steps")
    rows = rows.withWatermark("at", late) if late else rows
    return rows.groupBy("document_id").transformWithStateInPandas(StepMachine(forget_s, bool(late)), STATUS, "Update", "EventTime" if late else "None")


# --- rate limits ---


class Limiter(StatefulProcessor):
    """Lets an attempt pass while fewer than ``most`` passed in the window before it; what is refused is not counted."""

    def __init__(self, most: int, window_s: int):
        self.most, self.window_ms = most, window_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        recent = [r[0] for r in self.recent.get()]
        every = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        ids, passed, waits = [], [], []
        for e in every.itertuples(index=False):
            # behind the last one that passed: judged as if it came then
            at = max(_utc_ms(e.at), recent[-1] if recent else 0)
            recent, wait = admitted(recent, at, self.most, self.window_ms)
            ids.append(e.id)
            passed.append(wait is None)
            waits.append(wait)
        self.recent.clear()
        if recent:
            self.recent.put([(t,) for t in recent])
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(recent[-1] + self.window_ms)
        yield pd.DataFrame({"key": [key[0]] * len(ids), "id": ids, "passed": passed, "retry_after_s": pd.array(waits, "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def admitted(recent: list[int], at: int, most: int, window_ms: int) -> tuple[list[int], int | None]:
    """The attempts that count after one at ``at`` (milliseconds), and the seconds to wait if it is refused."""
    recent = [t for t in recent if t > at - window_ms]
    if len(recent) >= most:
        return recent, -(-(recent[0] + window_ms - at) // 1000)
    return [*recent, at], None


DECISION = "key string, id long, passed boolean, retry_after_s long"


def limited_stream(attempts: DataFrame, *, most: int = ARCHIVE.rate_attempts, window_s: int = ARCHIVE.rate_window_s, late: str = "0 seconds") -> DataFrame:
    """(key, id, passed, retry_after_s) of a stream of attempts (key, id, at); output mode append.

    The state of a key is the times that passed in the last window, ``most`` at most, and goes when the watermark is a window past the
    last of them. Attempts behind the watermark are dropped; one that comes after a later one of its key has passed is judged at that time.
    """
    use_rocksdb(attempts.sparkSession)
    rows = attempts.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.timestamp_millis(whole_ms(F.col("at"))).alias("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(Limiter(most, window_s), DECISION, "Append", "EventTime")


def limited(attempts: DataFrame, *, most: int = ARCHIVE.rate_attempts, window_s: int = ARCHIVE.rate_window_s) -> DataFrame:
    """The same decisions for a table of attempts (key, id, at), in the order of time (to the nearest millisecond) and id.

    A key's history is cut where nothing came for a window: what lies apart does not depend on each other, so a key of very many
    attempts is many pieces. Pieces are sorted and gone through as a stream; a task holds ``most`` times.
    """
    from pyspark.sql import Window

    rows = attempts.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), whole_ms(F.col("at")).alias("at"))
    w = Window.partitionBy("key").orderBy("at", "id")
    cut = F.coalesce((F.col("at") - F.lag("at").over(w) >= window_s * 1000).cast("int"), F.lit(1))
    pieces = rows.withColumn("cut", cut).withColumn("piece", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = None, []
        for frame in frames:
            waits = []
            for key, piece, at in zip(frame["key"], frame["piece"], frame["at"], strict=True):
                if (key, piece) != now:
                    now, recent = (key, piece), []
                recent, wait = admitted(recent, at, most, window_s * 1000)
                waits.append(wait)
            yield pd.DataFrame({"key": frame["key"], "id": frame["id"], "passed": [x is None for x in waits], "retry_after_s": pd.array(waits, "Int64")})

    return pieces.repartition("key", "piece").sortWithinPartitions("key", "piece", "at", "id").mapInPandas(run, DECISION)


# --- files that are being written ---


class StableFile(StatefulProcessor):
    """Gives a version of a file once it has kept its size and time for ``stable_s``; a path that scans no longer show is forgotten.

    Every scan's rows move the watermark. A path's timer stands one and a half scans after its last sighting, so it fires
    when a scan has come that lacks the path.
    """

    def __init__(self, stable_s: int, scan_s: int):
        self.stable_s, self.scan_ms = stable_s, scan_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.version = handle.getValueState("version", "size long, mtime timestamp, since timestamp, given boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.version.get() if self.version.exists() else (None, None, None, False)
        size, mtime, since, given = held[0], *(pd.Timestamp(t).tz_localize(None) if t is not None else None for t in held[1:3]), held[3]
        out, seen = [], None
        for row in pd.concat(list(rows)).sort_values("seen_at").itertuples(index=False):
            seen = row.seen_at
            if size is None or (row.size, row.mtime) != (size, mtime):
                size, mtime, since, given = row.size, row.mtime, row.seen_at, False
            elif not given and (row.seen_at - since).total_seconds() >= self.stable_s:
                given = True
                out.append((key[0], size, mtime, since))
        self.version.update((int(size), mtime.to_pydatetime(), since.to_pydatetime(), given))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(_utc_ms(seen) + self.scan_ms + self.scan_ms // 2)
        yield pd.DataFrame(out, columns=["path", "size", "mtime", "since"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.version.clear()
        return iter(())

    def close(self) -> None:
        pass


def stable_stream(sightings: DataFrame, *, stable_s: int = ARCHIVE.stable_s, scan_s: int = ARCHIVE.stable_s) -> DataFrame:
    """(path, size, mtime, since) of a stream of scans (path, size, mtime, seen_at), each version once; output mode append.

    A path that a scan lacks is forgotten, and given again, once stable, if it comes back. ``scan_s`` is the time between two scans.
    """
    use_rocksdb(sightings.sparkSession)
    rows = sightings.select("path", F.col("size").cast("long").alias("size"), F.col("mtime").cast("timestamp").alias("mtime"), F.col("seen_at").cast("timestamp").alias("seen_at")).withWatermark("seen_at", "0 seconds")
    return rows.groupBy("path").transformWithStateInPandas(StableFile(stable_s, scan_s), "path string, size long, mtime timestamp, since timestamp", "Append", "EventTime")
