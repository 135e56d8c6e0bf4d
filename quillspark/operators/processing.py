"""The per-document pipeline as data: fold of step rows, counts, queues, catch-up, retry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..session import Scratch

# The steps in their order.
STEPS = ("inspect", "text", "ocr", "pdf-text", "ebook", "vision", "metadata", "index", "thumbnail")
DONE = ("succeeded", "skipped")


def _status(failed: Column, done: Column, running: Column) -> Column:
    return F.when(failed, "failed").when(done, "ready").when(running, "processing").otherwise("uploaded")


def fold_status(steps: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, status, next_step, done, attempts): what the rows of a document's steps come to.

    A failed step fails the document; else all done is ready; else a running step is processing; else it waits.
    """
    first_open = F.min(F.when(~F.col("status").isin(*DONE), F.struct("position", "step")))
    return steps.groupBy(document).agg(
        _status(F.bool_or(F.col("status") == "failed"), F.bool_and(F.col("status").isin(*DONE)), F.bool_or(F.col("status") == "running")).alias("status"),
        first_open["step"].alias("next_step"),
        F.count_if(F.col("status").isin(*DONE)).alias("done"),
        F.sum("attempts").alias("attempts"),
    )


def step_status(steps: list[tuple[int, str, str, str | None, int]]) -> tuple[str, str | None, int, int, str | None]:
    """(status, next step, done, attempts, error of the first failed step) of one document's steps: (position, step, status, error, attempts)."""
    rows = sorted(steps)
    states = {r[2] for r in rows}
    status = "failed" if "failed" in states else "ready" if states <= set(DONE) else "processing" if "running" in states else "uploaded"
    next_step = next((r[1] for r in rows if r[2] not in DONE), None)
    return status, next_step, sum(r[2] in DONE for r in rows), sum(r[4] for r in rows), next((r[3] for r in rows if r[2] == "failed"), None)


def fold_step_events(events: DataFrame, names: tuple[str, ...] = STEPS, place: str | None = None) -> DataFrame:
    """(document_id, status, next_step, done, attempts, error) of a table of step events, see ``streaming.processors.step_stream``.

    Of a step's events the last by (at, seq) decides, none being the last of all, of equal ones the first by the column ``place``
    (without it, the least by status and error); a plan is an event of every step.

    Events are shuffled once, by document, as they are (a plan is one row, not one for each step), and sorted by document there.
    """
    planned, at = F.col("kind") == "planned", F.col("at")
    status = F.when(F.col("kind") == "started", "running").otherwise(F.col("kind"))
    place_of = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("step"))
    number = F.when(planned, -1).when(place_of > 0, place_of - 1).cast("int")  # null: a step of another name
    queued = sum((F.when(F.array_contains("steps", n), F.lit(1 << i)).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    # time and number fall as they rise, so that the least row is the last
    late = F.expr("timestamp_ntz'1970-01-01'") - at if events.schema["at"].dataType == TimestampNTZType() else F.bitwise_not(F.unix_micros(at))
    rows = events.select(
        "document_id",
        number.alias("number"),
        F.when(number.isNull(), F.col("step")).alias("other"),
        F.when(planned, queued).alias("queued"),
        late.alias("late"),
        F.bitwise_not("seq").alias("seq"),
        (F.col(place) if place else F.lit(0)).alias("place"),
        status.alias("status"),
        F.when(status == "failed", F.col("error")).alias("error"),
    ).repartition("document_id")
    told = lambda s: F.struct("late", "seq", "place", s.alias("status"), "error")
    plan = lambda i: F.when(F.col("queued").bitwiseAND(1 << i) > 0, "queued").otherwise("skipped")
    last = [F.min(F.when(F.col("number") == i, told(F.col("status"))).when(F.col("number") == -1, told(plan(i)))).alias(f"s{i}") for i in range(len(names))]
    last.append(F.min(F.when(F.col("number").isNull(), told(F.col("status")))).alias("s_other"))
    steps = rows.groupBy("document_id", F.col("number").isNotNull().alias("known"), "other").agg(*last, F.count_if(F.col("status") == "running").alias("attempts"))
    each = [(F.lit(i), F.lit(n), F.col(f"s{i}")) for i, n in enumerate(names)] + [(F.lit(len(names)), F.col("other"), F.col("s_other"))]
    done = lambda s: s["status"].isin(*DONE)
    # greatest and least pass over the steps that a document has no events of
    parts = steps.select(
        "document_id",
        F.greatest(*[s["status"] == "failed" for _, _, s in each]).alias("failed"),
        F.least(*[done(s) for _, _, s in each]).alias("ready"),
        F.greatest(*[s["status"] == "running" for _, _, s in each]).alias("running"),
        F.least(*[F.when(~done(s), F.struct(i.alias("position"), n.alias("step"))) for i, n, s in each]).alias("open"),
        sum((F.when(done(s), 1).otherwise(0) for _, _, s in each), F.lit(0)).alias("done"),
        "attempts",
        F.least(*[F.when(s["status"] == "failed", F.struct(i.alias("position"), n.alias("step"), s["error"].alias("error"))) for i, n, s in each]).alias("error"),
    )
    return parts.groupBy("document_id").agg(
        _status(F.bool_or("failed"), F.bool_and("ready"), F.bool_or("running")).alias("status"),
        F.min("open")["step"].alias("next_step"),
        F.sum("done").alias("done"),
        F.sum("attempts").alias("attempts"),
        F.min("error")["error"].alias("error"),
    )


def catch_up(documents: DataFrame, steps: DataFrame, names: tuple[str, ...] = STEPS) -> DataFrame:
    """(id, step, position): steps that ready documents have no row of."""
    wanted = documents.filter("status = 'ready' and deleted_at is null").select("id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("position", "step"))
    return wanted.join(steps.select(F.col("document_id").alias("id"), "step"), ["id", "step"], "left_anti").select("id", "step", "position")


def retry(steps: DataFrame, document_ids: list[str], all_steps: bool = False) -> DataFrame:
    """Step rows with the failed ones (or all) of the documents queued again."""
    hit = F.col("document_id").isin(*document_ids) & (F.lit(True) if all_steps else F.col("status") == "failed")
    clear = lambda c, v: F.when(hit, F.lit(v)).otherwise(F.col(c)).alias(c)
    return steps.select(*[clear(c, "queued") if c == "status" else F.when(~hit, F.col(c)).alias(c) if c in ("error", "started_at", "finished_at") else F.col(c) for c in steps.columns])


def queue_counts(documents: DataFrame, steps: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """One row: running, queued, failed, and finished within the last hours (ready, by the last step's end)."""
    last = steps.groupBy(F.col("document_id").alias("id")).agg(F.max("finished_at").alias("last"))
    rows = documents.filter("deleted_at is null").join(last, "id", "left")
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    return rows.agg(
        F.count_if(F.col("status") == "processing").alias("running"), F.count_if(F.col("status") == "uploaded").alias("queued"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("status") == "ready") & (F.col("last") >= since)).alias("finished")
    )


def enabled_steps(mime: Column, ocr: bool = False, vision: bool = False) -> Column:
    """Which steps run for a media type; the others are skipped."""
    pdf, image = mime == "application/pdf", mime.startswith("image/")
    epub = mime == "application/epub+zip"
    rules = {"inspect": F.lit(True), "text": mime.startswith("text/"), "ocr": (pdf | image) & F.lit(ocr), "pdf-text": pdf & F.lit(not ocr), "ebook": epub, "vision": (pdf | image) & F.lit(vision), "metadata": F.lit(True), "index": F.lit(True), "thumbnail": pdf | image | epub}
    return F.filter(F.array(*[F.when(rules[s], F.lit(s)) for s in STEPS]), lambda s: s.isNotNull())


def merge_documents(pages: DataFrame, key: str = "merge_id", position: str = "position", text: str = "text") -> DataFrame:
    """(key, text, format): texts of merged documents in page order, with blank lines between; Markdown only if all are."""
    rows = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(position, text))).alias("p"), F.bool_and(F.col("content_format") == "markdown").alias("md"))
    texts = F.filter(F.transform("p", lambda x: x[text]), lambda t: t.isNotNull() & (t != ""))
    return rows.select(key, F.array_join(texts, "\n\n").alias("text"), F.when(F.col("md"), "markdown").otherwise("plain").alias("content_format"))


def resumed(steps: DataFrame) -> DataFrame:
    """Step rows after a stop of the service: what was running waits again, its start is forgotten and the attempt counts."""
    cut = F.col("status") == "running"
    return steps.select(*[F.when(cut, F.lit("queued")).otherwise(F.col(c)).alias(c) if c == "status" else F.when(~cut, F.col(c)).alias(c) if c == "started_at" else F.col(c) for c in steps.columns])


def import_progress(entries: DataFrame, key: str = "job_id") -> DataFrame:
    """(job, total, imported, skipped, failed, finished): where each import stands; ``action`` is null while an entry waits."""
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return entries.groupBy(key).agg(F.count("*").alias("total"), count("imported"), count("skipped"), count("failed"), F.bool_and(F.col("action").isNotNull()).alias("finished"))


@dataclass(frozen=True)
class Step:
    """One stage of the processing of documents: over which it runs, and what it makes of them.

    ``enabled`` is a predicate over documents as earlier steps left them; the others skip the step. ``run`` takes the documents and returns
    them with the columns that it fills changed, and, if it can fail, a column ``error``, null where it did not. A step
    that ``extracts_text`` is skipped for documents that are merged from finished ones.
    """

    name: str
    enabled: Callable[[], Column]
    run: Callable[[DataFrame], DataFrame]
    extracts_text: bool = False


def run_steps(documents: DataFrame, steps: list[Step], done: DataFrame | None = None, merged: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, outcomes) after all steps in order; outcomes are (document_id, step, position, status, error).

    A document whose step fails stays as it was before it and is not touched by later steps, which have no outcome for it. What ``done``
    (document_id, step, status) tells as succeeded or skipped is not run again, so a second call picks up what failed. ``merged`` says which
    documents came by a merge and have their text. Each step's rows are written before the next one runs, so none runs twice.
    """
    columns = documents.columns
    scratch, now = Scratch(documents.sparkSession), documents.withColumn("__failed", F.lit(False))
    outcomes = None
    for position, step in enumerate(steps):
        if done is not None:
            past = done.filter((F.col("step") == step.name) & F.col("status").isin(*DONE)).select(F.col("document_id").alias("__past")).distinct()
            now = now.join(past, F.col("id") == F.col("__past"), "left")
        else:
            now = now.withColumn("__past", F.lit(None).cast(documents.schema["id"].dataType))
        waits = ~F.col("__failed") & F.col("__past").isNull()
        on = F.coalesce(step.enabled(), F.lit(False))
        if step.extracts_text and merged is not None:
            on = on & ~F.coalesce(merged, F.lit(False))
        here = scratch.result(now.withColumn("__do", F.when(waits, F.when(on, "run").otherwise("skip"))).drop("__past"), step.name)
        before = here.filter("__do = 'run'").select(*columns)
        made = step.run(before)
        made = scratch.result(made if "error" in made.columns else made.withColumn("error", F.lit(None).cast("string")), step.name)
        told = made.select(F.col("id").alias("document_id"), F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), "error")
        told = told.unionByName(here.filter("__do = 'skip'").select(F.col("id").alias("document_id"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error")))
        told = told.select("document_id", F.lit(step.name).alias("step"), F.lit(position).alias("position"), "status", "error")
        outcomes = told if outcomes is None else outcomes.unionByName(told)
        good = made.filter("error is null").select(*columns, F.lit(False).alias("__failed"))
        bad = before.join(made.filter("error is not null").select("id"), "id", "left_semi").select(*columns, F.lit(True).alias("__failed"))
        rest = here.filter("__do is null or __do = 'skip'").select(*columns, "__failed")
        now = rest.unionByName(good).unionByName(bad)
    return now.select(*columns), outcomes
