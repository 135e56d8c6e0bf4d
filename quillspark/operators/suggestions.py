"""Merge suggestions as a table: candidates, what is written after a new scoring, what is shown, what users and models decide."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import LINKAGE, Linkage
from .linkage import reconcile, suggestion_confidence
from .search import vector_mean


#: What a reason names as its signal if a model gave it.
MODEL_SIGNAL = "ai"


def mergeable(now: str, s: Linkage = LINKAGE) -> Column:
    """Documents that may be pages of one: ready, not trashed, recent, scans or PDFs."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {s.lookback_days} DAYS")
    paged = (F.col("mime_type") == "application/pdf") | F.col("mime_type").startswith("image/")
    return (F.col("status") == "ready") & F.col("deleted_at").isNull() & paged & (F.col("created_at").cast("timestamp") >= since)


def load_candidates(documents: DataFrame, texts: DataFrame, passages: DataFrame, now: str, s: Linkage = LINKAGE) -> DataFrame:
    """Rows for ``score_pairs``: mergeable documents with both ends of their text and the mean of their passages' vectors.

    ``texts`` has document_id and text, ``passages`` document_id and embedding; documents without either have nulls there.
    """
    own = documents.filter(mergeable(now, s))
    ends = texts.select(F.col("document_id").alias("__t"), F.substring("text", 1, s.ends_chars).alias("text_head"), F.expr(f"right(text, {s.ends_chars})").alias("text_tail"))
    asked = passages.join(own.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    means = vector_mean(asked, "document_id", "embedding").select(F.col("document_id").alias("__m"), F.col("mean").alias("mean_embedding"))
    rows = own.join(ends, F.col("id") == F.col("__t"), "left").join(means, F.col("id") == F.col("__m"), "left")
    return rows.drop("__t", "__m")


def member_key(ids: Column) -> Column:
    """The key of a group: its members in order of their ids, so that the order of pages plays no part."""
    return F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ",")


def holds(ids: Column, document_id) -> Column:
    """Whether a document is a member."""
    return F.array_contains(ids, F.lit(document_id))


def live(suggestions: DataFrame, documents: DataFrame) -> DataFrame:
    """Suggestions all of whose members are still there, ready and not trashed."""
    there = documents.filter("deleted_at is null and status = 'ready'").select(F.col("id").alias("__d"))
    members = suggestions.select("member_key", F.explode("document_ids").alias("__m"))
    lost = members.join(there, F.col("__m") == F.col("__d"), "left_anti").select("member_key").distinct()
    return suggestions.join(lost, "member_key", "left_anti")


def written(stored: DataFrame, groups: DataFrame) -> DataFrame:
    """The stored suggestions after a new scoring: new groups are inserted as open, open ones updated or deleted, settled ones kept.

    Both have member_key, document_ids, confidence and band; ``stored`` also status, which is never changed here.
    """
    plan = reconcile(stored, groups)
    values = ["document_ids", "confidence", "band"]
    kept = stored.join(plan.filter("action = 'keep'").select("member_key"), "member_key", "left_semi")
    old = stored.join(plan.filter("action = 'update'").select("member_key"), "member_key", "left_semi").drop(*values)
    updated = old.join(groups.select("member_key", *values), "member_key")
    fresh = groups.join(plan.filter("action = 'insert'").select("member_key"), "member_key", "left_semi").select("member_key", *values, F.lit("open").alias("status"))
    return kept.select(*stored.columns).unionByName(updated.select(*stored.columns)).unionByName(fresh, allowMissingColumns=True)


def open_suggestions(stored: DataFrame, documents: DataFrame, links: DataFrame, verdicts: DataFrame, s: Linkage = LINKAGE) -> DataFrame:
    """Open suggestions to show, surest first, then the newest, then by id: members alive, and confidence, moved by verdicts on steps, still high enough."""
    moved = suggestion_confidence(links, verdicts, s).select("member_key", F.col("confidence").alias("__c"))
    rows = live(stored.filter("status = 'open'"), documents).join(moved, "member_key", "left").withColumn("confidence", F.coalesce("__c", "confidence")).drop("__c")
    level = F.when(F.col("confidence") >= s.high, "high").when(F.col("confidence") >= s.medium, "medium").otherwise("low")
    return rows.filter(F.col("confidence") >= s.min_confidence).withColumn("band", level).orderBy(F.desc("confidence"), *[F.desc(c) for c in ("created_at",) if c in rows.columns], "id" if "id" in rows.columns else "member_key")


def settled(stored: DataFrame, keys: DataFrame, status: str) -> DataFrame:
    """The suggestions with the open ones of ``keys`` (member_key) dismissed or merged."""
    if status not in ("dismissed", "merged"):
        raise ValueError(f"no decision {status}")
    hit = keys.select("member_key", F.lit(True).alias("__hit")).distinct()
    rows = stored.join(hit, "member_key", "left")
    change = F.col("__hit") & (F.col("status") == "open")
    return rows.withColumn("status", F.when(change, status).otherwise(F.col("status"))).select(*stored.columns)


def verdicts_merged(stored: DataFrame, answers: DataFrame, s: Linkage = LINKAGE) -> tuple[DataFrame, DataFrame]:
    """(the next version of the suggestions, outcomes) once a model's answers about steps have come in.

    ``stored`` has id, user_id, member_key, status, document_ids, links array<struct<fromId, toId, heuristic>>, ai_verdicts
    array<struct<fromId, toId, continues, confidence, reason>>, reasons array<struct<signal, text, points>>, heuristic_confidence and
    confidence. ``answers`` has id, user_id, member_key (as it was when the question was put), from_id, to_id, continues, confidence, reason, answered_at.
    An answer is written only if the suggestion is still open, is still the same set, still has that step, and the step has no answer yet;
    of several answers about a step the first counts (by answered_at, then what they say). Verdicts, confidence
    and reasons change in the same version; other rows and columns stay. Outcomes are (id, from_id, to_id, answered_at, written), one for each answer.
    """
    keys = ["id", "user_id", "member_key"]
    said = F.struct("answered_at", "continues", "confidence", "reason")
    own = stored.filter("status = 'open'").select(*keys, "links", "ai_verdicts")
    is_step = lambda x: (x["fromId"] == F.col("from_id")) & (x["toId"] == F.col("to_id"))
    met = answers.join(own, keys).filter(F.exists("links", is_step) & ~F.exists(F.coalesce("ai_verdicts", F.array()), is_step))
    first = met.groupBy(*keys, "from_id", "to_id").agg(F.min(said).alias("said"))
    verdict = F.struct(F.col("from_id").alias("fromId"), F.col("to_id").alias("toId"), F.col("said.continues").alias("continues"), F.col("said.confidence").alias("confidence"), F.col("said.reason").alias("reason"))
    # a suggestion has few steps, so this group is small
    fresh = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("said.answered_at").alias("at"), verdict.alias("v")))), lambda x: x["v"]).alias("__fresh"))
    rows = stored.join(fresh, keys, "left").withColumn("__hit", F.col("__fresh").isNotNull())
    merged = F.when(F.col("__hit"), F.concat(F.coalesce("ai_verdicts", F.array().cast(fresh.schema["__fresh"].dataType)), "__fresh")).otherwise(F.col("ai_verdicts"))
    rows = rows.withColumn("ai_verdicts", merged)
    scores = combined_scores(F.col("document_ids"), F.col("links"), F.col("ai_verdicts"), F.col("reasons"), s)
    changed = {c: F.when(F.col("__hit"), scores[c]).otherwise(F.col(c)).alias(c) for c in scores}
    after = rows.select(*[changed.get(c, F.col(c)) for c in stored.columns])
    names = ["id", "user_id", "member_key", "from_id", "to_id", "answered_at", "continues", "confidence", "reason"]
    taken = first.select(*[F.col(c if c in first.columns else f"said.{c}").alias(f"__{c}") for c in names], F.lit(True).alias("__taken"))
    on = F.lit(True)
    for c in names:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    outcomes = answers.join(taken, on, "left").select("id", "from_id", "to_id", "answered_at", F.coalesce("__taken", F.lit(False)).alias("written"))
    return after, outcomes


def combined_scores(document_ids: Column, links: Column, verdicts: Column, reasons: Column, s: Linkage = LINKAGE) -> dict[str, Column]:
    """heuristic_confidence, confidence and reasons of a suggestion by rules and verdicts together; as sure as its weakest step."""
    held = lambda h: F.least(F.greatest(h, F.lit(1e-9)), F.lit(1 - 1e-9))
    about = lambda x: F.get(F.filter(verdicts, lambda v: (v["fromId"] == x["fromId"]) & (v["toId"] == x["toId"])), F.lit(0))

    def step(x: Column) -> Column:
        v = about(x)
        return F.when(v.isNull(), x["heuristic"]).otherwise(1 / (1 + F.exp(-(F.log(held(x["heuristic"]) / (1 - held(x["heuristic"]))) + verdict_points(v["continues"], v["confidence"], s)))))

    place = lambda i: F.array_position(document_ids, i).cast("string")
    relation = lambda v: F.when(v["continues"], " goes on from page ").otherwise(" does not go on from page ")
    why = lambda v: F.when(F.coalesce(v["reason"], F.lit("")) != "", F.concat(F.lit(": "), v["reason"])).otherwise("")
    applying = F.filter(verdicts, lambda v: F.exists(links, lambda x: (v["fromId"] == x["fromId"]) & (v["toId"] == x["toId"])))
    told = F.transform(applying, lambda v: F.struct(F.lit(MODEL_SIGNAL).alias("signal"), F.concat(F.lit("model: page "), place(v["toId"]), relation(v), place(v["fromId"]), why(v)).alias("text"), verdict_points(v["continues"], v["confidence"], s).alias("points")))
    every = F.concat(F.filter(reasons, lambda r: r["signal"] != MODEL_SIGNAL), told)
    ordered = F.array_sort(F.transform(every, lambda r, i: F.struct((-r["points"]).alias("minus"), i.alias("i"), r.alias("r"))))
    return {"heuristic_confidence": F.array_min(F.transform(links, lambda x: x["heuristic"])), "confidence": F.array_min(F.transform(links, step)), "reasons": F.transform(ordered, lambda x: x["r"])}


def rule_reasons(reasons: Column) -> Column:
    """struct<supporting, opposing>: the rules' reasons for and against, each the strongest first; what a model said is left out."""
    rules = F.filter(reasons, lambda r: r["signal"] != MODEL_SIGNAL)

    def side(sign: int) -> Column:
        some = F.filter(rules, lambda r: r["points"] * sign > 0)
        return F.transform(F.array_sort(F.transform(some, lambda r, i: F.struct((-r["points"] * sign).alias("k"), i.alias("i"), r.alias("r")))), lambda x: x["r"])

    return F.struct(side(1).alias("supporting"), side(-1).alias("opposing"))


def model_summary(heuristic: Column, verdicts: Column) -> Column:
    """What a model made of a suggestion, in one line; null if it was asked nothing."""
    n, doubts = F.size(verdicts), F.size(F.filter(verdicts, lambda v: ~v["continues"]))
    rules = F.concat(F.lit("rules "), F.floor(heuristic * 100 + 0.5).cast("string"), F.lit("% · model "))
    why = F.when(F.coalesce(F.get(verdicts, F.lit(0))["reason"], F.lit("")) != "", F.concat(F.lit(": "), F.get(verdicts, F.lit(0))["reason"])).otherwise("")
    one = F.concat(F.when(doubts > 0, "doubted").otherwise("confirmed"), why)
    many = F.when(doubts > 0, F.concat(F.lit("doubted "), doubts.cast("string"), F.lit(" of "), n.cast("string"))).otherwise(F.concat(F.lit("confirmed all "), n.cast("string")))
    return F.when(n > 0, F.concat(rules, F.when(n == 1, one).otherwise(F.concat(many, F.lit(" page breaks")))))


def verdict_points(continues: Column, certainty: Column, s: Linkage = LINKAGE) -> Column:
    """What a verdict adds to a step's log odds."""
    return F.when(continues, 1).otherwise(-1) * certainty * s.model_weight


def log_odds(confidence: float) -> float:
    held = min(1 - 1e-9, max(1e-9, confidence))
    return math.log(held / (1 - held))
