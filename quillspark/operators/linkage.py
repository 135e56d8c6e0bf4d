"""Record linkage: does document B continue document A? Pairs, scores, groups, verdicts, reconciliation. Signals are in ``features``."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from ..settings import LINKAGE, Linkage
from .components import connected_components
from .features import scored, with_features


def band_pairs(rows: DataFrame, keys: list[str], time: str, id_col: str, window_s: int, ordered: bool = False) -> DataFrame:
    """(a, b, gap_s) of rows with equal keys (nulls equal) at most ``window_s`` seconds apart, to the microsecond.

    Rows are put in buckets as wide as the window; each is sent to its own and the next one, so the join is an
    equi-join, and a pair meets once. ``ordered`` gives both directions.
    """
    window = window_s * 1_000_000
    t = F.unix_micros(F.col(time).cast("timestamp"))
    r = rows.withColumn("__t", t).withColumn("__b", F.floor(F.col("__t") / window))
    key = lambda s: [F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(f"__{s}{i}") for i, k in enumerate(keys)]
    left = r.select(F.col(id_col).alias("a"), F.col("__t").alias("ta"), F.explode(F.array("__b", F.col("__b") + 1)).alias("bucket"), F.col("__b").alias("ba"), *key("l"))
    right = r.select(F.col(id_col).alias("b"), F.col("__t").alias("tb"), F.col("__b").alias("bb"), *key("r"))
    on = (F.col("bucket") == F.col("bb")) & functools.reduce(lambda x, y: x & y, [F.col(f"__l{i}") == F.col(f"__r{i}") for i in range(len(keys))], F.lit(True))
    met = left.join(right, on).filter((F.col("tb") - F.col("ta")).between(0, window) | ((F.col("ba") == F.col("bb")) & (F.abs(F.col("tb") - F.col("ta")) <= window)))
    # one orientation: earlier first, ids break ties
    one = met.filter((F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") < F.col("b")))).select("a", "b", ((F.col("tb") - F.col("ta")) / 1_000_000).alias("gap_s"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("gap_s")).alias("gap_s"))) if ordered else one


def band(confidence: float, s: Linkage = LINKAGE) -> str:
    return "high" if confidence >= s.high else "medium" if confidence >= s.medium else "low"


def score_pairs(candidates: DataFrame, s: Linkage = LINKAGE, features: DataFrame | None = None) -> DataFrame:
    """(a, b, confidence, points, reasons) for both directions of all pairs in one owner's folder within the window.

    ``features`` are those of the candidates; without them they are read and written first, so that no text is read twice. Pairs are
    compared by columns.
    """
    pageable = candidates.filter((F.col("mime_type") == "application/pdf") | F.col("mime_type").startswith("image/"))
    if features is None:
        features = Scratch(candidates.sparkSession).result(with_features(pageable, s), "features")
    return scored(band_pairs(pageable, ["user_id", "folder_id"], "created_at", "id", s.window_s, ordered=True), features, s)


def page_order(rows: list[dict]) -> list[dict]:
    """By the page they begin on where both show one, else by place in one series of names, else by time, then id; from (time, id) order."""

    def place(x: dict, y: dict) -> float:
        if pd.notna(x["number"]) and pd.notna(y["number"]) and x["is_copy"] == y["is_copy"] and x["stem"] == y["stem"]:
            return x["number"] - y["number"]
        if y["is_copy"] and y["stem"] == x["name"]:
            return -y["number"]
        return x["number"] if x["is_copy"] and x["stem"] == y["name"] else 0

    def compare(x: dict, y: dict) -> float:
        pages = x["start_page"] - y["start_page"] if pd.notna(x["start_page"]) and pd.notna(y["start_page"]) else 0
        kx, ky = (x["created_at"], x["id"]), (y["created_at"], y["id"])
        return pages or place(x, y) or (-1 if kx < ky else int(kx > ky))

    return sorted(sorted(rows, key=lambda r: (r["created_at"], r["id"])), key=functools.cmp_to_key(compare))


def merge_groups(candidates: DataFrame, s: Linkage = LINKAGE) -> DataFrame:
    """(document_ids in page order, confidence, band, reasons, links) of every proposed group, best first."""
    with Scratch(candidates.sparkSession) as scratch:
        pageable = candidates.filter((F.col("mime_type") == "application/pdf") | F.col("mime_type").startswith("image/"))
        features = scratch.keep(with_features(pageable, s), "features")
        return scratch.result(_groups(features, scratch.keep(score_pairs(candidates, s, features), "scored"), scratch, s), "groups")


def _groups(features: DataFrame, scored: DataFrame, scratch: Scratch, s: Linkage) -> DataFrame:
    edges = scored.filter(F.col("confidence") >= s.min_confidence).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    groups = connected_components(edges, scratch=scratch)
    member = features.select("id", "created_at", "name", "stem", "number", "is_copy", "start_page").join(groups, F.col("id") == F.col("node"))
    schema = "component string, document_ids array<string>"

    def order(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"component": [frame["component"].iloc[0]], "document_ids": [[r["id"] for r in page_order(frame.to_dict("records"))]]})

    ordered = member.groupBy("component").applyInPandas(order, schema)
    steps = ordered.select("component", "document_ids", F.posexplode(F.arrays_zip(F.slice("document_ids", 1, F.size("document_ids") - 1).alias("a"), F.slice("document_ids", 2, F.size("document_ids") - 1).alias("b"))).alias("i", "s")).select("component", "document_ids", "i", "s.a", "s.b")
    rows = steps.join(scored, ["a", "b"], "left").groupBy("component", "document_ids").agg(
        F.min(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.array_sort(F.collect_list(F.struct("i", "a", "b", F.col("confidence").alias("heuristic"), "reasons"))).alias("links"),
    )
    kept = rows.filter(F.col("confidence") >= s.min_confidence)
    level = F.when(F.col("confidence") >= s.high, "high").when(F.col("confidence") >= s.medium, "medium").otherwise("low")
    return kept.select("document_ids", "confidence", level.alias("band"), F.array_distinct(F.flatten(F.transform("links", lambda x: x["reasons"]))).alias("reasons"), F.transform("links", lambda x: F.struct(x["a"].alias("fromId"), x["b"].alias("toId"), x["heuristic"].alias("heuristic"))).alias("links")).orderBy(F.desc("confidence"), "document_ids")


def combined_confidence(heuristic: float, continues: bool | None, certainty: float = 0.0, s: Linkage = LINKAGE) -> float:
    """A rule's confidence moved by a verdict, in log odds."""
    if continues is None:
        return heuristic
    h = min(1 - 1e-9, max(1e-9, heuristic))
    x = math.log(h / (1 - h)) + s.model_weight * certainty * (1 if continues else -1)
    return 1 / (1 + math.exp(-x))


def suggestion_confidence(links: DataFrame, verdicts: DataFrame, s: Linkage = LINKAGE) -> DataFrame:
    """(member_key, heuristic_confidence, confidence): the weakest step, without and with verdicts on steps."""
    h = F.least(F.greatest(F.col("heuristic"), F.lit(1e-9)), F.lit(1 - 1e-9))
    moved = F.log(h / (1 - h)) + s.model_weight * F.col("certainty") * F.when(F.col("continues"), 1).otherwise(-1)
    both = links.join(verdicts, ["from_id", "to_id"], "left").withColumn("c", F.when(F.col("continues").isNull(), F.col("heuristic")).otherwise(1 / (1 + F.exp(-moved))))
    return both.groupBy("member_key").agg(F.min("heuristic").alias("heuristic_confidence"), F.min("c").alias("confidence"))


def reconcile(stored: DataFrame, proposed: DataFrame, key: str = "member_key") -> DataFrame:
    """(key, action): new proposals are inserted, open ones updated or deleted; what a user settled is kept."""
    both = stored.select(key, "status").join(proposed.select(key, F.lit(True).alias("proposed")), key, "full")
    action = F.when(F.col("status").isNull(), "insert").when(F.col("status") != "open", "keep").when(F.col("proposed"), "update").otherwise("delete")
    return both.select(key, action.alias("action"))


def steps_to_ask(links: DataFrame, verdicts: DataFrame, failures: DataFrame, now: str, s: Linkage = LINKAGE) -> DataFrame:
    """Steps in the model's band without a verdict and without a failure in the last half hour."""
    recent = failures.filter(F.col("failed_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {s.retry_s} SECONDS")).select("from_id", "to_id")
    return links.filter(F.col("heuristic").between(s.model_low, s.model_high)).join(verdicts.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").join(recent, ["from_id", "to_id"], "left_anti")
