"""Suggestions, folders, index, restore and rank against small cases worked out by hand or another way."""

import datetime as dt
import itertools
import math
import random

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import hierarchy, linkage, naming, processing, relational, search, suggestions
from quillspark.settings import LINKAGE

from test_features import confidence

DAY = dt.datetime(2026, 3, 1, 12)


def scans(spark, rows):
    fields = "id string, user_id long, folder_id string, created_at timestamp, original_filename string, mime_type string, document_date date, vendor string, text_head string, text_tail string, mean_embedding array<float>"
    return spark.createDataFrame(rows, fields)


def scan(i, minutes, name, head=None, tail=None, user=1, vendor=None, vector=None):
    return (f"d{i}", user, None, DAY + dt.timedelta(minutes=minutes), name, "image/png", None, vendor, head, tail, vector)


def test_groups_against_every_pair(spark):
    rows = [
        scan(1, 0, "a_1.png", "Dear all", "runs on to the"),
        scan(2, 1, "a_2.png", "next page of it", "Page 2 of 3"),
        scan(3, 2, "a_3.png", "Page 3 of 3", "end."),
        scan(4, 300, "b.png", "Other GmbH", "bye"),
        scan(5, 301, "c (1).png", None, None, vendor="Shop"),
        scan(6, 301, "zz.png", None, None, user=2, vendor="Shop"),
        scan(7, 7000, "a_4.png"),
        scan(8, 302, "c (2).png", None, None, vendor="Shop Ltd", vector=[1.0, 0.0]),
        scan(9, 303, "c (3).png", None, None, vendor="Else", vector=[0.0, 1.0]),
    ]
    df = scans(spark, rows).repartition(3)
    names = df.columns
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    want = {}
    for a, b in itertools.permutations(dicts, 2):
        if a["user_id"] == b["user_id"] and abs((a["created_at"] - b["created_at"]).total_seconds()) <= LINKAGE.window_s:
            want[a["id"], b["id"]] = confidence(a, b)
    got = {(r["a"], r["b"]): r["confidence"] for r in linkage.score_pairs(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    sets = {i: {i} for i in (r[0] for r in rows)}
    for (a, b), c in want.items():
        if c >= LINKAGE.min_confidence:
            both = sets[a] | sets[b]
            sets |= {i: both for i in both}
    groups = [r for r in linkage.merge_groups(df).collect()]
    for g in groups:
        ids = g["document_ids"]
        assert set(ids) == sets[ids[0]] and len(ids) > 1
        weakest = min(want.get(step, 0.0) for step in itertools.pairwise(ids))
        assert abs(g["confidence"] - weakest) < 1e-9 and weakest >= LINKAGE.min_confidence
    assert ["d1", "d2", "d3"] in [g["document_ids"] for g in groups]


def test_pairs_to_the_microsecond(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(1, 1, t), (2, 1, t + dt.timedelta(seconds=3600.9)), (3, 1, t + dt.timedelta(seconds=3600)), (4, None, t), (5, None, t)], "id long, u long, ts timestamp")
    assert sorted(tuple(r) for r in linkage.band_pairs(df, ["u"], "ts", "id", 3600).collect()) == [(1, 3, 3600.0), (3, 2, 0.9), (4, 5, 0.0)]


def test_candidates_are_recent_scans_with_both_ends(spark):
    docs = spark.createDataFrame(
        [("a", "ready", None, "image/png", DAY), ("b", "ready", DAY, "image/png", DAY), ("c", "failed", None, "image/png", DAY), ("d", "ready", None, "text/plain", DAY), ("e", "ready", None, "application/pdf", DAY - dt.timedelta(days=15)), ("f", "ready", None, "application/pdf", DAY)],
        "id string, status string, deleted_at timestamp, mime_type string, created_at timestamp",
    )
    texts = spark.createDataFrame([("a", "x" * 2000 + "y" * 2000)], "document_id string, text string")
    passages = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [9.0, 9.0])], "document_id string, embedding array<float>")
    got = {r["id"]: r for r in suggestions.load_candidates(docs, texts, passages, "2026-03-02 00:00:00").collect()}
    assert set(got) == {"a", "f"} and got["a"]["text_head"] == "x" * 1500 and got["a"]["text_tail"] == "y" * 1500
    assert got["a"]["mean_embedding"] == [2.0, 4.0] and got["f"]["text_head"] is None and got["f"]["mean_embedding"] is None


def test_suggestions_live_and_die(spark):
    fields = "member_key string, document_ids array<string>, confidence double, band string"
    stored = spark.createDataFrame([("a,b", ["a", "b"], 0.6, "low", "open"), ("c,d", ["c", "d"], 0.9, "high", "dismissed"), ("e,f", ["e", "f"], 0.7, "medium", "open")], fields + ", status string")
    groups = spark.createDataFrame([("a,b", ["b", "a"], 0.8, "medium"), ("c,d", ["c", "d"], 0.5, "low"), ("g,h", ["g", "h"], 0.55, "low")], fields)
    after = {r["member_key"]: (r["document_ids"], r["confidence"], r["status"]) for r in suggestions.written(stored, groups).collect()}
    assert after == {"a,b": (["b", "a"], 0.8, "open"), "c,d": (["c", "d"], 0.9, "dismissed"), "g,h": (["g", "h"], 0.55, "open")}
    docs = spark.createDataFrame([(x, "ready", None) for x in "abcdfgh"] + [("e", "ready", DAY)], "id string, status string, deleted_at timestamp")
    links = spark.createDataFrame([("a,b", "b", "a", 0.8), ("g,h", "g", "h", 0.55)], "member_key string, from_id string, to_id string, heuristic double")
    verdicts = spark.createDataFrame([("g", "h", True, 0.9), ("b", "a", False, 0.1)], "from_id string, to_id string, continues boolean, certainty double")
    shown = suggestions.open_suggestions(suggestions.written(stored, groups), docs, links, verdicts).collect()
    moved = lambda h, x: 1 / (1 + math.exp(-(suggestions.log_odds(h) + 3 * x)))
    assert [(r["member_key"], round(r["confidence"], 9)) for r in shown] == [("g,h", round(moved(0.55, 0.9), 9)), ("a,b", round(moved(0.8, -0.1), 9))]
    assert {r["member_key"] for r in suggestions.live(stored, docs).collect()} == {"a,b", "c,d"}
    keys = spark.createDataFrame([("a,b",), ("c,d",), ("zz",)], "member_key string")
    assert {r["member_key"]: r["status"] for r in suggestions.settled(stored, keys, "merged").collect()} == {"a,b": "merged", "c,d": "dismissed", "e,f": "open"}
    one = stored.select(suggestions.member_key(F.reverse("document_ids")).alias("k"), suggestions.holds(F.col("document_ids"), "c").alias("c")).collect()
    assert [(r["k"], r["c"]) for r in one] == [("a,b", False), ("c,d", True), ("e,f", False)]


def covers(tokens, wanted):
    """All shortest stretches that hold all wanted words, by trying every stretch."""
    full = {(i, j) for i in range(len(tokens)) for j in range(i, len(tokens)) if set(wanted) <= set(tokens[i : j + 1])}
    shortest = [(i, j) for i, j in full if (i + 1, j) not in full and (i, j - 1) not in full]
    return sum(0.1 / (1 + sum(t not in wanted for t in tokens[i : j + 1])) for i, j in shortest)


def test_cover_rank_against_all_stretches(spark):
    rng = random.Random(5)
    rows = [" ".join(rng.choice("abcxyz") for _ in range(rng.randint(0, 14))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").repartition(3)
    for query in ("a", "a b", "a b c", "a b or c"):
        got = {r["i"]: r["s"] for r in df.select("i", search.cover_rank(tx.words(F.col("t")), search.parse_query(query)).alias("s")).collect()}
        for i, t in enumerate(rows):
            assert abs(got[i] - sum(covers(t.split(), way.split()) for way in query.split(" or "))) < 1e-9


def test_index_replaces_a_documents_passages(spark):
    fields = "id string, title string, text string, mime_type string, content_format string"
    one = spark.createDataFrame([("a", "Alpha", "# Head\n\nbody of a", "text/markdown", "markdown"), ("b", None, "plain b", "text/plain", "plain")], fields)
    index = search.index_documents(one, None, tx.embedder())
    rows = {r["document_id"]: r for r in index.collect()}
    assert rows["a"]["heading"] == "Head" and rows["a"]["content"] == "body of a"
    assert all(abs(x - y) < 1e-6 for x, y in zip(rows["a"]["embedding"], tx.hash_embedding("Alpha\nHead\n\nbody of a"), strict=True))
    two = spark.createDataFrame([("b", "B", None, "text/plain", "plain"), ("c", "C", "new", "text/plain", "plain")], fields)
    assert sorted((r["document_id"], r["content"]) for r in search.index_documents(two, index, tx.embedder()).collect()) == [("a", "body of a"), ("c", "new")]


def test_folders_tree_and_entries(spark):
    chain = [("f0", None, "top")] + [(f"f{i}", f"f{i - 1}", f"n{i}") for i in range(1, 36)] + [("x", "y", "x"), ("y", "x", "y"), ("p2", "f0", "page 2"), ("p10", "f0", "page 10")]
    tree = hierarchy.folder_tree(spark.createDataFrame(chain, "id string, parent_id string, name string"))
    assert tree.count() == 38 and tree.agg(F.max("depth")).first()[0] == 36
    kids = {r["id"]: r["children"] for r in hierarchy.nested(tree).collect()}
    assert kids["f0"] == ["f1", "p2", "p10"] and kids["f35"] == []
    docs = spark.createDataFrame([("d1", "p2", "one"), ("d2", None, "two"), ("d3", "gone", "three"), ("d4", "f1", "four")], "id string, folder_id string, title string")
    assert {r["id"]: r["path"] for r in hierarchy.archive_entries(docs, tree).collect()} == {"d1": "top/page 2/one", "d2": "two", "d3": "three", "d4": "top/n1/four"}
    inside = lambda *a: {r["id"] for r in hierarchy.in_folders(docs, tree, *a).collect()}
    assert inside(["f0"]) == {"d1", "d4"} and inside(["f0"], False) == set() and inside([]) == set() and inside(["p2", "nope"], False) == {"d1"}
    moves = spark.createDataFrame([("f1", "f5"), ("f5", "f1"), ("f1", "f1"), ("f1", None), ("f1", "nope"), ("nope", "f1")], "id string, to string")
    assert [r["valid"] for r in sorted(hierarchy.valid_moves(moves, tree).collect(), key=lambda r: (r["id"], r["to"] or ""))] == [True, False, False, False, True, False]


def test_restore_trash_and_orders(spark):
    fields = "id string, user_id long, folder_id string, title string, created_at timestamp, deleted_at timestamp, status string"
    rows = [("a", 1, "f0", "Bill", DAY, DAY, "ready"), ("b", 1, "f0", "bill", DAY, None, "processing"), ("c", 1, "gone", "Bill", DAY, DAY, "failed"), ("d", 1, None, "x", DAY, DAY, "uploaded")]
    docs = spark.createDataFrame(rows, fields)
    tree = hierarchy.folder_tree(spark.createDataFrame([("f0", None, "top")], "id string, parent_id string, name string"))
    after = {r["id"]: (r["folder_id"], r["title"], r["deleted_at"]) for r in naming.restored(docs, spark.createDataFrame([("a",), ("c",), ("b",)], "id string"), tree).collect()}
    assert after == {"a": ("f0", "Bill (2)", None), "b": ("f0", "bill", None), "c": (None, "Bill", None), "d": (None, "x", DAY)}
    assert [r["id"] for r in relational.trash_list(docs.filter("id <> 'c'")).collect()] == ["a", "d"]
    dated = spark.createDataFrame([("b", dt.date(2026, 1, 2)), ("c", None), ("a", dt.date(2026, 1, 2)), ("d", dt.date(2025, 1, 1))], "title string, document_date date")
    assert [r["title"] for r in relational.receipts_order(dated).collect()] == ["d", "a", "b", "c"]


def test_names_of_a_hot_folder_take_no_retries(spark):
    import time

    n = 20_000
    new = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("user_id"), F.lit(None).cast("string").alias("folder_id"), F.lit("Scan").alias("title"), F.lit(DAY).cast("timestamp").alias("created_at"))
    taken = new.limit(1).withColumn("title", F.lit("scan (3)"))
    began = time.time()
    got = {r["new_name"] for r in naming.assign_names(new, taken).collect()}
    assert got == {"Scan", "Scan (2)", *(f"Scan ({k})" for k in range(4, n + 2))}
    assert time.time() - began < 20


def test_resume_reset_and_progress(spark):
    steps = spark.createDataFrame([("a", "text", "running", DAY, 2), ("a", "index", "succeeded", DAY, 1)], "document_id string, step string, status string, started_at timestamp, attempts int")
    assert sorted(tuple(r) for r in processing.resumed(steps).collect()) == [("a", "index", "succeeded", DAY, 1), ("a", "text", "queued", None, 2)]
    entries = spark.createDataFrame([("j", "imported"), ("j", None), ("k", "failed"), ("k", "skipped")], "job_id string, action string")
    assert sorted(tuple(r) for r in processing.import_progress(entries).collect()) == [("j", 2, 1, 0, 0, False), ("k", 2, 0, 1, 1, True)]
    docs = spark.createDataFrame([("a", None, "user", "Me", "5", "user"), ("b", dt.date(2026, 1, 1), "user", "You", None, "auto")], "id string, document_date date, document_date_source string, vendor string, total string, receipt_source string")
    found = spark.createDataFrame([("a", dt.date(2025, 1, 1), None, None)], "id string, document_date date, vendor string, total string")
    got = relational.reset_metadata(docs, found, {"document_date_source": ["document_date"], "receipt_source": ["vendor", "total"]}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", dt.date(2025, 1, 1), "auto", None, None, None), ("b", dt.date(2026, 1, 1), "user", "You", None, "auto")]
