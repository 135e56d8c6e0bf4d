"""Operators on small hand-written tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.operators import backup, hierarchy, linkage, naming, processing, relational, search
from quillspark.operators.components import connected_components
from quillspark.operators.filters import SearchFilter, canonical_filter, compile_filter, scoped, table_query

DOCS = "id string, user_id string, folder_id string, title string, original_filename string, mime_type string, document_date date, vendor string, total string, status string, deleted_at timestamp, created_at timestamp, checksum_sha256 string"


def at(minute, day=1):
    return dt.datetime(2026, 5, day, 10, minute)


@pytest.fixture(scope="module")
def docs(spark):
    d = dt.date
    return spark.createDataFrame(
        [
            ("a", "u", "f", "Bill", "bill.pdf", "application/pdf", d(2024, 1, 5), "Acme", "1.00", "ready", None, at(0), "x"),
            ("b", "u", "g", "bill", "bill.pdf", "image/png", None, None, None, "ready", None, at(1), "x"),
            ("c", "u", None, "Note", "note.txt", "text/plain", d(2024, 3, 1), None, None, "pending_upload", None, at(2), None),
            ("d", "u", "f", "Gone", "gone.pdf", "application/pdf", d(2024, 2, 1), None, "2.00", "ready", at(3), at(3), "y"),
            ("e", "v", "f", "Other", "o.pdf", "application/pdf", d(2024, 2, 1), None, None, "ready", None, at(4), "x"),
        ],
        DOCS,
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters(docs):
    own = scoped(docs, "u", status="status")
    assert ids(own) == ["a", "b"]
    assert ids(own.filter(compile_filter(SearchFilter()))) == ["a", "b"]
    assert ids(own.filter(compile_filter(SearchFilter(kinds=("IMAGE",))))) == ["b"]
    assert ids(own.filter(compile_filter(SearchFilter(kinds=())))) == []
    assert ids(own.filter(compile_filter(SearchFilter(folder_ids=())))) == []
    assert ids(own.filter(compile_filter(SearchFilter(date_from="2023-01-01")))) == ["a"]
    assert ids(own.filter(compile_filter(SearchFilter(has_receipt=False)))) == ["b"]
    with pytest.raises(ValueError):
        SearchFilter(date_from="2024-02-30")
    with pytest.raises(ValueError):
        SearchFilter(date_from="2024-02-02", date_to="2024-02-01")
    assert canonical_filter(SearchFilter(kinds=(), has_receipt=False)) == {"hasReceipt": False}
    assert [r["id"] for r in table_query(docs, {"user_id": {"eq": "u"}}, {"title": ("desc", 1)}, 2).collect()] == ["b", "c"]


def test_browse_and_duplicates(docs):
    page = relational.browse(docs, 2)
    assert [r["id"] for r in page.collect()] == ["c", "e", "d"]
    groups = relational.duplicates(docs, "user_id", "checksum_sha256", "id", "created_at").collect()
    assert [r["ids"] for r in groups] == [["a", "b"]]
    found = relational.duplicates_of(docs, ["b", "zz", "c"], "user_id", "checksum_sha256", "id", "created_at").collect()
    assert [(r["id"], r["checked"], r["others"]) for r in found] == [("b", True, ["a"]), ("c", False, [])]


def test_csv(spark):
    rows = spark.createDataFrame([("=1+1", -2.5), ('a"b', None), (" x", 1.0), (None, 3.0)], "t string, n double")
    lines = [r["line"] for r in relational.csv_lines(rows, [("t", False), ("n", True)]).collect()]
    assert lines == ["'=1+1,-2.5\r\n", '"a""b",\r\n', '" x",1.0\r\n', ",3.0\r\n"]


def test_trash(docs):
    left = {r["id"]: r for r in relational.trash_folder(docs, ["f"], "2026-06-01 00:00:00").collect()}
    assert left["a"]["deleted_at"] and left["a"]["folder_id"] is None
    assert left["d"]["deleted_at"] == at(3)
    assert left["c"]["deleted_at"] is None


def test_tree(spark):
    folders = spark.createDataFrame([("1", None, "P", True), ("2", "1", "Q", False), ("3", "2", "R", False), ("4", "9", "Lost", False), ("5", "6", "X", False), ("6", "5", "Y", False)], "id string, parent_id string, name string, mcp_enabled boolean")
    tree = hierarchy.folder_tree(folders, shared="mcp_enabled")
    assert sorted((r["id"], r["path"], r["visible"]) for r in tree.collect()) == [("1", "P", True), ("2", "P/Q", True), ("3", "P/Q/R", True)]
    assert [r["id"] for r in hierarchy.descendants(tree, "2").collect()] == ["2", "3"]
    assert ids(hierarchy.folder_tree(folders, orphans_on_top=True)) == ["1", "2", "3", "4"]
    paths = spark.createDataFrame([("p/q/New/Deep",), ("P/Q",)], "path string")
    assert [r["path"] for r in hierarchy.missing_paths(paths, tree).collect()] == ["p/q/New", "p/q/New/Deep"]


def test_names(spark):
    new = spark.createDataFrame([("n1", "u", None, "Bill", 1), ("n2", "u", None, "bill", 2), ("n3", "u", "f", "Bill", 3)], "id string, user_id string, folder_id string, title string, created_at int")
    taken = spark.createDataFrame([("u", None, "BILL"), ("u", None, "Bill (3)")], "user_id string, folder_id string, title string")
    out = {r["id"]: r["new_name"] for r in naming.assign_names(new, taken).collect()}
    assert out == {"n1": "Bill (2)", "n2": "bill (4)", "n3": "Bill"}
    assert naming.free_name("abcdef", {"abcdef"}, 6) == "ab (2)"


def test_query_language():
    q = search.parse_query('"two words" or alpha -beta')
    assert [[(t.words, t.wanted) for t in way] for way in q] == [[(("two", "words"), True)], [(("alpha",), True), (("beta",), False)]]
    assert search.parse_query("  ") == []


def test_hybrid_search(spark):
    from quillspark.functions.text import hash_embedding

    docs = spark.createDataFrame([("1", "Harbour rules"), ("2", "Garden"), ("3", "Boats")], "id string, title string")
    texts = {"c1": ("1", "ships wait in the harbour"), "c2": ("2", "roses and tulips"), "c3": ("3", "the harbour has boats and ships")}
    chunks = spark.createDataFrame([(c, d, t, hash_embedding(t)) for c, (d, t) in texts.items()], "id string, document_id string, content string, embedding array<float>")
    query = "harbour ships"
    found = search.hybrid_search(docs, chunks, query, hash_embedding(query), min_cosine=0.3).collect()
    assert [r["document_id"] for r in found] == ["1", "3"]
    assert "harbour" in found[0]["snippet"]
    assert search.hybrid_search(docs, chunks, query, hash_embedding(query), allowed=F.col("id") == "3", min_cosine=0.3).collect()[0]["document_id"] == "3"
    with pytest.raises(ValueError):
        search.hybrid_search(docs, chunks, " ", [])


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = {x: root(x) for x in list(parent)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


CANDIDATE = "id string, user_id string, folder_id string, mime_type string, created_at timestamp, original_filename string, document_date date, vendor string, text_head string, text_tail string, mean_embedding array<float>"


def test_linkage_scenario(spark):
    def row(i, second, name, head, tail, date=None, vendor=None, folder="f", hour=9):
        return (i, "u", folder, "application/pdf", dt.datetime(2026, 5, 20, hour, 0) + dt.timedelta(seconds=second), name, date, vendor, head, tail, None)

    rows = [
        row("p1", 0, "scan_001.pdf", "Acme GmbH\nInvoice no 4711-0815\nPage 1 of 3", "goods as listed\nPage 1 of 3", dt.date(2026, 5, 1), "Acme"),
        row("p2", 20, "scan_002.pdf", "Page 2 of 3\n47110815 more", "and more\nPage 2 of 3"),
        row("p3", 40, "scan_003.pdf", "Page 3 of 3\n4711-0815 end", "the end\nPage 3 of 3"),
        row("r1", 9000, "shop_007.pdf", "Kiosk AG\n02.05.2026", "Total 5.00.", dt.date(2026, 5, 2), "Kiosk"),
        row("r2", 9025, "shop_008.pdf", "Bakery Ltd\n03.05.2026", "Total 7.00.", dt.date(2026, 5, 3), "Bakery"),
        row("x1", 0, "far_001.pdf", "one", "one", folder="other"),
    ]
    groups = linkage.merge_groups(spark.createDataFrame(rows, CANDIDATE)).collect()
    assert [(r["document_ids"], r["band"]) for r in groups] == [(["p1", "p2", "p3"], "high")]
    assert linkage.band(0.85) == "high" and linkage.band(0.65) == "medium" and linkage.band(0.6) == "low"
    assert linkage.combined_confidence(0.5, True, 1.0) > 0.95 and linkage.combined_confidence(0.5, None) == 0.5


def test_band_pairs_equal_brute_force(spark):
    rows = [(i, i % 2 or None, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)) for i, s in enumerate([0, 5, 59, 60, 61, 119, 120, 180, 180, 400])]
    got = sorted((r["a"], r["b"]) for r in linkage.band_pairs(spark.createDataFrame(rows, "i int, k int, t timestamp"), ["k"], "t", "i", 60).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and (a[2], a[0]) < (b[2], b[0]) and (b[2] - a[2]).total_seconds() <= 60)
    assert got == want


def test_reconcile(spark):
    stored = spark.createDataFrame([("a,b", "open"), ("c,d", "open"), ("e,f", "dismissed")], "member_key string, status string")
    proposed = spark.createDataFrame([("a,b",), ("e,f",), ("g,h",)], "member_key string")
    assert {r["member_key"]: r["action"] for r in linkage.reconcile(stored, proposed).collect()} == {"a,b": "update", "c,d": "delete", "e,f": "keep", "g,h": "insert"}


def test_pipeline_fold(spark):
    steps = spark.createDataFrame(
        [("1", "inspect", 0, "succeeded", 1), ("1", "text", 1, "skipped", 0), ("2", "inspect", 0, "failed", 2), ("2", "text", 1, "queued", 0), ("3", "inspect", 0, "running", 1)], "document_id string, step string, position int, status string, attempts int"
    )
    out = {r["document_id"]: (r["status"], r["next_step"]) for r in processing.fold_status(steps).collect()}
    assert out == {"1": ("ready", None), "2": ("failed", "inspect"), "3": ("processing", "inspect")}
    ready = spark.createDataFrame([("1", "ready", None)], "id string, status string, deleted_at timestamp")
    assert processing.catch_up(ready, steps, ("inspect", "text", "index")).collect()[0]["step"] == "index"
    assert {r["document_id"]: r["status"] for r in processing.retry(steps.filter("position = 0"), ["2"]).collect()}["2"] == "queued"


def test_backup_round_trip(spark):
    import hashlib

    from quillspark.sources.tar import entries, pack

    sha = lambda b: hashlib.sha256(b).hexdigest()
    files = [("originals/a.txt", b"one"), ("originals/ü.txt", b"two"), ("originals/copy.txt", b"one")]
    assert [(n, c) for n, _, c in entries(pack(files))] == files
    manifest = spark.createDataFrame([(p, sha(c)) for p, c in files] + [("originals/missing", sha(b"zz")), ("originals/known", sha(b"k"))], "path string, checksum_sha256 string")
    existing = spark.createDataFrame([(sha(b"k"),)], "checksum_sha256 string")
    plan = {r["path"].split("/")[1]: r["action"] for r in backup.import_plan(manifest, spark.createDataFrame(files, "path string, content binary"), existing).collect()}
    assert plan == {"a.txt": "imported", "copy.txt": "skipped", "ü.txt": "imported", "missing": "failed", "known": "skipped"}

