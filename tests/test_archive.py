"""Exports, manifests, names, trees, uploads, queues and verdicts against rules written out by hand."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import heading_passages
from quillspark.operators import backup, hierarchy, naming, relational, suggestions

DAY = dt.datetime(2026, 3, 1, 12)


def by_hand(docs):
    """Paths handed out one after the other."""
    out = {}
    for kind in ("original", "archive", "text"):
        taken = set()
        for d in sorted(docs, key=lambda d: (d["created_at"], d["id"])):
            if kind != "original" and d[f"{'archive' if kind == 'archive' else 'content'}_key"] is None:
                continue
            base = f"F/{d['title']}" if d["folder_id"] else d["title"]
            file = d["original_filename"]
            ending = file[file.rindex(".") :].lower() if "." in file[1:] else ""
            end = {"original": "" if d["title"].lower().endswith(ending) else ending, "archive": ".pdf", "text": ".md" if d["content_format"] == "markdown" else ".txt"}[kind]
            path = base + end
            if path.lower() in taken:
                path = f"{base} ({d['id'][:8]}){end}"
            taken.add(path.lower())
            out[d["id"], kind] = {"original": "originals/", "archive": "archive/", "text": "text/"}[kind] + path
    return out


def test_export_paths_are_those_handed_out_in_order(spark):
    rng, docs = random.Random(4), []
    for i in range(150):
        key = f"{i * 7919 % 1000:03}"
        earlier = rng.choice(docs)["id"][:8] if docs else "x"
        title = rng.choice(["a", "A", "a.pdf", "b", f"a ({earlier})", f"b ({earlier})", ".x"])
        docs.append({"id": f"{key}-{i:06}", "title": title, "folder_id": rng.choice([None, "f"]), "original_filename": rng.choice(["a.pdf", "b.PDF", "noend", "x.tar.gz"]), "status": "ready", "created_at": DAY + dt.timedelta(seconds=rng.randint(0, 60)), "deleted_at": None, "archive_key": rng.choice([None, "k"]), "content_key": rng.choice([None, "k"]), "content_format": rng.choice(["markdown", "plain"])})
    types = "id string, title string, folder_id string, original_filename string, status string, created_at timestamp, deleted_at timestamp, archive_key string, content_key string, content_format string"
    df = spark.createDataFrame([tuple(d.values()) for d in docs] + [("t", "a", None, "a.pdf", "ready", DAY, DAY, None, None, None), ("u", "a", None, "a.pdf", "pending_upload", DAY, None, None, None, None)], types).repartition(4)
    plan = backup.export_plan(df, spark.createDataFrame([("f", "F")], "id string, path string")).collect()
    got = {(r.id, k): r[f"{k}_path"] for r in plan for k in ("original", "archive", "text") if r[f"{k}_path"] is not None}
    assert got == by_hand(docs)
    assert len({p.lower() for p in got.values()}) > 100


def document(**change):
    doc = {"id": "1", "title": "t", "folder": None, "originalFilename": "a.pdf", "mimeType": "application/pdf", "sizeBytes": 5, "checksumSha256": None, "status": "ready", "ocrRequested": False, "createdAt": "x", "documentDate": None, "documentDateSource": None, "vendor": None, "total": "1.50", "currency": "EUR", "receiptSource": "user"}
    return doc | {"files": {"original": "o", "archive": None, "text": None}} | change


def manifest(*documents, **change):
    return {"format": backup.FORMAT, "version": 1, "exportedAt": "2026-01-01T00:00:00.000Z", "folders": [], "documents": list(documents)} | change


def test_manifests_are_checked_field_by_field(spark):
    no_title = document()
    del no_title["title"]
    texts = {
        "good": json.dumps(manifest(document(id="7", documentDate="2024-02-29", extra=[1]), folders=[{"path": "A/B", "mcpEnabled": True}, {"path": "A", "mcpEnabled": False}])),
        "empty": json.dumps(manifest()),
        "text": "not json",
        "nothing": "",
        "null": None,
        "list": "[1]",
        "format": json.dumps(manifest(document(), format="other")),
        "version": json.dumps(manifest(version="1")),
        "later": json.dumps(manifest(version=2)),
        "folders": json.dumps(manifest(folders=[{"path": "", "mcpEnabled": True}, {"path": "x"}, {"path": "y", "mcpEnabled": "yes"}])),
        "fields": json.dumps(manifest(document(), document(id=5), document(sizeBytes=-1), document(sizeBytes=1.5), document(documentDate="2023-02-29"), document(receiptSource="guess"), document(files={"original": "o", "archive": None}), no_title, document(ocrRequested="no", vendor=3))),
    }
    df = spark.createDataFrame(list(texts.items()), "archive string, text string")
    documents, folders, errors = backup.read_manifests(df)
    kept = documents.collect()
    assert [(r.archive, r.place, r.id) for r in sorted(kept, key=lambda r: r.archive)] == [("fields", "documents[0]", "1"), ("good", "documents[0]", "7")]
    good = next(r for r in kept if r.archive == "good")
    assert good.documentDate == dt.date(2024, 2, 29) and good.sizeBytes == 5 and good.files_original == "o" and good.files_text is None and good.total == "1.50"
    assert [(r.path, r.mcpEnabled) for r in folders.orderBy("depth", "path").collect() if r.archive == "good"] == [("A", False), ("A/B", True)]
    found = {}
    for r in errors.collect():
        found.setdefault(r.archive, []).append((r.place, r.problem))
    assert {k for k in found} == {"text", "nothing", "null", "list", "format", "version", "later", "folders", "fields"}
    assert all(len(found[k]) == 1 and found[k][0][0] == "manifest" for k in ("text", "nothing", "null", "list", "format", "version", "later"))
    assert sorted(found["folders"]) == [("folders[0]", "path is no text of one character or more"), ("folders[1]", "mcpEnabled is missing"), ("folders[2]", "mcpEnabled is neither true nor false")]
    assert sorted(found["fields"]) == [
        ("documents[1]", "id is no text"),
        ("documents[2]", "sizeBytes is no whole number from 0"),
        ("documents[3]", "sizeBytes is no whole number from 0"),
        ("documents[4]", "documentDate is no calendar day"),
        ("documents[5]", "receiptSource is none of extracted, user"),
        ("documents[6]", "files.text is missing"),
        ("documents[7]", "title is missing"),
        ("documents[8]", "ocrRequested is neither true nor false"),
        ("documents[8]", "vendor is no text"),
    ]


def test_a_written_manifest_is_read_again(spark):
    types = "id string, title string, folder_id string, original_filename string, mime_type string, size_bytes long, checksum_sha256 string, status string, ocr_requested boolean, created_at timestamp, deleted_at timestamp, document_date date, document_date_source string, vendor string, total string, currency string, receipt_source string, archive_key string, content_key string, content_format string"
    docs = spark.createDataFrame([("a", 'T "x"', "f", "a.pdf", "application/pdf", 9, None, "ready", True, DAY, None, dt.date(2024, 1, 2), "user", "V", "1.00", "EUR", "extracted", "k", None, None)], types)
    tree = spark.createDataFrame([("f", "In/Out")], "id string, path string")
    line = backup.manifest_documents(backup.export_plan(docs, tree), tree).first()["line"]
    text = json.dumps(manifest()).replace('"documents": []', f'"documents": [{line}]')
    documents, _, errors = backup.read_manifests(spark.createDataFrame([("m", text)], "archive string, text string"))
    row = documents.first()
    assert errors.count() == 0 and row.title == 'T "x"' and row.folder == "In/Out" and row.files_original == "originals/In/Out/T _x_.pdf" and row.files_archive == "archive/In/Out/T _x_.pdf" and row.files_text is None and row.ocrRequested


def in_order(new, taken, most):
    used, out = {}, {}
    for owner, folder, title in taken:
        used.setdefault((owner, folder), set()).add((title or "").lower())
    for i, owner, folder, title in new:
        names = used.setdefault((owner, folder), set())
        out[i] = naming.free_name(title or "", names, most)
        names.add(out[i].lower())
    return out


@pytest.mark.parametrize("span", [5, 4096])
def test_names_are_those_given_in_order(spark, monkeypatch, span):
    monkeypatch.setattr(naming, "_SPAN", span)
    rng = random.Random(span)
    names = ["Scan", "scan", "Scan (2)", "Scan (3)", "Scan (07)", "Bill", "Bill ", "bill (12)", "x" * 40, "", "Doc (1)", "Doc", None]
    new = [(i, rng.randint(0, 1), rng.choice([None, "f", "g"]), rng.choice(["Bill"] * 5 + names if i % 3 == 0 and span == 5 else ["Bill", "Doc", "x" * 40, "Scan"])) for i in range(300)]
    taken = [(rng.randint(0, 1), rng.choice([None, "f", "g"]), rng.choice([*names, f"Bill ({rng.randint(2, 60)})", f"Scan ({rng.randint(2, 40)})"])) for _ in range(60)]
    rows = spark.createDataFrame(new, "created_at long, user_id long, folder_id string, title string").repartition(5)
    held = spark.createDataFrame(taken, "user_id long, folder_id string, title string")
    assert {r.created_at: r.new_name for r in naming.assign_names(rows, held, most=50).collect()} == in_order(new, taken, 50)


def test_a_number_fits_and_blanks_before_it_go():
    assert naming.free_name("ab   ", {"ab   "}) == "ab (2)"
    assert naming.free_name("abc defgh", {"abc defgh"}, 9) == "abc d (2)" and naming.free_name("abcd efgh", {"abcd efgh"}, 9) == "abcd (2)"


def test_a_hot_name_is_no_task_of_its_own(spark):
    n = 200_000
    new = spark.range(0, n, 1, 8).selectExpr("id", "1 AS user_id", "CAST(NULL AS STRING) AS folder_id", "'Scan' AS title", "id AS created_at")
    taken = spark.range(2, 50_000, 2).selectExpr("1 AS user_id", "CAST(NULL AS STRING) AS folder_id", "concat('SCAN (', id, ')') AS title")
    named = naming.assign_names(new, taken)
    got = {r.id: r.new_name for r in named.filter("id in (0, 1, 24999, 25000, 199999)").collect()}
    assert got == {0: "Scan", 1: "Scan (3)", 24999: "Scan (49999)", 25000: "Scan (50000)", 199999: f"Scan ({n + 24999})"}
    assert named.select("new_name").distinct().count() == n


def test_one_tree_of_files_and_folders(spark):
    entries = [("b/file10.md", "file"), ("b/file2.md", "file"), ("/a//x/", "dir"), ("b", "file"), ("b", "dir"), ("c", "dir"), ("//", "dir"), ("b/Sub/deep.md", "file"), ("top", "file")]
    rows = hierarchy.entry_tree(spark.createDataFrame(entries, "path string, type string")).orderBy("place").collect()
    assert [(r.path, r.type, r.made) for r in rows] == [
        ("a", "dir", True), ("a/x", "dir", False), ("b", "dir", False), ("b/Sub", "dir", True), ("b/Sub/deep.md", "file", False), ("b/file2.md", "file", False), ("b/file10.md", "file", False), ("c", "dir", False), ("b", "file", False), ("top", "file", False),
    ]
    assert [(r.name, r.parent, r.depth) for r in rows if r.path == "b/Sub/deep.md"] == [("deep.md", "b/Sub", 3)]


def test_uploads_refuse_the_outermost_folder(spark):
    files = ["T/2026/a.pdf", "T/ok/.hidden", "T/Thumbs.db", "T/@eaDir/a.jpg", "T/b?d/in?/x.pdf", "T/b?d/y.pdf", "~$lock.docx", "z.pdf", "/T//c.pdf", "T/.git/x", ""]
    accepted, refused = hierarchy.upload_plan(spark.createDataFrame([(p,) for p in files], "path string"))
    assert sorted((r.name, r.folder) for r in accepted.collect()) == [("a.pdf", "T/2026"), ("c.pdf", "T"), ("z.pdf", "")]
    assert [r.path for r in refused.collect()] == ["T/b?d"]


def test_a_document_in_the_way_of_a_folder(spark):
    tree = hierarchy.folder_tree(spark.createDataFrame([("f", None, "Top")], "id string, parent_id string, name string"))
    docs = spark.createDataFrame([("d", "f", "Notes"), ("e", None, "other")], "id string, folder_id string, title string")
    paths = spark.createDataFrame([("top/notes/deep",), ("Top/new",)], "path string")
    got = [tuple(r) for r in hierarchy.missing_paths(paths, tree, documents=docs).collect()]
    assert got == [("Top/new", 2, False), ("top/notes", 2, True), ("top/notes/deep", 3, True)]


def test_moves_that_change_nothing(spark):
    tree = hierarchy.folder_tree(spark.createDataFrame([("a", None, "a"), ("b", "a", "b"), ("c", None, "c")], "id string, parent_id string, name string"))
    moves = [("b", "a", False), ("b", None, True), ("b", "c", True), ("a", None, False), ("a", "b", False), ("a", "a", False), ("c", "b", True), ("x", "a", False), ("a", "x", False)]
    got = {(r.id, r.to): r.valid for r in hierarchy.valid_moves(spark.createDataFrame([m[:2] for m in moves], "id string, to string"), tree).collect()}
    assert got == {m[:2]: m[2] for m in moves}


def test_queue_lists_and_trash(spark):
    t = lambda m: DAY + dt.timedelta(minutes=m)
    docs = [("a", "processing", t(5), None), ("b", "processing", t(1), None), ("c", "uploaded", t(3), None), ("d", "failed", t(9), None), ("e", "failed", t(2), None), ("f", "ready", t(1), None), ("g", "ready", t(1), None), ("h", "ready", t(1), None), ("i", "processing", t(0), t(0))]
    df = spark.createDataFrame(docs, "id string, status string, updated_at timestamp, deleted_at timestamp")
    steps = spark.createDataFrame([("e", t(30)), ("f", t(10)), ("g", t(20)), ("g", t(4)), ("h", t(-2000))], "document_id string, finished_at timestamp")
    listed = lambda state, **k: [r.id for r in relational.queue_list(df, steps, state, str(t(60)), **k).collect()]
    assert [listed(s) for s in ("running", "queued", "failed", "finished")] == [["b", "a"], ["c"], ["e", "d"], ["g", "f"]]
    assert listed("running", first=1) == ["b"]
    with pytest.raises(ValueError, match="no state"):
        listed("lost")
    trash = spark.createDataFrame([("z", t(1)), ("b", t(2)), ("a", t(2)), ("x", None)], "title string, deleted_at timestamp")
    assert [r.title for r in relational.trash_list(trash).collect()] == ["a", "b", "z"]


STORED = "id string, user_id long, member_key string, status string, document_ids array<string>, links array<struct<fromId:string,toId:string,heuristic:double>>, ai_verdicts array<struct<fromId:string,toId:string,continues:boolean,confidence:double,reason:string>>, reasons array<struct<signal:string,text:string,points:double>>, heuristic_confidence double, confidence double"
ANSWER = "id string, user_id long, member_key string, from_id string, to_id string, continues boolean, confidence double, reason string, answered_at int"


def test_verdicts_are_written_under_their_conditions(spark):
    links, reasons = [("x", "y", 0.5), ("y", "z", 0.9)], [("timeGap", "close", 1.5), ("ai", "old", 9.0), ("vendor", "differs", -2.5)]
    row = lambda i, status="open", verdicts=(): (i, 1, "x,y,z", status, ["x", "y", "z"], links, list(verdicts), reasons, 0.5, 0.5)
    stored = spark.createDataFrame([row("open"), row("settled", "dismissed"), row("answered", verdicts=[("x", "y", False, 0.5, "old")]), row("untouched"), row("other")], STORED)
    answer = lambda i, a="x", b="y", yes=True, user=1, key="x,y,z", when=1: (i, user, key, a, b, yes, 0.8, "why", when)
    answers = [answer("open"), answer("open", yes=False, when=2), answer("open", "y", "z", when=3), answer("open", "x", "z"), answer("settled"), answer("answered"), answer("answered", "y", "z"), answer("other", user=2), answer("other", key="x,y"), answer("gone")]
    after, outcomes = suggestions.verdicts_merged(stored, spark.createDataFrame(answers, ANSWER))
    rows = {r.id: r for r in after.collect()}
    assert len(rows) == 5 and rows["untouched"] == rows["untouched"].__class__(**row_dict(stored, "untouched")) and rows["settled"].ai_verdicts == [] and rows["other"].ai_verdicts == []
    open_ = rows["open"]
    assert [(v.fromId, v.toId, v.continues) for v in open_.ai_verdicts] == [("x", "y", True), ("y", "z", True)]
    moved = lambda h, p: 1 / (1 + 2.718281828459045 ** -(suggestions.log_odds(h) + p))
    assert abs(open_.confidence - min(moved(0.5, 2.4), moved(0.9, 2.4))) < 1e-9 and open_.heuristic_confidence == 0.5
    assert [(r.signal, r.points) for r in open_.reasons] == [("ai", pytest.approx(2.4)), ("ai", pytest.approx(2.4)), ("timeGap", 1.5), ("vendor", -2.5)]
    assert open_.reasons[0].text == "model: page 2 goes on from page 1: why"
    assert [(v.fromId, v.continues) for v in rows["answered"].ai_verdicts] == [("x", False), ("y", True)] and abs(rows["answered"].confidence - moved(0.5, -1.5)) < 1e-9
    written = {(r.id, r.from_id, r.to_id, r.answered_at): r.written for r in outcomes.filter("id <> 'other'").collect()}
    assert written == {("open", "x", "y", 1): True, ("open", "x", "y", 2): False, ("open", "y", "z", 3): True, ("open", "x", "z", 1): False, ("settled", "x", "y", 1): False, ("answered", "x", "y", 1): False, ("answered", "y", "z", 1): True, ("gone", "x", "y", 1): False}
    assert outcomes.count() == len(answers)
    said = after.select("id", suggestions.rule_reasons(F.col("reasons")).alias("r"), suggestions.model_summary(F.col("heuristic_confidence"), F.col("ai_verdicts")).alias("m"))
    told = {r.id: (r.m, [x.text for x in r.r.supporting], [x.text for x in r.r.opposing]) for r in said.collect()}
    assert told["open"] == ("rules 50% · model confirmed all 2 page breaks", ["close"], ["differs"]) and told["untouched"][0] is None
    assert told["answered"][0] == "rules 50% · model doubted 1 of 2 page breaks"


def row_dict(df, i):
    return df.filter(F.col("id") == i).first().asDict()


def test_front_matter_goes():
    assert heading_passages("--- \ntitle: x\n... \n# H\ntext") == [("H", "text")]
    assert heading_passages("---\n---\ntext") == [(None, "--- --- text")] and heading_passages("---\nopen") == [(None, "--- open")]
    assert heading_passages("a\n---\nb\n---") == [(None, "a --- b ---")]


def test_manifests_are_read_once(spark):
    """Documents, folders and the head are judged in one pass: the plan of the errors has one reader of JSON and one look at each field."""
    df = spark.createDataFrame([("a", '{"format":"quillspark-export","version":1,"exportedAt":"now","folders":[{"path":""}],"documents":[{"id":1}]}'), ("b", "no"), ("c", None)], "archive string, text string")
    errors = backup.read_manifests(df)[2]
    plan = errors._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") + plan.count("jsontostructs(") == 1 and plan.count("$.originalFilename") <= 2
    got = {(r.archive, r.place, r.problem) for r in errors.collect()}
    assert {("b", "manifest", "is no manifest in JSON"), ("c", "manifest", "is no manifest in JSON"), ("a", "documents[0]", "id is no text"), ("a", "folders[0]", "path is no text of one character or more"), ("a", "folders[0]", "mcpEnabled is missing")} <= got
    assert len(got) == 2 + 2 + len(backup.FIELDS)
