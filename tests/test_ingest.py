"""What becomes of files, types of uploads, covers, passages as a table function, filters with folders."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from quillspark.functions import decode
from quillspark.functions import text as tx
from quillspark.operators import hierarchy
from quillspark.operators.filters import SearchFilter
from quillspark.sources import files

PDF = b"%PDF-1.7 "


def test_outcomes(spark, tmp_path):
    for name, content in {"a.pdf": PDF + b"1", "b/b.pdf": PDF + b"2", "c.pdf": PDF + b"2", "d.pdf": PDF + b"3", "f.zip": b"PK\x03\x04zz", "g.pdf": PDF + b"x" * 500, "h.pdf": PDF + b"4", "~$i.pdf": PDF}.items():
        at = tmp_path / name
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(content)
    seen = files.fingerprint(files.list_files(spark, str(tmp_path)), most_bytes=400)
    sums = {r["relative"]: r["checksum_sha256"] for r in seen.collect()}
    assert sums["g.pdf"] is None
    day = dt.datetime(2026, 1, 1)
    docs = [("old", 1, sums["a.pdf"], "ready", day, None), ("older", 1, sums["a.pdf"], "ready", day - dt.timedelta(1), None), ("oldest", 2, sums["a.pdf"], "ready", day - dt.timedelta(2), None), ("gone", 1, sums["d.pdf"], "ready", day, day), ("half", 1, sums["h.pdf"], "pending_upload", day, None)]
    held = spark.createDataFrame(docs, "id string, user_id long, checksum_sha256 string, status string, created_at timestamp, deleted_at timestamp")
    out = files.ingest_outcomes(seen, held, 1)
    got = {r["relative"]: (r["outcome"], r["document_id"], r["refused"]) for r in out.collect()}
    assert got == {
        "a.pdf": ("duplicate", "older", None), "b/b.pdf": ("file", None, None), "c.pdf": ("duplicate", None, None), "d.pdf": ("file", None, None),
        "f.zip": ("rejected", None, "wrong type"), "g.pdf": ("rejected", None, "too large"), "h.pdf": ("finish", "half", None),
    }
    refusals = out.filter("outcome = 'rejected'").select("path", "length", "modificationTime")
    again = files.not_refused_before(files.list_files(spark, str(tmp_path)), refusals)
    assert {r["relative"] for r in again.select("relative").collect()} == {"a.pdf", "b/b.pdf", "c.pdf", "d.pdf", "h.pdf"}


def test_upload_types(spark):
    rows = [("a.CSV", "application/vnd.ms-excel", "text/csv"), ("a.xls", "application/vnd.ms-excel", "application/vnd.ms-excel"), ("a.md", "text/x-markdown", "text/markdown"), ("a.md", "", "text/markdown"), ("a.epub", None, "application/epub+zip"), ("csv", "", "application/octet-stream"), ("a.b.HTM", "", "text/html"), ("a.png", "image/png", "image/png")]
    df = spark.createDataFrame(rows, "name string, given string, want string")
    assert [r["got"] for r in df.select(decode.upload_type(F.col("name"), F.col("given")).alias("got")).collect()] == [w for _, _, w in rows]


def book(items, meta="", extra=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata>{meta}</metadata><manifest>{items}</manifest></package>')
        for name, content in (extra or {}).items():
            z.writestr(name, content)
    return out.getvalue()


def test_covers(spark):
    three = book('<item id="i" href="img/c%20d.png" media-type="image/png" properties="x cover-image"/>', extra={"O/img/c d.png": b"three"})
    two = book('<item id="j" href="../c.jpg" media-type="image/jpeg"/>', '<meta name="cover" content="j"/>', {"c.jpg": b"two"})
    assert decode.epub_cover(three) == b"three" and decode.epub_cover(two) == b"two"
    assert decode.epub_cover(two, 2) is None
    assert decode.epub_cover(book('<item id="j" href="c.xhtml" media-type="application/xhtml+xml"/>', '<meta name="cover" content="j"/>')) is None
    assert decode.epub_cover(book("")) is None
    df = spark.createDataFrame([(bytearray(two),), (None,)], "b binary")
    assert [r[0] and bytes(r[0]) for r in df.select(decode.epub_cover_udf("b")).collect()] == [b"two", None]


def test_passages_in_sql(spark):
    spark.udtf.register("passages", tx.Passages)
    spark.createDataFrame([(1, "# A\n\none\n\n# B\n\ntwo", "text/markdown", "markdown"), (2, None, None, None)], "id int, t string, m string, f string").createOrReplaceTempView("texts_of_test")
    got = spark.sql("SELECT id, p.position, p.heading, p.content FROM texts_of_test, LATERAL passages(t, m, f) p").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "A", "one"), (1, 1, "B", "two")]


def test_filter_with_folders(spark):
    tree = hierarchy.folder_tree(spark.createDataFrame([("a", None, "a"), ("b", "a", "b")], "id string, parent_id string, name string"))
    docs = spark.createDataFrame([("1", "a", "application/pdf", None, "v", None), ("2", "b", "application/pdf", None, None, None), ("3", "b", "text/csv", None, None, 2.0), ("4", None, "application/pdf", None, None, None)], "id string, folder_id string, mime_type string, document_date date, vendor string, total double")
    ids = lambda f, below=True: {r["id"] for r in hierarchy.filtered(docs, tree, f, below).collect()}
    assert ids(SearchFilter(folder_ids=("a",), kinds=("PDF",))) == {"1", "2"} and ids(SearchFilter(folder_ids=("a",)), False) == {"1"}
    assert ids(SearchFilter()) == {"1", "2", "3", "4"} and ids(SearchFilter(folder_ids=())) == set() and ids(SearchFilter(has_receipt=True)) == {"1", "3"}
