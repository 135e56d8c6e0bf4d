"""Sources and stateful operators, on files in a temporary folder."""

import datetime as dt

from quillspark.sources import files
from quillspark.streaming import archive


def test_files(spark, tmp_path):
    (tmp_path / "in" / ".hidden").mkdir(parents=True)
    for name, data in {"a.txt": b"hello", "b.txt": b"hello", ".dot.txt": b"x", "~$lock.txt": b"x", "c.pdf": b"%PDF-1.7 x", "d.pdf": b"no pdf", "e.txt": b"", ".hidden/f.txt": b"x"}.items():
        (tmp_path / "in" / name).write_bytes(data)
    found = files.fingerprint(files.list_files(spark, str(tmp_path / "in")))
    rows = {r["relative"]: (r["mime_type"], r["refused"]) for r in found.collect()}
    assert rows == {"a.txt": ("text/plain", None), "b.txt": ("text/plain", None), "c.pdf": ("application/pdf", None), "d.pdf": (None, "wrong type")}
    # Spark's source passes over empty files, so e.txt is refused by not being there
    none = spark.createDataFrame([], "user_id string, checksum_sha256 string")
    assert sorted(r["relative"] for r in files.new_files(found, none, "u").collect()) == ["a.txt", "c.pdf"]


def test_quiet_periods_and_limits(spark):
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([(i, "u", t(s)) for i, s in enumerate([0, 30, 89, 200, 1000])], "i int, k string, t timestamp")
    bursts = archive.quiet_periods(rows, "k", "t").orderBy("start").collect()
    assert [r["n"] for r in bursts] == [3, 1, 1]
    assert [r["refused"] for r in archive.rate_limited(rows, "k", "t", ["i"], 2, 100).orderBy("i").collect()] == [False, False, True, False, False]


def test_stable_files(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    schema = "path string, size long, mtime timestamp, seen_at timestamp"
    seen = [("p", 1, base, base), ("p", 2, base, base + dt.timedelta(seconds=5)), ("p", 2, base, base + dt.timedelta(seconds=12)), ("p", 2, base, base + dt.timedelta(seconds=15)), ("p", 2, base, base + dt.timedelta(seconds=40))]
    spark.createDataFrame(seen, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = archive.stable_files(stream).writeStream.format("memory").queryName("stable").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["path"], r["size"]) for r in spark.table("stable").collect()] == [("p", 2)]
