from pyspark.sql import functions as F

from quillspark.functions import answers


def test_titles():
    assert answers.sanitize_title('```\n# Title: "Rent 2024 / May"\n```') == "Rent 2024-May"
    assert answers.sanitize_title("...") is None
    assert len(answers.sanitize_title("word " * 100)) <= 120


def test_continuations():
    assert answers.continuation_answer('Sure: {"continues": "yes", "confidence": "80%", "reason": "a\\n b"} done') == {"continues": True, "confidence": 0.8, "reason": "a b"}
    assert answers.continuation_answer('{"x": 1} {"continues": false}') == {"continues": False, "confidence": 0.0, "reason": ""}
    assert answers.continuation_answer("no json") is None


def test_formats_and_slices(spark):
    assert [answers.gap_text(s) for s in (5, 90, 7200)] == ["5 s", "2 min", "2 h"]
    assert [answers.bytes_text(n) for n in (5, 2048, 5 << 20)] == ["5 B", "2.0 KB", "5.0 MB"]
    row = spark.createDataFrame([("  abcdef ",), ("  ",)], "t string").select(answers.stored_text(F.col("t")).alias("t"))
    rows = row.select("t", answers.text_page(F.col("t"), 2, 2).alias("p"), answers.text_tail(F.col("t"), 2).alias("e")).collect()
    assert rows[0]["t"] == "abcdef" and rows[0]["p"]["text"] == "cd" and rows[0]["p"]["next"] == 4 and rows[0]["e"] == "ef"
    assert rows[1]["t"] is None
