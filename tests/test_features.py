"""Features of scans against cases worked out by hand, and pairs against the same rules in plain Python."""

import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import features as f
from quillspark.operators import linkage
from quillspark.settings import LINKAGE

DAY = dt.date(2026, 3, 1)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Page 2 of 3", [(2, 3)]),
        ("see page 2 of 3 for more, page 3/3", [(2, 3), (3, 3)]),
        ("Seite 2 von 3\nBLATT 4", [(2, 3), (4, None)]),
        ("see page 2", []),
        (" - Page 2 - ", [(2, None)]),
        ("2/3 of the amount", []),
        ("- 2 / 3 -\nx", [(2, 3)]),
        ("S. 2 von 3, p.1 of 2, pg. 9 of 12", [(2, 3), (1, 2), (9, 12)]),
        ("p 2 of 3", []),
        ("homepage 2 of 3", []),
        ("Page 3 of 2", []),
        ("Page 0 of 2", []),
        ("Page 1000 of 2000", []),
        ("Page 2 of 501", []),
        ("Page2 of 3", []),
        ("page 2of3", [(2, 3)]),
        ("", []),
    ],
)
def test_page_markers(text, want):
    assert f.page_markers(text) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("scan_0003.PDF", ("scan_0003", "scan_#", 3.0, False)),
        ("Scan (2).jpg", ("scan (2)", "scan", 2.0, True)),
        ("Scan(2)", ("scan(2)", "scan", 2.0, True)),
        ("Invoice no. 12", ("invoice no. 12", "invoice no. #", 12.0, False)),
        ("page3-final.jpeg", ("page3-final", "page#-final", 3.0, False)),
        ("letter.toolong", ("letter.toolong", "letter.toolong", None, False)),
        (" Letter.txt ", ("letter", "letter", None, False)),
        ("a (x).png", ("a (x)", "a (x)", None, False)),
        ("", ("", "", None, False)),
    ],
)
def test_name_parts(name, want):
    assert f.name_parts(name) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Invoice no. 10432", [("invoice no.", "10432")]),
        ("Rechnungsnr.: RE-2026-10432 vom", [("invoice no.", "RE-2026-10432")]),
        ("Kundennummer 55-555-1", [("customer no.", "55-555-1")]),
        ("Ref #12345 and case:98765", [("reference", "12345"), ("reference", "98765")]),
        ("Invoice 1234", []),
        ("Invoice date 03.11.2026", []),
        ("Order 03.11.2025", []),
        ("Reorder 123456", []),
        ("account id 123456x", []),
        ("Konto\n12345678", [("account no.", "12345678")]),
        ("Policy number: AB/123456.", [("policy no.", "AB/123456")]),
        ("inv-12345", []),
    ],
)
def test_labelled_numbers(text, want):
    assert f.labelled_numbers(text, DAY) == want


def test_numbers_and_lines():
    assert f.numbers("RE-2026/1, Nummer12 x 12.345a 7-8. ABCDE-12345 ä1") == ["RE-2026/1", "12", "7-8", "12345", "ä1"]
    assert f.content_lines("a \r\n\n Page 1 of 2\nb") == ["a", "b"]
    assert [f.has_legal_form(x) for x in ("Muster GmbH", "GmbHs", "the AG.", "e.V. x", "Kiosk Ltd.", "WAGE", "S.A.")] == [True, False, True, True, True, False, True]
    assert [f.opening([x], DAY) for x in ("Sehr geehrte Frau", "x AG", "1 May 2024", "nothing")] == ["greeting", "letterhead", "date", None]
    assert [f.ends_open(x) for x in ("and", "so,", "on-", "end.", "5", "dash–")] == [True, True, True, False, False, True]
    assert [f.starts_lower(x) for x in ("goes", '"so', "• on", "5 on", "On", "...")] == [True, True, True, False, False, False]


def kinds(a, b):
    """The rules for "b continues a" on two candidates, written out once more."""
    x, y = (f.features_of(r["original_filename"] or "", r["text_head"] or "", r["text_tail"] or "", r["created_at"].date()) for r in (a, b))
    gap = abs((b["created_at"] - a["created_at"]).total_seconds())
    out = {"timeGap": "close" if gap <= 120 else "near" if gap <= 600 else "far" if gap > 3600 else "apart"}
    if x["number"] is not None and y["number"] is not None and (x["is_copy"], x["stem"]) == (y["is_copy"], y["stem"]):
        out["filename"] = "next" if y["number"] == x["number"] + 1 else "series"
    elif y["is_copy"] and y["stem"] == x["name"]:
        out["filename"] = "next" if y["number"] in (1, 2) else "series"
    else:
        out["filename"] = "series" if x["is_copy"] and x["stem"] == y["name"] else "unrelated"
    end, start = (x["end_page"], x["end_of"]), (y["start_page"], y["start_of"])
    if start[0] is None:
        out["pageMarkers"] = "complete" if end[0] is not None and end[0] == end[1] else "none"
    elif start[0] == 1 or end[0] is None:
        out["pageMarkers"] = "restart" if start[0] == 1 else "none"
    elif None not in (start[1], end[1]) and start[1] != end[1]:
        out["pageMarkers"] = "conflict"
    else:
        out["pageMarkers"] = "consecutive" if start[0] == end[0] + 1 else "sameSet" if (start[1] or end[1]) else "none"
    out["identifiers"] = "shared" if {r["plain"] for r in x["labelled"]} & set(y["numbers"]) or {r["plain"] for r in y["labelled"]} & set(x["numbers"]) else "none"
    field = lambda p, q, same: "none" if p is None else "onlyFirst" if q is None else "agree" if same(p, q) else "conflict"
    short = lambda v: "".join(c for c in v.lower() if c.isalnum())
    out["documentDate"] = field(a["document_date"], b["document_date"], lambda p, q: p == q)
    out["vendor"] = field(a["vendor"], b["vendor"], lambda p, q: short(p) in short(q) or short(q) in short(p))
    out["textFlow"] = "runsOn" if x["ends_open"] and y["starts_lower"] else "freshStart" if y["opening"] else "none"
    u, v = a["mean_embedding"], b["mean_embedding"]
    out["embedding"] = "none"
    if u is not None and v is not None and len(u) == len(v) and any(u) and any(v):
        c = sum(p * q for p, q in zip(u, v, strict=True)) / math.sqrt(sum(p * p for p in u) * sum(q * q for q in v))
        out["embedding"] = "similar" if c >= 0.85 else "dissimilar" if c < 0.4 else "none"
    return out


def confidence(a, b):
    return 1 / (1 + math.exp(-(LINKAGE.bias + sum(LINKAGE.weights[k][v] for k, v in kinds(a, b).items()))))


def test_pairs_equal_the_rules(spark):
    rng, rows = random.Random(6), []
    for i in range(70):
        rows.append(
            {
                "id": f"d{i:02}",
                "user_id": rng.choice([1, 1, 2]),
                "folder_id": rng.choice([None, "f"]),
                "created_at": dt.datetime(2026, 3, 1) + dt.timedelta(seconds=rng.choice([1, 60, 500, 4000, 30_000]) * rng.randint(0, 9)),
                "original_filename": rng.choice([None, "", "scan_1.pdf", "scan_02.png", "scan_3", "scan (1).png", "scan.png", "scan (3)", "x"]),
                "mime_type": rng.choice(["image/png", "application/pdf", "text/plain"]),
                "document_date": rng.choice([None, DAY, dt.date(2025, 1, 1)]),
                "vendor": rng.choice([None, "ACME", "Acme Supplies GmbH", "Else", "-"]),
                "text_head": rng.choice([None, "", "Page 1 of 3", "Page 2 of 3\nmore text", "Seite 2 von 4", "Dear you", "Page 3\ngoes on", "Invoice no. 12345", "12345 again"]),
                "text_tail": rng.choice([None, "", "and so", "end.", "Page 3 of 3", "Order 12345-6", "Page 2"]),
                "mean_embedding": rng.choice([None, [1.0, 0.0], [0.9, 0.2], [0.0, 1.0], [0.0, 0.0], [1.0]]),
            }
        )
    types = "id string, user_id long, folder_id string, created_at timestamp, original_filename string, mime_type string, document_date date, vendor string, text_head string, text_tail string, mean_embedding array<double>"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], types).withColumn("name", F.lit("clash")).repartition(3)
    got = {(r.a, r.b): r for r in linkage.score_pairs(df).collect()}
    met = lambda a, b: a["user_id"] == b["user_id"] and a["folder_id"] == b["folder_id"] and "text/plain" not in (a["mime_type"], b["mime_type"]) and abs((a["created_at"] - b["created_at"]).total_seconds()) <= 21_600
    want = {(a["id"], b["id"]): (a, b) for a, b in itertools.permutations(rows, 2) if met(a, b)}
    assert got.keys() == want.keys() and len(want) > 300
    for key, (a, b) in want.items():
        found = {r.signal: r.text.split(":")[0] for r in got[key].reasons}
        assert found == {k: v for k, v in kinds(a, b).items() if LINKAGE.weights[k][v]}, (a, b)
        assert abs(got[key].confidence - confidence(a, b)) < 1e-12
        points = [r.points for r in got[key].reasons]
        assert points == sorted(points, reverse=True)
    assert linkage.score_pairs(df.limit(0)).collect() == [] and linkage.merge_groups(df.limit(0)).collect() == []


def test_pairs_run_no_python(spark):
    types = "id string, created_at timestamp, document_date date, vendor string, mean_embedding array<float>, " + f.FEATURES
    features = spark.createDataFrame([], types)
    pairs = spark.createDataFrame([], "a string, b string, gap_s double")
    plan = f.scored(pairs, features)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInPandas" not in plan and "ArrowEval" not in plan


def test_scans_are_dealt_out_and_read_alike(spark, tmp_path):
    """A small file of events is read by more than one task, and a text that comes again is read as it was at first."""
    import datetime as dt

    from quillspark.operators import features
    from quillspark.plans.views import event_scans

    rows = [(i, dt.datetime(2024, 1, 1 + i % 3), i % 5, "view") for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    scans = event_scans(spark, str(tmp_path))
    assert scans.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and scans.count() == 400
    filed = dt.date(2024, 1, 5)
    for head, tail in (("Page 2 of 3\nContract no. 500123", "the end.\n500000"), ("Dear reader,", "and so on,"), ("17.03.2019 noted", ""), ("", "")):
        one, two = (features.features_of(n, head, tail, filed) for n in ("scan_1.png", "scan_2 (1).png"))
        long = features.features_of("scan_1.png", head, f"{tail}{' ' * features.SHORT}", filed)
        assert one == long and one["name"] == "scan_1" and two["is_copy"] and {k: v for k, v in one.items() if k not in ("name", "stem", "number", "is_copy")}.items() <= two.items()
