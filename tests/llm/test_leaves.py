"""An edit changes the leaves at its own place only."""

import hashlib
import random

from pyspark.sql import functions as F

from quillspark.llm import merkle


def test_an_insertion_changes_few_leaves(spark):
    rng = random.Random(25)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9)))
    pairs = []
    for k in range(40):
        w = [word() for _ in range(400)]
        cut = [*w[:3], "inserted", *w[3:]] if k % 2 else [*w[:3], *w[4:]]
        pairs.append((len(pairs), " ".join(w), " ".join(cut)))
    for _ in range(10):  # one line without white space
        t = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
        pairs.append((len(pairs), t, t[:7] + "中" + t[7:]))
    odd = ["", " ", "  \t ", "a" * 500, "x  y \t\nz\n\n w ", "a" * 24, "a" * 25, "🙂" * 60]
    pairs += [(len(pairs) + i, t, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(pairs, "id int, a string, b string").repartition(3)
    both = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    near = merkle.with_likeness(both, "fa", "fb", "near")
    rows = near.select("id", "near", F.size(merkle.differing_places(F.col("fa"), F.col("fb"))).alias("ab"), F.size(merkle.differing_places(F.col("fb"), F.col("fa"))).alias("ba"), "fa").collect()
    for r in rows:
        if r["id"] < 50:
            assert 0 < r["ab"] <= 2 and 0 < r["ba"] <= 2 and 0.9 < r["near"] < 1
            assert len(r["fa"].split(".")) > 40
        else:
            assert r["near"] == 1 and r["ab"] == 0
    assert len({r["fa"] for r in rows if r["id"] >= 50}) == len(odd)


def test_paths_lead_to_the_edit(spark):
    rng = random.Random(26)
    line = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12))
    lines = [line() for _ in range(60)]
    changed = [*lines]
    changed[33] = changed[33].replace(" ", " edited ", 1)
    swapped = [*lines[:10], lines[11], lines[10], *lines[12:]]
    pairs = [("\n".join(lines), "\n".join(x)) for x in (changed, swapped, lines[:-1], [*lines, lines[0]], lines)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    both = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    rows = merkle.with_likeness(both, "fa", "fb", "near").select("*", merkle.differing_places(F.col("fa"), F.col("fb")).alias("ab"), merkle.differing_places(F.col("fb"), F.col("fa")).alias("ba")).orderBy("id").collect()
    sections = [s.split(":")[1].split(";") for s in rows[0]["fa"].split("|")[1].split("/")]
    assert sum(map(len, sections)) == 60
    for p in rows[0]["ab"]:  # every path leads to line 33
        assert sum(map(len, sections[: p["section"]])) + p["paragraph"] == 33 and p["leaf"] >= 0
    assert rows[0]["ab"] and rows[0]["ba"]
    for r in rows[1:4]:  # another order, a line less, a line more: told, though no leaf need be new
        assert r["near"] < 1 and r["ab"] and r["ba"] and r["fa"].split("|")[0] != r["fb"].split("|")[0]
    assert rows[4]["near"] == 1 and rows[4]["ab"] == [] and rows[4]["fa"] == rows[4]["fb"]


def test_extreme_null_and_repeated_ids(spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "c d"), (0, None), (None, "e"), (None, "f"), (5, "g"), (5, "h"), (5, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1)).withColumn("fp", F.lit("x")).repartition(3)
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    order = sorted(rows, key=key, reverse=True)
    want = sorted(((r[0], r[1] or "", order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order)), key=str)
    assert sorted((tuple(r) for r in merkle.with_next(docs).collect()), key=str) == want
    assert merkle.edit_report(docs).count() == len(rows)
