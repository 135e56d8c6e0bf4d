"""The stages of the pipeline that drop rows, against brute force, with null and repeated ids."""

import random
import re
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    sets, unit = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                unit = [unit[j] if u == unit[i] else u for u in unit]
    return unit


def test_row_stages_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(23)
    some = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))

    def changed(text):
        w = text.split()
        w[-1] = "changed"
        return " ".join(w)

    item = some(24)
    a, b, c, d, e = (some(80) for _ in range(5))
    leak = f"{some(30)} {item} {some(30)}"
    rows = [
        (None, a), (None, b), (None, leak), (None, changed(b)), (None, None), (None, ""),  # null ids: clean, near copies, a leak
        (1, c), (1, c), (1, c), (2, changed(c)),  # a repeated row
        (3, d), (5, e), (3, changed(e)), (4, d),  # one id with two texts, one of them a near copy of another id's
        (6, some(60)), (6, f"{item} {some(40)}"), (7, None), (7, None), (7, ""), (8, some(3)),
    ]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    path = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    unit = groups(rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, path)
    assert kept.columns == docs.columns
    kept = [tuple(r) for r in kept.collect()]
    want = Counter()
    for u in set(unit):
        own = [r for r, x in zip(rows, unit, strict=True) if x == u]
        best = min(own, key=lambda r: r[0] if r[0] is not None else sys.maxsize)
        same_id = [r for r in own if r[0] == best[0]]
        assert len([r for r in kept if r in own]) == (1 if shingles(own[0][1]) else sum(r in own for r in rows if r == own[0]))
        assert [r for r in kept if r in same_id]
        want[u] = len(own)
    assert len(kept) == len(set(unit)) and max(want.values()) == 4

    spoken = lambda t: " " + " ".join(re.findall(r"\w+", t or "")) + " "
    w = item.split()
    dirty = lambda r: any(f" {' '.join(w[k : k + 10])} " in spoken(r[1]) for k in range(15))
    clean = corpus_pipeline.decontamination(spark, docs, path)
    assert clean.columns == docs.columns
    assert Counter(tuple(r) for r in clean.collect()) == Counter(r for r in rows if not dirty(r))
    assert sum(map(dirty, rows)) == 2


def test_run_with_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    rng = random.Random(24)
    words = "the of and to in is that it was for on are as with his they at be this from".split()
    some = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s"]) for _ in range(n))
    item, one = some(20), some(60)
    rows = [(k, some(50)) for k in range(10, 60)] + [(None, one), (None, one + " end"), (None, f"{some(20)} {item}"), (9, item), (9, some(40)), (9, "password = abcdefgh1234 " + some(40)), (None, None)]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    monkeypatch.setattr(corpus_pipeline, "fit", lambda docs: None)  # what the first stage drops is the language model's affair
    monkeypatch.setattr(corpus_pipeline, "with_language", lambda docs, model: docs.filter(F.col("text").isNotNull()))
    out = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, path).collect())
    assert out == Counter([*range(10, 60), None, 9, 9])
