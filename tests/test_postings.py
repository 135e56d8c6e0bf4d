"""The index of words gives what a scan gives, and leaves blocks out."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import words
from quillspark.operators import postings, search

VOCABULARY = ["a", "b", "c", "d", "e", "rare"]
QUERIES = ["a", "a b", '"a b"', "a -b", "a b or c -d", '"a b c" or rare', "rare", "nowhere", "a nowhere or b", 'a "b a" -"c c"', "c c c", "a b c d e", '-"a b" c', "rare or rare"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        n = rng.choice([0, 1, 3, 10, 40, 200])
        rows.append((i, i // 3, " ".join(rng.choices(VOCABULARY, [20, 9, 5, 3, 2, 0.1], k=n))))
    rows += [(400, 200, None), (401, 200, "A, b! Ä ä"), (402, 201, "a " * 3000)]
    return spark.createDataFrame(rows, "id long, document_id long, content string").repartition(3).cache()


def scanned(corpus, query, k):
    ways, tokens = search.parse_query(query), words(F.col("content"))
    rows = corpus.filter("content is not null")
    found = search.ranked(rows.filter(search.matches(tokens, ways)).withColumn("__s", search.cover_rank(tokens, ways)), F.col("__s"), "id", k)
    return [tuple(r) for r in found.select("id", "document_id", F.round("score", 9), "rank").orderBy("rank").collect()]


def looked_up(index, query, k, **more):
    top = postings.top_passages(index, query, k, **more)
    return [tuple(r) for r in top.select("id", "document_id", F.round("score", 9), "rank").orderBy("rank").collect()]


@pytest.mark.parametrize("query", QUERIES)
def test_equals_the_scan(corpus, query):
    index = postings.index_words(corpus, block=8).cache()
    k = 1000 if query.endswith("rare") else 7
    assert looked_up(index, query, k, first=2) == scanned(corpus, query, k)


def test_filters_hold_before_the_top(corpus, spark):
    allowed = spark.range(0, 120, 7).withColumnRenamed("id", "document_id")
    index = postings.index_words(corpus, block=8)
    some = corpus.join(allowed, "document_id", "left_semi")
    assert looked_up(index, "a b", 9, allowed=allowed, first=2) == scanned(some, "a b", 9)


def test_refusals_alone_need_the_passages(corpus):
    index = postings.index_words(corpus)
    with pytest.raises(ValueError, match="refusals"):
        postings.top_passages(index, "-a")
    assert looked_up(index, "-a or b", 20, passages=corpus) == scanned(corpus, "-a or b", 20)


def test_few_blocks_are_scored(corpus, monkeypatch):
    index, scored, blocks = postings.index_words(corpus, block=8).cache(), postings._scored, []
    monkeypatch.setattr(postings, "_scored", lambda index, some, *more: blocks.append(some.count()) or scored(index, some, *more))
    looked_up(index, "b c", 5, first=2)
    every = index.filter(F.col("term").isin("b", "c")).groupBy("block").count().filter("count = 2").count()
    assert blocks[0] == 2 and blocks[1] < every / 2


def test_index_rows_are_bounded_and_updated(corpus, spark):
    index = postings.index_words(corpus, block=8)
    assert index.select(F.max(F.size("entries"))).first()[0] < 40
    fresh = spark.createDataFrame([(9000, 2, "rare rare b"), (9001, 5000, "a")], "id long, document_id long, content string")
    changed = spark.createDataFrame([(2,), (5000,), (133,)], "document_id long")
    after = corpus.join(changed, "document_id", "left_anti").unionByName(fresh)
    merged = postings.merged_index(index, fresh, changed, block=8)
    for query in ("rare", "a b", "b"):
        assert looked_up(merged, query, 20, first=1) == scanned(after, query, 20)
    one = {r["term"]: tuple(r)[1:] for r in postings.document_frequency(merged).collect()}
    assert one["rare"][0] == after.filter(F.array_contains(words(F.col("content")), "rare")).count()


def test_empty_index(corpus):
    index = postings.index_words(corpus.limit(0))
    assert looked_up(index, "a b", 5) == []


def test_search_by_index_equals_search_by_scan(corpus, spark):
    docs = corpus.filter("content is not null").select(F.col("document_id").alias("id")).distinct().withColumn("title", F.concat(F.lit("a "), F.col("id").cast("string")))
    chunks = corpus.filter("content is not null").withColumn("embedding", F.array(F.lit(1.0), F.col("id") / 1000))
    index = postings.index_words(chunks)
    plain, fast = (search.hybrid_search(docs, chunks, "b c -rare", [1.0, 0.0], allowed=F.col("id") < 90, min_cosine=0.5, postings=p).collect() for p in (None, index))
    assert plain == fast and len(plain) == 20


def test_only_passages_are_shuffled(corpus, monkeypatch):
    """One shuffle, of passages by block: no place of a word is dealt out, and a block's rows lie together."""
    from quillspark.functions.text import words as tokens_of

    monkeypatch.setattr(postings, "LEAST_BYTES", 1000)
    index = postings.index_words(corpus, block=9)
    executed = index._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert executed.count("Exchange hashpartitioning(block") == 1 and executed.count("Exchange") == 1
    parts = index.select("block", F.spark_partition_id().alias("part")).distinct().groupBy("block").count()
    assert parts.filter("count > 1").isEmpty()
    places = index.select(F.explode("entries").alias("e")).agg(F.sum(F.size("e.at"))).first()[0]
    assert places == corpus.agg(F.sum(F.size(tokens_of(F.coalesce("content", F.lit("")))))).first()[0]
