"""Cases that every operator has to stand: very long texts, malformed pages, odd characters, ties, repeated rows, clashing columns."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, common, decontam, html_crf, language, licenses, merkle, ngram_join, secret_scan, suffix_dedup, token_counts

P = pytest.importorskip("public_tokenizers")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def long_texts():
    """Two near copies of half a MB, a text without white space, one of many short lines."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(1, 9))) for _ in range(4000)]
    one = " ".join(rng.choices(vocabulary, k=90_000))
    words = one.split()
    words[45_000] = "changed"
    other = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200_000))
    lines = "\n".join(" ".join(rng.choices(vocabulary, k=5)) for _ in range(12_000))
    return [one, " ".join(words), other, lines]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    return spark.createDataFrame([(10 + i, t) for i, t in enumerate(long_texts)], "doc_id long, text string").repartition(2)


def test_long_texts_similarity_and_repeats(long_docs, long_texts):
    sets = [len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) > 4 else 1 for w in (t.split() for t in long_texts)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(long_docs).collect()}
    assert got == {10: (sets[0], 10), 11: (sets[1], 10), 12: (sets[2], 12), 13: (sets[3], 13)}
    a, b = (t.encode() for t in long_texts[:2])
    left = next(i for i in range(len(a)) if a[i] != b[i])
    right = next(i for i in range(1, len(a)) if a[-i] != b[-i]) - 1
    out = {r["doc_id"]: r for r in suffix_dedup.passage_dedup(long_docs).collect()}
    assert out[10]["n_removed"] == out[12]["n_removed"] == out[13]["n_removed"] == 0
    assert out[11]["kept_sha256"] == sha(b[left : len(b) - right]) and out[11]["n_spans"] == 2


def test_long_texts_row_by_row(long_docs, long_texts):
    import sentencepiece
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(bpe.read_file(path)))}, special_tokens={})
    by_id = lambda df: {r["doc_id"]: r for r in df.collect()}
    got = by_id(bpe.bpe_digests(long_docs, path, P.PATTERN))
    for i, t in enumerate(long_texts):
        if i != 2:  # the library's own time grows with the square of a word
            ids = library.encode_ordinary(t)
            assert (got[10 + i]["n_tokens"], got[10 + i]["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert got[10 + i]["decoded_sha256"] == sha(t)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert {i: r["n_tokens"] for i, r in by_id(token_counts.token_report(long_docs, P.path("piece_bpe_32k.model"))).items()} == {10 + i: len(sp.encode(t)) for i, t in enumerate(long_texts)}
    assert all(r["n_hex"] == len(re.findall(r"[0-9a-f]{32,}", long_texts[i - 10])) for i, r in by_id(secret_scan.secret_digests(long_docs)).items())
    assert all(r["n_words"] == len(licenses.words_of(long_texts[i - 10])) for i, r in by_id(licenses.license_digests(long_docs)).items())
    report = by_id(merkle.edit_report(long_docs))
    assert {i: r["n_chars"] for i, r in report.items()} == {10 + i: len(t) for i, t in enumerate(long_texts)}
    assert 0.99 < report[11]["near_next"] < 1
    bench = long_docs.select(F.lit(1).alias("item_id"), F.lit(" ".join(long_texts[0].split()[89_000:89_030])).alias("text")).limit(1)
    hit = by_id(decontam.contamination(long_docs, bench))
    assert [hit[10 + i]["contaminated"] for i in range(4)] == [True, True, False, False] and hit[10]["n_hit"] == 30
    model = language.fit(long_docs.withColumn("lang", F.lit("xx")))
    assert {r["lang_pred"] for r in language.predict(long_docs, model).collect()} == {"xx"}


def test_piece_marks_and_odd_characters():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(32)
    odd = ["▁", "▁▁", " ", "  ", "\t", "\n", "\r", "\xa0", " ", "　", "​", "﻿", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "é", "ﬁ", "①", "中", "🙂", "ａ", " ", "\u0085"]
    counters = [token_counts.PieceCounter(bpe.read_file(path), *sizes) for sizes in ((300, 10), (64, 8), (100, 3), (50, 40), (64, 64))]
    for _ in range(150):
        text = "".join(rng.choice(["the", "a", "token", "12"]) + rng.choice([" ", "", rng.choice(odd)]) for _ in range(rng.randint(60, 300)))
        text = rng.choice([text, "".join(rng.choices(odd, k=300)), "▁".join(text)])
        for counter in counters:
            assert counter.exact and counter.count(text) == len(sp.encode(text))
    big = "one▁two " * 6000
    assert token_counts.PieceCounter(bpe.read_file(path)).count(big) == len(sp.encode(big))


def test_what_is_no_letter(spark):
    rows = [(i, "the of and to in is that", "en") for i in range(30)] + [(100, "²", None), (101, "½ 12 ① ٣", None), (102, "...", None), (103, "é", None), (104, "²the½of", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.language_predictions(docs).collect()}
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103][0] == got[104][0] == "en"


def test_languages_with_ties_repeats_and_clashes(spark):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["bb", "aa"] * 20)] + [(7, "same words here", "aa"), (7, None, "aa"), (None, "same", "bb"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit(1)).withColumn("w", F.lit("x")).withColumn("score", F.lit(9))
    balanced = docs.filter("doc_id is not null and doc_id <> 7")
    model = language.fit(balanced, vocabulary=10)
    pred = [(r["id"], r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()]
    assert len(pred) == len(rows) and {p for _, p, s in pred if s} == {"aa" if model.word_scores[0][0] >= model.word_scores[0][1] else "bb"}
    assert [p for i, p, s in pred if not s] == ["und", "und"]
    out = language.language_predictions(docs).collect()
    assert len(out) == len(rows) and not [r for r in out if r["doc_id"] is None and r["held_out"]]
    kept = language.with_language(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    assert language.fit(docs.limit(0)).languages == [] and language.predict(docs, language.fit(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("piece", ["<a ", '<p class="', "<!--", "<head>", "<b>", "<p>a", "</", "<", "<![CDATA[", "<p it's", "&amp", "<script>", "<a title='", "<td><table>", "</title"])
def test_malformed_pages_take_no_longer(piece):
    page = piece * (300_000 // len(piece))
    began = time.time()
    html_crf.leaf_blocks(page + "> end of the page")
    assert time.time() - began < 5


def test_pages_keep_what_follows_a_fault(spark):
    field = html_crf.train()
    text = lambda page: html_crf.main_text(page, field)
    assert text("<article><p>One &lt;b&gt; two.<p>a < b, x<y and 1<2.</article>") == "One <b> two.\na < b, x"
    assert text("<article><p>a&nbsp;b 　c\n\td.</p></article>") == "a b c d."
    assert text("<article><p>Open <!-- comment> and more text here.</p><p>The next one.</p></article>") == "Open and more text here.\nThe next one."
    assert text('<article><p title="open>The first one.</p><p>The next one.</p></article>') == "The first one.\nThe next one."
    assert text("<article><p>It's the whole text here.<p title='a > b' data-x=\"</p>\">Next one.</p><b") == "It's the whole text here.\nNext one."
    assert text("") == text("<") == text("<p") == text("</") == ""
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_crf.page_texts(empty).count() == 0
    clash = spark.createDataFrame([(1, "u", "<article><p>One two three.</p></article>", "x", 1), (None, None, "<article><p>One two three.</p></article>", "x", 1)], "page_id long, url string, html string, text string, id int")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_crf.page_texts(clash).collect()) == [(0, "One two three.", 14), (1, "One two three.", 14)]


#: Pages written by hand, as such sites write them; lines that are the article's begin with a tab.
PAGES = [
    """<!doctype html><html lang=en><head><meta charset=utf-8><title>How bread rises - Kitchen notes</title><style>p{margin:0}</style></head><body>
<header class="site-header"><a href="/">Kitchen notes</a></header>
<nav class="main-menu"><ul><li><a href="/r">Recipes</a></li><li><a href="/t">Tools</a></li></ul></nav>
<main><article class="post">
	<h1>How bread rises</h1>
	<p>Yeast eats sugar and makes gas. The dough holds the gas because gluten forms a net around every bubble.</p>
	<h2>Give it time</h2>
	<p>A slow rise in a cool room gives a better taste than a fast one near the stove.</p>
</article></main>
<section id="comments" class="comments"><div class="comment"><p>Mine never rises, what do I do wrong?</p></div></section>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten soups for the winter</a></li></ul></aside>
<footer>&copy; 2020 Kitchen notes. All rights reserved.</footer></body></html>""",
    """<html><body><div id="cookie-notice" class="notice"><p>We use cookies to make this site better.</p><button>Accept</button></div>
<div id="wrapper"><div class="navbar"><a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a></div>
<div id="content" class="story">
	<h1>Bridge over the river opens after two years</h1>
	<p>The new bridge was opened on Monday by the mayor, who called it a gift to the whole valley.</p>
<div class="advert"><p>Buy two, get one free!</p></div>
	<p>Work began two winters ago and was held up by floods. "We lost three months," said the engineer.</p>
	<blockquote>It will change how people get to work.</blockquote>
<div class="share"><a href="#">Share</a> <a href="#">Print</a></div>
</div><div class="related"><h4>More stories</h4><a href="/2">Road closed again</a></div></div>
<div class="footer"><p>Imprint and contact</p></div></body></html>""",
    """<html><head><title>x</title><script>document.write("<p>not text</p>")</script></head><body><div class="header"><h2>My diary</h2></div>
<div class="entry">
	<h1>A day at the lake</h1>
	<p>We left before six and had the water to ourselves until noon.</p>
	<ul><li>Bring a second towel.</li>
	<li>Do not trust the map at the gate.</li></ul>
	<p>On the way back we stopped for plums.</p>
</div>
<form class="newsletter"><label>Your address</label><input name=mail><button>Subscribe</button></form>
<div id="disqus" class="comments"><h3>2 comments</h3><p>Lovely, thank you for the pictures.</p><p>Which lake is it?</p></div>
<div id="footer">Powered by nothing at all</div></body></html>""",
]


def test_pages_labelled_by_hand():
    field, right, total = html_crf.train(), 0, 0
    for page in PAGES:
        wanted = [" ".join(re.sub(r"<[^>]*>", " ", line).split()) for line in page.split("\n") if line.startswith("\t")]
        blocks = html_crf.leaf_blocks(page)
        labels = field.decode([html_crf.features(b) for b in blocks])
        right += sum((b.text in wanted) == bool(y) for b, y in zip(blocks, labels, strict=True))
        total += len(blocks)
        assert sum(b.text in wanted for b in blocks) == len(wanted)
    assert right / total > 0.9


def test_rows_go_by_their_keys(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("text "), "id").alias("text"), F.lit(1).alias("__bit"))
    for n in (0, 1, 700, 20_000):
        keys = spark.range(n).select((F.col("id") * 7 % 20_000).alias("k")).distinct()
        left = common.without_rows(df, keys, "k")
        assert left.columns == df.columns
        assert {r["k"] for r in left.select("k").collect()} == set(range(20_000)) - {i * 7 % 20_000 for i in range(n)}


def test_fingerprints_with_clashing_columns_and_repeats(spark):
    docs = spark.createDataFrame([(3, "a b", 1, "x"), (3, "a b", 1, "x"), (1, None, 2, "y")], "doc_id long, text string, bucket int, root string").withColumn("key", F.lit(1)).withColumn("n_chars", F.lit(1))
    out = merkle.edit_report(docs).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["near_next"]) for r in out) == [(1, 0, 0.0), (3, 3, 0.0), (3, 3, 1.0)]
