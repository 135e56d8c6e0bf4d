"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

1. Corpus frequencies of the benchmark's words are counted over all documents.
2. Every benchmark window (``window`` consecutive words of an item; the whole item if it is shorter) is
   searched from its two rarest words. Those words make the index vocabulary.
3. The index is stored: one posting (word, document, position) for each place where a word of that
   vocabulary stands in the corpus, with the words around it as payload. Documents are read in blocks of
   words that overlap by a window on either side, so no posting copies a long text.
4. Postings of a window's rarest word are shifted by the word's place in the window; so are those of the
   second rarest; the lists are intersected on (document, start). What remains is compared with the
   whole window in the payload, word for word: exact phrases. ``proximity_matches`` finds, instead, all
   starts where at least ``least`` of the words stand within ``slack`` places of where the item has them; it
   searches from as many rarest words as no such start can lack.

Joins with the benchmark's vocabulary are broadcast only when its size, which is counted first, is under
``BROADCAST_WORDS``; else they are ordinary joins. Null texts have no words. Items without words have no
windows. Documents are told apart by a key of id and text, so null ids and repeated ids with other texts are
judged each by its own words; the matches' functions take ids as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import row_key, without_rows

#: Rows of benchmark words up to which they are broadcast.
BROADCAST_WORDS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts of one byte a character take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII controls, spaces and signs (digits and letters stay)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_WORDS else df


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, w, size): the distinct windows of every item as arrays of words."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(lowered(F.col(text_col))).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("w")).distinct().withColumn("size", F.size("w"))


def _blocks(documents: DataFrame, id_col: str, text_col: str, window: int, block: int) -> DataFrame:
    """(doc_id, base, ws, first, last): overlapping blocks of words; the block answers for its words from ``first`` to ``last``."""
    ws = documents.select(F.col(id_col).alias("doc_id"), words(lowered(F.col(text_col))).alias("all"))
    cut = ws.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(block)), lambda b: F.struct(F.greatest(b - window, F.lit(0)).alias("base"), b.alias("first"), F.slice("all", F.greatest(b - window, F.lit(0)) + 1, block + 2 * window).alias("ws")))).alias("b"))
    return cut.select("doc_id", "b.base", "b.first", "b.ws")


def build_index(documents: DataFrame, vocabulary: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", window: int = 10, block: int = 64) -> DataFrame:
    """The positional index: (word, doc_id, pos, before, around) for each place of a word of ``vocabulary``.

    ``around`` has the words from ``before`` words ahead of the place to a window after it.
    """
    placed = _blocks(documents, id_col, text_col, window, block).select("doc_id", "base", "first", "ws", F.posexplode("ws").alias("at", "word"))
    placed = placed.filter((F.col("base") + F.col("at") >= F.col("first")) & (F.col("base") + F.col("at") < F.col("first") + block))
    hits = placed.join(_small(vocabulary.select("word"), size), "word")
    before = F.least(F.col("at"), F.lit(window - 1))
    return hits.select("word", "doc_id", (F.col("base") + F.col("at")).cast("long").alias("pos"), before.alias("before"), F.slice("ws", F.col("at") - before + 1, before + window).alias("around"))


def _anchors(windows: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each window with the places of its two rarest words (place2 is null for windows of one word)."""
    from pyspark.sql import Window

    each = windows.select("item_id", "w", "size", F.posexplode("w").alias("place", "word")).join(frequency, "word", "left").fillna(0, ["n"])
    rank = F.row_number().over(Window.partitionBy("item_id", "w").orderBy("n", "word", "place"))
    two = each.withColumn("r", rank).filter("r <= 2")
    return two.groupBy("item_id", "w", "size").agg(
        F.max(F.when(F.col("r") == 1, F.struct("place", "word"))).alias("a"), F.max(F.when(F.col("r") == 2, F.struct("place", "word"))).alias("b")
    ).select("item_id", "w", "size", F.col("a.place").alias("place1"), F.col("a.word").alias("word1"), F.col("b.place").alias("place2"), F.col("b.word").alias("word2"))


def phrase_matches(documents: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(doc_id, item_id, start, size) of every occurrence of a window; starts count words from 0."""
    windows = scratch.keep(item_windows(benchmark, item_col, item_text_col, window), "windows")
    vocabulary = windows.select(F.explode("w").alias("word")).distinct()
    size = vocabulary.count()
    spoken = documents.select(F.explode(words(lowered(F.col(text_col)))).alias("word")).join(_small(vocabulary, size), "word")
    frequency = scratch.keep(spoken.groupBy("word").agg(F.count("*").alias("n")), "frequency")
    anchors = scratch.keep(_anchors(windows, frequency), "anchors")
    n_windows = anchors.count()
    sought = anchors.select(F.col("word1").alias("word")).union(anchors.filter("word2 is not null").select("word2")).distinct()
    index = scratch.keep(build_index(documents, sought, size, id_col, text_col, window), "index")
    # offset-adjusted lists: where the window would start, by its rarest word and by its second rarest
    key = F.xxhash64("item_id", "w").alias("win")
    one = _small(anchors.select(key, "item_id", "w", "size", F.col("word1").alias("word"), F.col("place1").alias("place"), F.col("word2").isNull().alias("alone")), n_windows)
    two = _small(anchors.filter("word2 is not null").select(key, F.col("word2").alias("word"), F.col("place2").alias("place")), n_windows)
    start = (F.col("pos") - F.col("place")).alias("start")
    at = F.col("before") - F.col("place")
    fits = (at >= 0) & (at + F.col("size") <= F.size("around"))
    list1 = index.join(one, "word").filter(fits).select("win", "doc_id", start, "item_id", "w", "size", "alone", "around", at.alias("at"))
    list2 = index.select("word", "doc_id", "pos").join(two, "word").select("win", "doc_id", start)
    both = list1.filter("not alone").join(list2, ["win", "doc_id", "start"], "left_semi").unionByName(list1.filter("alone"))
    # what is on both lists is compared with the whole window, in the words that the posting carries
    whole = F.slice("around", F.greatest(F.col("at") + 1, F.lit(1)).cast("int"), F.col("size")) == F.col("w")
    return both.filter(whole).select("doc_id", "item_id", "start", "size")


def _covered(keyed: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str, item_col: str, item_text_col: str, window: int) -> DataFrame:
    """(row, n_hit, items) of the rows that hold a window, by the column ``__row``."""
    found = phrase_matches(keyed, benchmark, scratch, "__row", text_col, item_col, item_text_col, window).distinct()
    return found.groupBy(F.col("doc_id").alias("__row")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document, row by row: ids may be null or repeated."""
    keyed = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("__row", row_key("doc_id", "text"))
    with Scratch(documents.sparkSession) as scratch:
        covered = scratch.keep(_covered(keyed, benchmark, scratch, "text", item_col, item_text_col, window), "covered")
        rows = keyed.select("__row", "doc_id", F.size(words(lowered(F.col("text")))).cast("long").alias("n_words"))
        n = covered.count()
        out = rows.join(_small(covered, n), "__row", "left")
        none = F.array().cast("array<string>")
        return scratch.result(
            out.select(
                "doc_id",
                "n_words",
                F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
                (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            ),
            "contamination",
        )


def decontaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with all their columns, row by row: ids may be null or repeated."""
    keyed = documents.withColumn("__row", row_key(id_col, text_col))
    with Scratch(documents.sparkSession) as scratch:
        bad = scratch.result(_covered(keyed, benchmark, scratch, text_col, item_col, item_text_col, window).select("__row"), "bad")
    return without_rows(keyed, bad, "__row").select(*documents.columns)


def _rarest(windows: DataFrame, frequency: DataFrame, least: int) -> DataFrame:
    """(item_id, w, size, place, word): as many of each window's rarest places that no match of ``least`` words misses all of them."""
    from pyspark.sql import Window

    each = windows.select("item_id", "w", "size", F.posexplode("w").alias("place", "word")).join(frequency, "word", "left").fillna(0, ["n"])
    rank = F.row_number().over(Window.partitionBy("item_id", "w").orderBy("n", "word", "place"))
    return each.withColumn("r", rank).filter(F.col("r") <= F.col("size") - F.least(F.lit(least), F.col("size")) + 1).select("item_id", "w", "size", "place", "word")


def proximity_matches(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, least: int = 8, slack: int = 2) -> DataFrame:
    """(doc_id, item_id, start, near): all starts where ``least`` of a window's words stand within ``slack`` of their place.

    A match lacks at most size - least words, so one of any size - least + 1 places has its word within ``slack``.
    Every window is searched from that many of its rarest places, at all starts that put the word found there within
    ``slack``; postings carry the words that any of these starts reaches. A start may lie before the text's first word.
    """
    with Scratch(documents.sparkSession) as scratch:
        windows = scratch.keep(item_windows(benchmark, item_col, item_text_col, window), "windows")
        vocabulary = windows.select(F.explode("w").alias("word")).distinct()
        size = vocabulary.count()
        spoken = documents.select(F.explode(words(lowered(F.col(text_col)))).alias("word")).join(_small(vocabulary, size), "word")
        frequency = scratch.keep(spoken.groupBy("word").agg(F.count("*").alias("n")), "frequency")
        anchors = scratch.keep(_rarest(windows, frequency, least), "anchors")
        # from a place of a window, at a start within slack of it, words up to window - 1 + 2 slack away are looked at
        index = build_index(documents, anchors.select("word").distinct(), size, id_col, text_col, window + 2 * slack)
        hits = index.join(_small(anchors, anchors.count()), "word")

        def near(shift: Column) -> Column:
            at = F.col("before") - F.col("place") + shift  # where in the payload the window would start

            def held(x: Column, i: Column) -> Column:
                first = F.greatest(at + i - slack, F.lit(0))
                return F.array_contains(F.slice("around", (first + 1).cast("int"), F.greatest(at + i + slack + 1 - first, F.lit(0)).cast("int")), x)

            return F.size(F.filter(F.transform(F.col("w"), held), lambda ok: ok))

        shifts = F.array(*[F.struct(F.lit(d).alias("shift"), near(F.lit(d)).alias("near")) for d in range(-slack, slack + 1)])
        rows = hits.select("doc_id", "item_id", "pos", "place", F.explode(F.filter(shifts, lambda x: x["near"] >= F.least(F.lit(least), F.col("size")))).alias("m"))
        return scratch.result(rows.groupBy("doc_id", "item_id", (F.col("pos") - F.col("place") + F.col("m.shift")).alias("start")).agg(F.max("m.near").alias("near")), "proximity")
