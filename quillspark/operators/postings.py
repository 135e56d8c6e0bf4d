"""An index of words: postings with positions in blocks, and a top-k that leaves out blocks that cannot win.

The index is a table of one row for each (term, block): the greatest number of the term's places in one passage of the block, and
the passages with their places. A passage's block is the same for all terms. Blocks hold about ``BLOCK`` passages of about equal length, so
that the long ones, in which words stand often, are together.

A query reads its own terms' rows only (each file is sorted by term, so row groups and pages without them are skipped). What a block can
score at most follows from those numbers: a stretch that covers all words of a conjunction has its rarest word in it, and
one place of a word is in as many shortest covers as there are words, at most. The blocks with the highest bounds are
scored first; then those whose bound still reaches the k-th best score, and no others. The answer is that of a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..settings import SEARCH
from .search import Term, cover_rank, covers_of_hits, matches, parse_query, ranked

#: Passages of a block.
BLOCK = 128
#: Size classes: four to each doubling of a passage's length, so a hundred or so at most.
_CLASSES = 4
#: Bytes of passages whose words one task gathers, and those below which it is not worth another task.
PART_BYTES, LEAST_BYTES = 8 << 20, 1 << 18


def index_words(passages: DataFrame, *, id_col: str = "id", document: str = "document_id", content: str = "content", block: int = BLOCK) -> DataFrame:
    """(term, block, most, entries array<struct<id, document_id, at>>) of passages; ``at`` counts words from 0.

    Write the result as it is: files hold whole blocks and are sorted by term. Only the passages themselves are shuffled, once, by
    block; what their words come to is gathered where the block is.
    """
    rows = passages.select(F.col(id_col).alias("id"), F.col(document).alias("document_id"), F.col(content).alias("content")).filter("content is not null")
    rows = rows.withColumn("class", F.floor(F.log2(F.length("content") + 1) * _CLASSES).cast("int"))
    # one number for each class; there are no more classes than sizes double
    sizes = {r["class"]: r for r in rows.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes")).collect()}
    if not sizes:
        spread = F.lit(1)
    else:
        spread = F.create_map(*[F.lit(x) for c, r in sizes.items() for x in (c, max(1, -(-r["n"] // block)))])[F.col("class")]
    size = sum(r["bytes"] for r in sizes.values())
    # a task gathers no more than PART_BYTES; small tables are dealt out as far as it pays
    parts = max(1, size // PART_BYTES, min(size // LEAST_BYTES, int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    number = F.shiftleft(F.col("class").cast("long"), 40) + F.pmod(F.xxhash64("id"), spread)
    dealt = rows.select(number.alias("block"), "id", "document_id", "content").repartition(parts, "block")
    return _packed(dealt.select("block", "id", "document_id", F.posexplode(words(F.col("content"))).alias("p", "term")))


def _packed(places: DataFrame) -> DataFrame:
    """The rows of an index of (block, id, document_id, p, term), which lie together by block."""
    entries = places.groupBy("block", "term", "id", "document_id").agg(F.array_sort(F.collect_list("p")).alias("at"))
    packed = entries.groupBy("block", "term").agg(F.max(F.size("at")).alias("most"), F.collect_list(F.struct("id", "document_id", "at")).alias("entries"))
    return packed.select("term", "block", "most", "entries").sortWithinPartitions("term", "block")


def _bound(ways: list[list[str]]) -> Column:
    """The most that a passage of a block can score, from the numbers of its terms (a map); null where no alternative can hold.

    The scorer adds up the covers of every alternative, whether it holds or not, so the bound does too.
    """
    total, any_ = F.lit(0.0), F.lit(False)
    for terms in ways:
        least = F.least(*[F.coalesce(F.col("most")[t], F.lit(0)) for t in terms], F.lit(1 << 30)) if terms else F.lit(0)
        total = total + 0.1 * len(terms) * least
        any_ = any_ | (least > 0)
    return F.when(any_, total)


def _held(at: Column, query: list[list[Term]]) -> Column:
    """Whether a passage holds for the query, from the places of its terms (a map)."""

    def one(t: Term) -> Column:
        first = at[t.words[0]]
        hit = first.isNotNull()
        if len(t.words) > 1:
            follows = lambda p: _all([F.coalesce(F.array_contains(at[w], p + k), F.lit(False)) for k, w in enumerate(t.words) if k])
            hit = F.coalesce(F.exists(first, follows), F.lit(False))
        return hit if t.wanted else ~hit

    out = F.lit(False)
    for way in query:
        out = out | _all([one(t) for t in way])
    return out


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def _hits(places: Column, number: int) -> Column:
    return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda p: F.struct(p.alias("i"), F.lit(number).alias("w")))


def _scored(index: DataFrame, blocks: DataFrame, query: list[list[Term]], allowed: DataFrame | None) -> DataFrame:
    """(id, document_id, score) of the passages of some blocks that hold for the query."""
    # bounds are one small row for each block of a term; Spark broadcasts them if they are small
    rows = index.join(blocks.select("block"), "block", "left_semi").select("term", F.explode("entries").alias("e")).select("term", "e.id", "e.document_id", "e.at")
    if allowed is not None:
        rows = rows.join(allowed, "document_id", "left_semi")
    found = rows.groupBy("id", "document_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "at"))).alias("places")).filter(_held(F.col("places"), query))
    total = F.lit(0.0)
    for way in query:
        wanted = sorted({w for t in way if t.wanted for w in t.words})
        if wanted:
            hits = [_hits(F.col("places")[w], k) for k, w in enumerate(wanted, 1)]
            total = total + covers_of_hits(F.array_sort(F.flatten(F.array(*hits))), len(wanted))
    return found.select("id", "document_id", total.alias("score"))


def top_passages(index: DataFrame, query: list[list[Term]] | str, k: int = SEARCH.pool, *, allowed: DataFrame | None = None, passages: DataFrame | None = None, first: int | None = None) -> DataFrame:
    """(id, document_id, score, rank): the ``k`` best passages for a query, as a scan would rank them.

    ``allowed`` (document_id) holds before anything is ranked. ``passages`` (id, document_id, content) is needed only for queries
    with an alternative of nothing but refusals, for which no list of places exists. ``first`` is the number of blocks that are
    scored before the others are judged by the k-th best score.
    """
    ways = parse_query(query) if isinstance(query, str) else query
    if any(not any(t.wanted for t in way) for way in ways):
        if passages is None:
            raise ValueError("a query of refusals alone has no words to look up")
        mine = passages.join(allowed, "document_id", "left_semi") if allowed is not None else passages
        tokens = words(F.col("content"))
        return ranked(mine.filter(matches(tokens, ways)).withColumn("__s", cover_rank(tokens, ways)), F.col("__s"), "id", k).select("id", "document_id", "score", "rank")
    terms = sorted({w for way in ways for t in way for w in t.words})
    mine = index.filter(F.col("term").isin(*terms))
    wanted = [sorted({w for t in way if t.wanted for w in t.words}) for way in ways]
    numbers = mine.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", "most"))).alias("most"))
    bounds = numbers.select("block", _bound(wanted).alias("bound")).filter(F.col("bound").isNotNull())
    size = first or max(4, -(-4 * k // BLOCK))
    leaders = bounds.orderBy(F.desc("bound"), "block").limit(size)
    # k numbers at most come to the driver
    best = [r["score"] for r in _scored(mine, leaders, ways, allowed).select("score").orderBy(F.desc("score")).limit(k).collect()]
    least = best[k - 1] if len(best) == k else 0.0
    # bounds are products of small numbers, so they are compared with a little room
    chosen = bounds.filter(F.col("bound") * (1 + 1e-9) >= least)
    return ranked(_scored(mine, chosen, ways, allowed), F.col("score"), "id", k).select("id", "document_id", "score", "rank")


def with_passages(top: DataFrame, passages: DataFrame) -> DataFrame:
    """The ranked passages with their text; ``top`` is k rows."""
    return passages.join(F.broadcast(top.select("id", "score", "rank")), "id")


def words_leg(index: DataFrame, passages: DataFrame, query: list[list[Term]], pool: int, allowed: DataFrame | None = None) -> DataFrame:
    """The words leg of a search: the passages' columns with score and rank."""
    return with_passages(top_passages(index, query, pool, allowed=allowed, passages=passages), passages)


def merged_index(index: DataFrame, passages: DataFrame, changed: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The next version of an index: postings of the changed documents (document_id) are taken out, those of ``passages`` put in.

    Only rows with such postings change. New passages make blocks of their own numbers, beside the old ones of their class, so a block may
    come to hold two versions' passages; bounds stay right, as the greater number counts.
    """
    gone = changed.select("document_id").distinct()
    entries = index.select("term", "block", F.explode("entries").alias("e")).select("term", "block", "e.id", "e.document_id", "e.at")
    kept = entries.join(gone, "document_id", "left_anti")
    fresh = index_words(passages, block=block).select("term", "block", F.explode("entries").alias("e")).select("term", "block", "e.id", "e.document_id", "e.at")
    both = kept.unionByName(fresh)
    packed = both.groupBy("term", "block").agg(F.max(F.size("at")).alias("most"), F.collect_list(F.struct("id", "document_id", "at")).alias("entries"))
    return packed.repartitionByRange("term", "block").sortWithinPartitions("term", "block")


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, passages, places): how many passages have each word, and how often it stands in all of them."""
    n = F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + F.size(e["at"]))
    return index.groupBy("term").agg(F.sum(F.size("entries")).alias("passages"), F.sum(n).alias("places"))

