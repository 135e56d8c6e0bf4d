"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of text, with DataFrame functions only.

Leaves are pieces of a paragraph. A word whose hash says so (one in ``PIECE``) ends a leaf, and in a run of more
than ``LONG`` characters without white space a character (one in ``LONG``), so an edit moves no boundary but
those at its own place; a leaf has no greatest length. A paragraph is a line; its node digests its leaves. A section is a run of paragraphs that ends at a blank line or
where a paragraph's digest says so (one in eight), so here too an edit moves no later boundary; its node digests
its paragraphs. The root digests the sections. Every character is in exactly one leaf, so equal roots mean
equal texts.

A node digests the whole SHA-256 digests of what is below it, up to the root, so roots test equality. A fingerprint shows
the tree as ``root|section/section...``, a section as ``node:paragraph;paragraph...``, a paragraph as
``node=leaf.leaf...``; below the root, digests are shown by their first ``SHOWN`` hex digits.

Two trees are compared from the root down: equal roots end it, sections that both trees hold are equal as a whole,
only the others' paragraphs are looked at, and only the leaves of paragraphs that differ. ``likeness`` counts the
leaves below equal nodes; ``differing_places`` gives the paths to the branches that differ.

Null is the empty text. Two empty texts are equal. Repeated rows are rows like any other: a text's next one may be its own
copy. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Words in a leaf, on average.
PIECE = 5
#: Characters up to which a word is not cut; on average as many characters of a longer one are a leaf.
LONG = 24
SHOWN = 12
#: Documents in a range of ids on average, ranges at least, and rows up to which the ranges' edges are broadcast.
RANGE_ROWS, LEAST_RANGES, BROADCAST_EDGES = 20_000, 2048, 200_000


def _digest(mark: str, below: Column) -> Column:
    return F.sha2(F.concat(F.lit(mark), below), 256)


def _shown(digest: Column) -> Column:
    return F.substring(digest, 1, SHOWN)


def tree(text: Column) -> Column:
    """The paragraphs of the tree: array<struct<node, leaves array<string>, last boolean>>; ``last`` ends a section."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    # short words, single characters of long ones, each with the white space before it; what is left ends the line
    units = lambda p: F.regexp_extract_all(p, F.lit(rf"(?s)\s*+(?:\S{{1,{LONG}}}+(?!\S)|\S)|\s++"), F.lit(0))
    ends = lambda u: F.pmod(F.xxhash64(u), F.when(F.length(u) == 1, F.lit(LONG)).otherwise(F.lit(PIECE))) == 0
    # a line holds no line feed, so it can mark the ends of leaves
    marked = lambda p: F.array_join(F.transform(units(p), lambda u: F.when(ends(u), F.concat(u, F.lit("\n"))).otherwise(u)), "")
    leaves = F.transform(lines, lambda p: F.transform(F.filter(F.split(marked(p), "\n"), lambda x: x != ""), lambda x: F.sha2(x, 256)))
    nodes = F.transform(leaves, lambda x: F.struct(_digest("p", F.array_join(x, ".")).alias("node"), x.alias("leaves")))
    return F.transform(nodes, lambda x: F.struct(x["node"].alias("node"), x["leaves"].alias("leaves"), ((F.size(x["leaves"]) == 0) | (F.substring(x["node"], 1, 1).isin("0", "8"))).alias("last")))


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds the fingerprint of ``text_col`` as column ``out``."""
    # paragraphs in order, whole digest first, a mark after each section's last one, split at the marks: the sections
    shown = lambda x: F.concat(_shown(x["node"]), F.lit("="), F.array_join(F.transform(x["leaves"], _shown), "."))
    marked = F.array_join(F.transform("__tree", lambda x: F.concat(x["node"], shown(x), F.when(x["last"], F.lit("/")).otherwise(F.lit(";")))), "")
    paragraphs = F.transform(F.filter(F.split(marked, "/"), lambda s: s != ""), lambda s: F.filter(F.split(s, ";"), lambda p: p != ""))
    sections = F.transform(
        paragraphs,
        lambda ps: F.struct(
            _digest("s", F.array_join(F.transform(ps, lambda p: F.substring(p, 1, 64)), ".")).alias("node"),
            F.array_join(F.transform(ps, lambda p: F.substring(p, F.lit(65), F.length(p))), ";").alias("below"),
        ),
    )
    root = _digest("r", F.array_join(F.transform("__sections", lambda s: s["node"]), "."))
    below = F.array_join(F.transform("__sections", lambda s: F.concat(_shown(s["node"]), F.lit(":"), s["below"])), "/")
    return df.withColumn("__tree", tree(F.col(text_col))).withColumn("__sections", sections).withColumn(out, F.concat_ws("|", root, below)).drop("__tree", "__sections")


def _root(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, "|", 1)


def _sections(fingerprint: Column) -> Column:
    return F.split(F.substring_index(fingerprint, "|", -1), "/")


def _paragraphs(section: Column) -> Column:
    return F.split(F.substring_index(section, ":", -1), ";")


def _leaves(paragraph: Column) -> Column:
    return F.split(F.substring_index(paragraph, "=", -1), r"\.")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds how alike two columns of fingerprints are: 1 for equal roots, else below 1.

    It is the share of leaves that are equal, or lie below equal nodes, among the different leaves of both; a
    paragraph without leaves counts as one.
    """
    below = lambda nodes: F.aggregate(nodes, F.lit(0), lambda n, x: n + F.size(F.split(x, "[.;]")))
    down = lambda nodes, step: F.flatten(F.transform(nodes, step))
    same_root = _root(F.col(a)) == _root(F.col(b))
    none = F.array().cast("array<string>")
    # each level as columns of its own, so that nothing is worked out twice
    out_df = df.withColumn("__xa", F.when(same_root, none).otherwise(_sections(F.col(a)))).withColumn("__xb", F.when(same_root, none).otherwise(_sections(F.col(b)))).withColumn("__same", F.lit(0))
    for step in (_paragraphs, _leaves, None):
        out_df = (
            out_df.withColumn("__both", F.array_intersect("__xa", "__xb"))
            .withColumn("__same", F.col("__same") + (below(F.col("__both")) if step else F.size("__both")))
            .withColumn("__ya", F.array_except("__xa", "__xb"))
            .withColumn("__yb", F.array_except("__xb", "__xa"))
            .withColumn("__xa", down(F.col("__ya"), step) if step else F.col("__ya"))
            .withColumn("__xb", down(F.col("__yb"), step) if step else F.col("__yb"))
        )
    twice, apart = 2.0 * F.col("__same"), F.size("__xa") + F.size("__xb")
    # the same leaves in another order or number: not equal
    share = F.when(apart > 0, twice / (twice + apart)).otherwise(twice / (twice + 1.0))
    return out_df.withColumn(out, F.when(same_root, 1.0).otherwise(share).cast("double")).drop("__xa", "__xb", "__ya", "__yb", "__both", "__same")


def differing_places(a: Column, b: Column) -> Column:
    """The paths (section, paragraph, leaf; from 0) of ``a``'s branches that ``b`` does not hold, none if the roots are equal.

    A branch that differs though ``b`` holds all that is below it, in another order or number, is given itself: leaf -1, and
    paragraph -1 if it is a section. Look from ``b``, too, for what was only added there.
    """
    path = lambda s, p, x: F.struct(F.lit(s).cast("int").alias("section") if isinstance(s, int) else s.cast("int").alias("section"), F.lit(p).cast("int").alias("paragraph") if isinstance(p, int) else p.cast("int").alias("paragraph"), F.lit(x).cast("int").alias("leaf") if isinstance(x, int) else x.cast("int").alias("leaf"))
    or_self = lambda found, own: F.when(F.size(found) > 0, found).otherwise(F.array(own))
    others = F.array_except(_sections(b), _sections(a))
    paragraphs_b = F.flatten(F.transform(others, _paragraphs))
    leaves_b = F.flatten(F.transform(paragraphs_b, _leaves))
    none = F.array().cast("array<struct<section:int,paragraph:int,leaf:int>>")

    def in_paragraph(p: Column, i: Column, j: Column) -> Column:
        found = F.filter(F.transform(_leaves(p), lambda x, k: F.when(F.array_contains(leaves_b, x), F.lit(-1)).otherwise(k)), lambda k: k >= 0)
        return or_self(F.transform(found, lambda k: path(i, j, k)), path(i, j, -1))

    def in_section(s: Column, i: Column) -> Column:
        found = F.flatten(F.transform(_paragraphs(s), lambda p, j: F.when(F.array_contains(paragraphs_b, p), none).otherwise(in_paragraph(p, i, j))))
        return or_self(found, path(i, -1, -1))

    sections = F.flatten(F.transform(_sections(a), lambda s, i: F.when(F.array_contains(_sections(b), s), none).otherwise(in_section(s, i))))
    return F.when(_root(a) == _root(b), none).otherwise(or_self(sections, path(-1, -1, -1)))


def with_next(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each document with the one that follows in descending id; after the last, the first.

    Ids are dealt into ranges of equal width, as many as the number of documents asks for. A range's largest row is also
    sent to the range that comes before it in order, where it follows the smallest; so texts are shuffled once and no
    window spans all rows. Ties of ids go by text. Null ids come last.
    """
    from pyspark.sql import Window

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ends = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).first()
    low, ranges = ends["a"] or 0, max(LEAST_RANGES, -(-ends["n"] // RANGE_ROWS))
    width = max(1, -(-((ends["b"] or 0) - low + 1) // ranges))
    away = F.col("doc_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)") if max(abs(low), abs(ends["b"] or 0)) >= 1 << 62 else F.col("doc_id") - low
    bucket = F.coalesce(F.floor(away / width).cast("int"), F.lit(-1))
    # the first row of each range in descending order, by (id, digest of the text)
    order = F.struct(F.col("doc_id").isNotNull().alias("given"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.sha2("text", 256).alias("h"))
    with Scratch(documents.sparkSession) as scratch:
        tops = scratch.result(rows.groupBy(bucket.alias("bucket")).agg(F.max(order).alias("top")), "tops")
    small = F.broadcast if ranges <= BROADCAST_EDGES else lambda df: df
    around = Window.orderBy("bucket")  # over one short row a range
    above = tops.select("bucket", F.lead("bucket").over(around).alias("up"), F.min("bucket").over(Window.partitionBy()).alias("lowest"))
    # the range above gets this range's top row; the very first row wraps around to the lowest range
    sent = small(above.select("bucket", F.coalesce("up", "lowest").alias("to")).join(tops, "bucket"))
    keyed = rows.withColumn("bucket", bucket).withColumn("key", order)
    guests = keyed.join(sent, (keyed.bucket == sent.bucket) & (keyed.key == sent.top), "left_semi").dropDuplicates(["key"])
    moved = guests.join(sent.select(F.col("bucket").alias("b"), "to"), guests.bucket == F.col("b")).select("doc_id", "text", F.col("to").alias("bucket"), "key", F.lit(True).alias("guest"))
    both = keyed.select("doc_id", "text", "bucket", "key", F.lit(False).alias("guest")).unionByName(moved)
    along = Window.partitionBy("bucket").orderBy("guest", F.desc("key"))
    return both.withColumn("next_text", F.lead("text").over(along)).filter("not guest").select("doc_id", "text", "next_text")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    return with_fingerprint(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "fingerprint").select("doc_id", "fingerprint")


def edit_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    pairs = with_next(documents, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = pairs.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    # fingerprints are made after the texts have moved: they would move as much again
    for column, out in (("text", "fp"), ("next_text", "next_fp"), ("edited", "edited_fp")):
        rows = with_fingerprint(rows, column, out)
    rows = with_likeness(with_likeness(rows, "fp", "edited_fp", "near_edited"), "fp", "next_fp", "near_next")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")
