"""Free names: the smallest " (n)" that no folder or document of the place has yet, in any case."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from ..settings import ARCHIVE


def free_name(name: str, taken: set[str], most: int = ARCHIVE.title_chars, reached: dict[str, int] | None = None) -> str:
    """``name`` or its first free numbering; ``taken`` is lower-cased. The name is cut so that the number fits, and blanks before it go.

    ``reached`` remembers up to which number a name has been tried: names are never given back, so none below is free.
    """
    if name[:most].lower() not in taken:
        return name[:most]
    reached = {} if reached is None else reached
    n = reached.get(name.lower(), 2)
    while True:
        tail = f" ({n})"
        tried = name[: most - len(tail)].rstrip() + tail
        n += 1
        if tried.lower() not in taken:
            reached[name.lower()] = n
            return tried


def assign_names(new: DataFrame, taken: DataFrame, owner: str = "user_id", folder: str = "folder_id", name: str = "title", order: str | list[str] = "created_at", most: int = ARCHIVE.title_chars) -> DataFrame:
    """Adds ``new_name``: each new row gets a free name in its folder, in order; each given name is taken from then on.

    Names depend on each other only within (owner, folder, name without its number, in any case). Where all new names of such a group are
    one, however many rows have it, the k-th row takes the k-th number that is free (see ``_by_rank``), over many tasks. Groups in which
    new names differ ("Scan" beside "Scan (7)"), or are too long for a number to fit, are gone through in order as a stream.
    Rows that are equal in ``order`` stand in any order.
    """
    orders = [order] if isinstance(order, str) else order
    stem = F.substring(F.lower(F.regexp_replace(F.regexp_replace(F.col(name), r"( \(\d+\))+$", ""), r"\s+$", "")), 1, most - 12)
    keyed = lambda df: df.withColumn("__owner", F.coalesce(F.col(owner).cast("string"), F.lit(""))).withColumn("__folder", F.coalesce(F.col(folder).cast("string"), F.lit(""))).withColumn("__stem", F.coalesce(stem, F.lit(""))).withColumn("__name", F.coalesce(F.col(name), F.lit("")))
    with Scratch(new.sparkSession) as scratch:
        fresh, held = keyed(new), keyed(taken).select(*_KEYS, "__name")
        groups = fresh.groupBy(*_KEYS).agg(F.min("__name").alias("low"), F.max("__name").alias("high"), F.count("*").alias("__n"))
        # a number of up to ten digits fits behind these
        plain = groups.filter((F.col("low") == F.col("high")) & (F.length("low") <= most - 13))
        plain = scratch.keep(plain.select(*_KEYS, F.col("low").alias("__base")), "plain")
        ranked = _by_rank(fresh.join(plain, _KEYS), held.join(plain, _KEYS), orders, scratch)
        mixed = _in_order(fresh.join(plain.select(*_KEYS), _KEYS, "left_anti"), held.join(plain.select(*_KEYS), _KEYS, "left_anti"), orders, most)
        return scratch.result(ranked.select(*new.columns, "new_name").unionByName(mixed.select(*new.columns, "new_name")), "names")


_KEYS = ["__owner", "__folder", "__stem"]
#: Gaps between taken numbers that stand in one row, which are joined to the ranks they serve.
_SPAN = 4096


def _placed(rows: DataFrame, orders: list[str], place: str, scratch: Scratch) -> DataFrame:
    """Adds each row's place within its group, from 1, without gathering a group: rows are sorted by range, parts count theirs."""
    rows = scratch.keep(rows.repartitionByRange(*_KEYS, *orders).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(*_KEYS, "__part").agg(F.count("*").alias("n"))
    # a row for each group and part
    before = counts.withColumn("__before", F.sum("n").over(Window.partitionBy(*_KEYS).orderBy("__part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy(*_KEYS, "__part").orderBy(*orders))
    return rows.withColumn(place, within).join(before, [*_KEYS, "__part"]).withColumn(place, F.col(place) + F.col("__before")).drop("__part", "__before")


def _by_rank(new: DataFrame, taken: DataFrame, orders: list[str], scratch: Scratch) -> DataFrame:
    """Every row takes the k-th free number of its group, k being its rank: number 1 is the bare name, number n has " (n)" behind it.

    The j taken numbers below the gap in which a rank falls are added to it; gaps are cut into spans of ranks, by
    which rows and gaps meet.
    """
    ranked = _placed(new, orders, "__k", scratch)
    bare = F.regexp_replace("__base", r"\s+$", "")
    low, head = F.lower("__name"), F.concat(F.lower(bare), F.lit(" ("))
    inside = F.expr("substring(lower(__name), length(__head) + 1, length(__name) - length(__head) - 1)")
    numbered = F.startswith(low, F.col("__head")) & F.endswith(low, F.lit(")")) & inside.rlike(r"^[1-9][0-9]{0,9}$")
    number = F.when(low == F.lower("__base"), F.lit(1)).when(numbered & (inside.cast("long") > 1), inside.cast("long"))
    used = taken.withColumn("__head", head).select(*_KEYS, number.cast("long").alias("t")).filter("t is not null").distinct()
    # the i-th taken number t leaves t - i free numbers below it; ranks up to there have i - 1 taken ones below them
    gaps = _placed(used, ["t"], "i", scratch).select(*_KEYS, (F.col("t") - F.col("i") + 1).alias("since"), F.col("i").alias("skip"))
    # of gaps of no width the last counts; then each holds up to the next
    gaps = gaps.groupBy(*_KEYS, "since").agg(F.max("skip").alias("skip"))
    following = F.lead("since").over(Window.partitionBy(*_KEYS).orderBy("since"))
    most = new.groupBy(*_KEYS).agg(F.count("*").alias("__most"))
    spans = gaps.withColumn("until", following).join(most, _KEYS).filter("since <= __most").withColumn("until", F.least(F.coalesce("until", F.col("__most") + 1), F.col("__most") + 1))
    spans = spans.withColumn("__s", F.explode(F.sequence(F.floor(F.col("since") / _SPAN), F.floor((F.col("until") - 1) / _SPAN))))
    gathered = spans.groupBy(*_KEYS, "__s").agg(F.array_sort(F.collect_list(F.struct("since", "skip"))).alias("__gaps"))
    met = ranked.withColumn("__s", F.floor(F.col("__k") / _SPAN)).join(gathered, [*_KEYS, "__s"], "left")
    skip = F.coalesce(F.try_element_at(F.filter("__gaps", lambda g: g["since"] <= F.col("__k")), F.lit(-1))["skip"], F.lit(0))
    n = F.col("__k") + skip
    return met.withColumn("new_name", F.when(n == 1, F.col("__base")).otherwise(F.concat(bare, F.lit(" ("), n.cast("string"), F.lit(")"))))


def _in_order(new: DataFrame, taken: DataFrame, orders: list[str], most: int) -> DataFrame:
    """Rows are sorted by group, taken ones first, and gone through as a stream: a task holds the taken names of one group."""
    fresh, held = new.withColumn("__new", F.lit(True)), taken.withColumn("__new", F.lit(False))
    columns = [c for c in new.columns if not c.startswith("__")]

    def run(batches):
        used, reached, now = set(), {}, None
        for batch in batches:
            mask, names = [], []
            for key, text, is_new in zip(zip(*[batch.column(k).to_pylist() for k in _KEYS], strict=True), batch.column("__name").to_pylist(), batch.column("__new").to_pylist(), strict=True):
                if key != now:
                    used, reached, now = set(), {}, key
                if is_new:
                    text = free_name(text, used, most, reached)
                    names.append(text)
                used.add(text.lower())
                mask.append(is_new)
            kept = batch.filter(pa.array(mask, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in columns], pa.array(names, pa.string())], [*columns, "new_name"])

    schema = T.StructType([*[new.schema[c] for c in columns], T.StructField("new_name", T.StringType())])
    rows = fresh.unionByName(held, allowMissingColumns=True).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "__new", *orders)
    return rows.mapInArrow(run, schema)


def restored(documents: DataFrame, asked: DataFrame, tree: DataFrame, *, owner: str = "user_id", folder: str = "folder_id", name: str = "title", deleted: str = "deleted_at") -> DataFrame:
    """The table with the asked documents (id) out of the trash: in their folder if that still exists, else on the top level.

    Names that were taken meanwhile get the next free number, in the order in which the documents were made.
    """
    back = documents.filter(F.col(deleted).isNotNull()).join(asked.select("id").distinct(), "id", "left_semi")
    there = tree.select(F.col("id").alias("__f"))
    back = back.join(there, F.col(folder) == F.col("__f"), "left").withColumn(folder, F.col("__f")).drop("__f").withColumn(deleted, F.lit(None).cast(documents.schema[deleted].dataType))
    live = documents.filter(F.col(deleted).isNull())
    named = assign_names(back, live, owner, folder, name).withColumn(name, F.col("new_name")).select(*documents.columns)
    return documents.join(back.select("id"), "id", "left_anti").select(*documents.columns).unionByName(named)
