"""Browsing, paging, counts, exports, duplicates, trash: relational operators of the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import ARCHIVE


def browse(df: DataFrame, first: int, offset: int = 0, *, date: str = "document_date", created: str = "created_at", id_col: str = "id") -> DataFrame:
    """A page, newest first and undated last; one row more than asked tells whether there is a next page."""
    if not 1 <= first <= 200 or offset < 0:
        raise ValueError("a page has 1 to 200 rows and starts at 0 or later")
    return df.orderBy(F.col(date).desc_nulls_last(), F.col(created).desc(), F.col(id_col).desc()).offset(offset).limit(first + 1)


def counts_by(df: DataFrame, column: str, wanted: list[str], id_name: str = "n") -> DataFrame:
    """One row: how many rows have each wanted value, 0 where none; a single pass."""
    return df.agg(*[F.count_if(F.col(column) == v).alias(f"{id_name}_{v}") for v in wanted])


def with_last_child(parents: DataFrame, children: DataFrame, key: str, child_key: str, value: str, out: str) -> DataFrame:
    """Parents with the greatest child value: a correlated scalar subquery as one aggregate and a left join."""
    last = children.groupBy(F.col(child_key).alias("__k")).agg(F.max(value).alias(out))
    return parents.join(last, parents[key] == last["__k"], "left").drop("__k")


def missing_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, least: int) -> DataFrame:
    """Parents with fewer than ``least`` children, none included."""
    n = children.groupBy(F.col(child_key).alias("__k")).agg(F.count("*").alias("__n"))
    return parents.join(n, parents[key] == n["__k"], "left").filter(F.coalesce("__n", F.lit(0)) < least).drop("__k", "__n")


def nest_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, order: str, fields: list[str], out: str) -> DataFrame:
    """Parents with their children as an array of structs in order; an empty array where there are none."""
    rows = children.groupBy(F.col(child_key).alias("__k")).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(out))
    return parents.join(rows, parents[key] == rows["__k"], "left").withColumn(out, F.coalesce(out, F.array())).drop("__k")


def duplicates(df: DataFrame, owner: str, digest: str, id_col: str, created: str) -> DataFrame:
    """(owner, digest, ids oldest first) of every group of equal files; one shuffle, no self-join.

    Asked per id, ``duplicates_of`` expands the groups of the asked ids only.
    """
    group = df.filter(F.col(digest).isNotNull()).groupBy(owner, digest).agg(F.array_sort(F.collect_list(F.struct(F.col(created).alias("c"), F.col(id_col).alias("i")))).alias("m"))
    return group.filter(F.size("m") > 1).select(owner, digest, F.transform("m", lambda x: x["i"]).alias("ids"))


def duplicates_of(df: DataFrame, asked: list, owner: str, digest: str, id_col: str, created: str) -> DataFrame:
    """(position, id, checked, others): for each asked id that exists, in the asked order, its other copies oldest first."""
    if len(asked) > 200:
        raise ValueError("at most 200 ids in a call")
    ids = list(dict.fromkeys(asked))
    at = F.array_position(F.array(*[F.lit(x) for x in ids]), F.col(id_col)) - 1
    mine = df.filter(F.col(id_col).isin(*ids)).select(F.col(id_col).alias("id"), F.col(owner).alias("o"), F.col(digest).alias("d"), at.alias("position"))
    other = df.select(F.col(id_col).alias("other"), F.col(owner).alias("o"), F.col(digest).alias("d"), F.col(created).alias("c"))
    both = mine.join(other, ["o", "d"], "left")
    rows = both.groupBy("position", "id", F.col("d").isNotNull().alias("checked")).agg(F.array_sort(F.collect_list(F.when(F.col("other") != F.col("id"), F.struct("c", "other")))).alias("m"))
    return rows.select("position", "id", "checked", F.transform("m", lambda x: x["other"]).alias("others")).orderBy("position")


def csv_cell(value: Column, is_number: bool = False) -> Column:
    """A cell: quoted where it must be; text that a spreadsheet would run gets an apostrophe, numbers do not."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    if not is_number:
        text = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(r'[",\r\n]|^[ \t]|[ \t]$'), quoted).otherwise(text)


def csv_lines(df: DataFrame, columns: list[tuple[str, bool]], line: str = "line") -> DataFrame:
    """Adds the CSV line of (column, is number) cells, ended by CRLF."""
    return df.withColumn(line, F.concat(F.concat_ws(",", *[csv_cell(F.col(c), n) for c, n in columns]), F.lit("\r\n")))


def rename_rank(df: DataFrame, owner: str, title: str, created: str, id_col: str) -> DataFrame:
    """Titles numbered within (owner, title in any case) in order of creation: the first keeps its name, others get " (n)"."""
    w = Window.partitionBy(owner, F.lower(title)).orderBy(created, id_col)
    n = F.row_number().over(w)
    return df.withColumn("n", n).withColumn("new_title", F.when(F.col("n") == 1, F.col(title)).otherwise(F.concat(F.col(title), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))))


def trash_due(df: DataFrame, deleted: str, cutoff: str) -> DataFrame:
    """Trashed rows whose time is up: deleted at or before the cutoff."""
    return df.filter(F.col(deleted).isNotNull() & (F.col(deleted) <= F.lit(cutoff).cast("timestamp_ntz")))


def purge(parents: DataFrame, due: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What is left of the parents and of each child table once the due parents and all their rows are gone."""
    gone = due.select(F.col(key).alias("__k"))
    left = parents.join(gone, parents[key] == gone["__k"], "left_anti")
    return left, {name: df.join(gone, df[k] == gone["__k"], "left_anti") for name, (df, k) in children.items()}


def trash_folder(documents: DataFrame, folder_ids: list, now: str, *, folder: str = "folder_id", deleted: str = "deleted_at") -> DataFrame:
    """Documents with those in the folders trashed and taken out of them; what was trashed before keeps its time."""
    inside = F.col(folder).isin(*folder_ids) if folder_ids else F.lit(False)
    return documents.withColumn("__in", F.coalesce(inside, F.lit(False))).withColumn(deleted, F.when(F.col("__in"), F.coalesce(F.col(deleted), F.lit(now).cast("timestamp"))).otherwise(F.col(deleted))).withColumn(folder, F.when(~F.col("__in"), F.col(folder))).drop("__in")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows and those of the new ones whose key is free; of equal new keys the first by key order stays."""
    fresh = new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace existing ones of the same key."""
    return existing.join(new.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(new)


def in_asked_order(df: DataFrame, ids: list, id_col: str) -> DataFrame:
    """Rows of the asked ids, in that order; unknown ids drop out, repeated ones come once."""
    at = F.array_position(F.array(*[F.lit(x) for x in dict.fromkeys(ids)]), F.col(id_col))
    return df.filter(F.col(id_col).isin(*ids)).withColumn("position", at - 1).orderBy("position")


def natural_key(name: Column) -> Column:
    """A key that sorts "page 2" before "page 10": digit runs are padded to twenty places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def receipts_order(df: DataFrame, *, date: str = "document_date", title: str = "title") -> DataFrame:
    """By date, undated last, then title."""
    return df.orderBy(F.col(date).asc_nulls_last(), F.col(title))


def queue_list(documents: DataFrame, steps: DataFrame, state: str, now: str, first: int = ARCHIVE.list_limit, hours: int = ARCHIVE.finished_hours) -> DataFrame:
    """The documents in one state of the queue with ``finished_at``, the end of their last step; no more than ``first``.

    What runs or waits comes in the order in which it was handed over (updated_at); what failed or has finished within the last
    ``hours`` comes latest first, by the last step's end, else by updated_at. Ties go by id. Trashed documents are in no list.
    """
    status = {"running": "processing", "queued": "uploaded", "failed": "failed", "finished": "ready"}
    if state not in status:
        raise ValueError(f"no state {state}")
    last = steps.groupBy(F.col("document_id").alias("__d")).agg(F.max("finished_at").alias("finished_at"))
    rows = documents.filter((F.col("status") == status[state]) & F.col("deleted_at").isNull()).join(last, F.col("id") == F.col("__d"), "left").drop("__d")
    if state == "finished":
        rows = rows.filter(F.col("finished_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))
    by = F.col("updated_at").asc() if state in ("running", "queued") else F.coalesce("finished_at", "updated_at").desc()
    return rows.orderBy(by, F.col("id").asc()).limit(first)


def trash_list(df: DataFrame, *, deleted: str = "deleted_at", title: str = "title") -> DataFrame:
    """Trashed rows, the latest first; what was trashed at once by title."""
    return df.filter(F.col(deleted).isNotNull()).orderBy(F.col(deleted).desc(), F.col(title).asc())


def reset_metadata(df: DataFrame, found: DataFrame, fields: dict[str, list[str]], id_col: str = "id") -> DataFrame:
    """Rows of ``found`` get its values back: ``fields`` names, for each source column, the values that go with it.

    What a user has set is forgotten, so the source is ``auto`` again where a value was found and null where none was.
    """
    names = [c for cs in fields.values() for c in cs]
    fresh = found.select(F.col(id_col).alias("__k"), *[F.col(c).alias(f"__{c}") for c in names])
    rows = df.join(fresh, F.col(id_col) == F.col("__k"), "left")
    hit, out = F.col("__k").isNotNull(), {}
    for source, own in fields.items():
        out |= {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in own}
        out[source] = F.when(hit, F.when(F.coalesce(*[F.col(f"__{c}").cast("string") for c in own]).isNotNull(), "auto")).otherwise(F.col(source))
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in df.columns])
