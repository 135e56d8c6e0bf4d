"""Folder trees: paths, descendants, inherited sharing. Levels are joined one by one; trees are shallow and folders few beside documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.decode import folder_name_ok
from ..session import Scratch
from .filters import SearchFilter, compile_filter
from .relational import natural_key

# Files that systems leave behind.
IGNORED_FILES = ("desktop.ini", "thumbs.db")


def folder_tree(folders: DataFrame, *, id_col: str = "id", parent: str = "parent_id", name: str = "name", shared: str | None = None, orphans_on_top: bool = False) -> DataFrame:
    """(id, path, depth, ids from the top, visible, nearest_shared) of every folder that hangs on the top.

    ``visible`` holds if the folder or one above it is shared, ``nearest_shared`` is the closest such one. Folders on
    a cycle never hang on the top and are left out; with ``orphans_on_top`` those whose parent is missing count as top.
    """
    rows = folders.select(F.col(id_col).alias("id"), F.col(parent).alias("parent"), F.col(name).alias("name"), (F.coalesce(F.col(shared), F.lit(False)) if shared else F.lit(False)).alias("shared"))
    if orphans_on_top:
        known = rows.select(F.col("id").alias("known"))
        rows = rows.join(known, rows.parent == known.known, "left").withColumn("parent", F.col("known")).drop("known")
    top = rows.filter("parent is null").select("id", F.col("name").alias("path"), F.lit(1).alias("depth"), F.array("id").alias("ids"), F.col("shared").alias("visible"), F.when(F.col("shared"), F.col("id")).alias("nearest_shared"))
    with Scratch(folders.sparkSession) as scratch:
        level = scratch.keep(top, "level")
        levels = [level]
        while True:  # from the top down no cycle is ever met, so this ends with the deepest folder
            up = level.select(F.col("id").alias("above"), "path", "depth", "ids", "visible", "nearest_shared")
            level = rows.join(up, rows.parent == up.above).select(
                "id", F.concat_ws("/", "path", "name").alias("path"), (F.col("depth") + 1).alias("depth"), F.concat("ids", F.array("id")).alias("ids"), (F.col("visible") | F.col("shared")).alias("visible"), F.when(F.col("shared"), F.col("id")).otherwise(F.col("nearest_shared")).alias("nearest_shared")
            )
            level = scratch.keep(level, "level")
            if level.isEmpty():
                break
            levels.append(level)
        out = levels[0]
        for x in levels[1:]:
            out = out.unionByName(x)
        return scratch.result(out, "tree")


def descendants(tree: DataFrame, root) -> DataFrame:
    """The folder itself and all below it, from the top down; ``tree`` as made above."""
    return tree.filter(F.array_contains("ids", root)).select("id", "path", (F.col("depth") - F.array_position("ids", root)).alias("below")).orderBy("below", "path")


def visible_folders(tree: DataFrame) -> DataFrame:
    """Folders that are shared, by themselves or from above, by path."""
    return tree.filter("visible").select("id", "path").orderBy("path")


def within(tree: DataFrame, path: str) -> DataFrame:
    """The folder at a path and all below, in any case."""
    low = F.lower("path")
    return tree.filter((low == path.lower()) | low.startswith(path.lower() + "/"))


def document_at(documents: DataFrame, tree: DataFrame, path: str, *, folder: str = "folder_id", title: str = "title") -> DataFrame:
    """The document at folder path and title, in any case; none at the top level."""
    parts = [p.strip() for p in path.split("/") if p.strip()]
    if len(parts) < 2:
        return documents.limit(0)
    at = tree.filter(F.lower("path") == "/".join(parts[:-1]).lower()).select(F.col("id").alias("__f"))
    return documents.filter(F.lower(title) == parts[-1].lower()).join(F.broadcast(at.limit(1)), F.col(folder) == F.col("__f"), "left_semi")


def path_prefixes(paths: DataFrame, path: str = "path") -> DataFrame:
    """Every folder that the paths need, top down: what "find or create" has to look for."""
    parts = F.split(path, "/")
    return paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()


def missing_paths(paths: DataFrame, tree: DataFrame, path: str = "path", documents: DataFrame | None = None) -> DataFrame:
    """(path, depth, and with ``documents`` conflict): folders to create for the paths, in order of depth; names are compared in any case.

    ``conflict`` holds if a document stands at the path of the folder, or of a folder above it that would have to be made.
    """
    want = path_prefixes(paths, path)
    have = tree.select(F.lower("path").alias("__p"))
    fresh = want.join(have, F.lower(want["path"]) == have["__p"], "left_anti").withColumn("k", F.lower("path")).groupBy("k").agg(F.min("path").alias("path"))
    rows = fresh.select("path", F.size(F.split("path", "/")).alias("depth"))
    if documents is not None:
        there = archive_entries(documents, tree).select(F.lower("path").alias("__at")).distinct()
        above = rows.select(F.col("path").alias("__p"), F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda n: F.lower(F.array_join(F.slice(F.split("path", "/"), 1, n), "/")))).alias("__at"))
        hit = above.join(there, "__at", "left_semi").select("__p").distinct()
        rows = rows.join(hit, rows.path == hit["__p"], "left").select("path", "depth", F.col("__p").isNotNull().alias("conflict"))
    return rows.orderBy("depth", "path")


def upload_plan(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of the files of a picked folder: (path, name, folder) to upload, and (path) of folders whose name cannot be one.

    A refused folder is told once, the outermost only, and nothing below it is taken. Hidden files, files that an office program locks,
    system files, and what lies in folders that a system keeps for itself, are left out without a word.
    """
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    rows = files.select(F.col(path).alias("path"), parts.alias("__parts")).filter(F.size("__parts") > 0)
    name, above = F.try_element_at("__parts", F.lit(-1)), F.slice("__parts", F.lit(1), F.greatest(F.size("__parts") - 1, F.lit(0)))
    junk = name.startswith(".") | name.startswith("~$") | F.lower(name).isin(*IGNORED_FILES) | F.exists(above, lambda d: F.substring(d, 1, 1).isin(*".@#$"))
    rows = rows.filter(~junk).select("path", name.alias("name"), above.alias("__above"))
    bad = F.array_position(F.transform("__above", lambda p: folder_name_ok(p)), False)
    rows = rows.withColumn("__bad", bad)
    refused = rows.filter("__bad > 0").select(F.array_join(F.slice("__above", F.lit(1), F.col("__bad").cast("int")), "/").alias("path")).distinct()
    return rows.filter("__bad = 0").select("path", "name", F.array_join("__above", "/").alias("folder")), refused


def entry_tree(entries: DataFrame) -> DataFrame:
    """(path, type, name, parent, depth, made, place): one tree of files and folders (path, type file or dir).

    Folders that only their contents name are made (``made``). Slashes at the ends or doubled name no folder, and an entry of slashes alone is
    left out. A file and a folder may share a path. Sorted by ``place`` the tree reads from the top down, in each folder folders first,
    then by name, digits as numbers: so siblings come in order without being gathered in one task.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    own = entries.select(parts.alias("p"), "type", F.lit(False).alias("made")).filter(F.size("p") > 0)
    above = own.filter(F.size("p") > 1).select(F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("n"), "p").select(F.slice("p", F.lit(1), F.col("n")).alias("p"), F.lit("dir").alias("type"), F.lit(True).alias("made"))
    nodes = own.unionByName(above).groupBy("p", "type").agg(F.min("made").alias("made"))
    rank = lambda i: F.when((i == F.size("p") - 1) & (F.col("type") == "file"), 1).otherwise(0)
    place = F.transform("p", lambda x, i: F.struct(rank(i).alias("rank"), natural_key(x).alias("key"), x.alias("name")))
    return nodes.select(F.array_join("p", "/").alias("path"), "type", F.try_element_at("p", F.lit(-1)).alias("name"), F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/").alias("parent"), F.size("p").alias("depth"), "made", place.alias("place"))


def in_folders(documents: DataFrame, tree: DataFrame, roots: list, include_subfolders: bool = True, *, folder: str = "folder_id") -> DataFrame:
    """Documents in the folders, and, unless told otherwise, in those below them. A folder that is not there holds nothing."""
    if not roots:
        return documents.limit(0)
    asked = F.array(*[F.lit(r) for r in roots])
    hit = F.arrays_overlap("ids", asked) if include_subfolders else F.array_contains(asked, F.col("id"))
    return documents.join(tree.filter(hit).select(F.col("id").alias("__f")), F.col(folder) == F.col("__f"), "left_semi")


def filtered(documents: DataFrame, tree: DataFrame, asked: SearchFilter, include_subfolders: bool = True) -> DataFrame:
    """The documents that a filter leaves, its folders taken with all below them unless told otherwise."""
    rows = documents.filter(compile_filter(replace(asked, folder_ids=None)))
    return rows if asked.folder_ids is None else in_folders(rows, tree, list(asked.folder_ids), include_subfolders)


def archive_entries(documents: DataFrame, tree: DataFrame, *, folder: str = "folder_id", title: str = "title") -> DataFrame:
    """(id, path): where each document stands, folder path and title; those on the top level are under their title alone."""
    at = tree.select(F.col("id").alias("__f"), F.col("path").alias("__p"))
    return documents.join(at, F.col(folder) == F.col("__f"), "left").select("id", F.concat_ws("/", "__p", title).alias("path"))


def subtree_counts(documents: DataFrame, tree: DataFrame, *, folder: str = "folder_id") -> DataFrame:
    """(id, path, documents, below): documents in each folder, and in it and all folders below."""
    own = documents.filter(F.col(folder).isNotNull()).groupBy(F.col(folder).alias("__f")).agg(F.count("*").alias("n"))
    counted = tree.join(own, tree.id == F.col("__f"), "left").select("id", "path", "ids", F.coalesce("n", F.lit(0)).alias("n"))
    below = counted.select(F.explode("ids").alias("__above"), "n").groupBy("__above").agg(F.sum("n").alias("below"))
    return counted.join(below, counted.id == F.col("__above")).select("id", "path", F.col("n").cast("long").alias("documents"), "below")


def nested(tree: DataFrame, *, parent_of: str = "ids") -> DataFrame:
    """(id, path, depth, children): each folder with its children in order of their names' natural order."""
    up = tree.filter("depth > 1").select(F.element_at(parent_of, -2).alias("__p"), F.struct(natural_key(F.element_at(F.split("path", "/"), -1)).alias("k"), F.col("id").alias("id")).alias("c"))
    children = up.groupBy("__p").agg(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["id"]).alias("children"))
    return tree.join(children, tree.id == F.col("__p"), "left").select("id", "path", "depth", F.coalesce("children", F.array().cast(tree.schema["ids"].dataType)).alias("children"))


def valid_moves(moves: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, to, valid): a folder may go to the top (null) or below a folder that exists, is neither itself nor below itself, and is not where it is already."""
    target = tree.select(F.col("id").alias("__t"), "ids")
    known = tree.select(F.col("id").alias("__k"), F.try_element_at("ids", F.lit(-2)).alias("__parent"))
    rows = moves.join(target, F.col("to") == F.col("__t"), "left").join(known, F.col("id") == F.col("__k"), "left")
    fits = F.col("to").isNull() | (F.col("__t").isNotNull() & ~F.coalesce(F.array_contains("ids", F.col("id")), F.lit(False)))
    return rows.select("id", "to", (F.col("__k").isNotNull() & fits & ~F.col("to").eqNullSafe(F.col("__parent"))).alias("valid"))
