"""Backup: the paths of an export in three trees, its manifest checked field by field, and an import that files nothing twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import safe_name
from ..session import Scratch

#: What a manifest says it is; a caller with archives of another program names that program's.
FORMAT, VERSION = "quillspark-export", 1
#: Characters of a document's id that tell two equal paths apart.
TIE_CHARS = 8
MANIFEST = "id string, path string, checksum_sha256 string, title string, document_date date, document_date_source string, vendor string, total string, currency string, receipt_source string"


def original_ending(filename: Column, title: Column) -> Column:
    """The ending that an original keeps, in lower case: its file's, unless the title has it already."""
    ending = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"[^/](\.[^./]*)$", 1))
    return F.when(F.endswith(F.lower(title), ending), F.lit("")).otherwise(ending)


def _allocated(rows: DataFrame, base: str, ending: str, scratch: Scratch) -> DataFrame:
    """(id, path): in order of (created_at, id) each gets base and ending, or, where that is taken in any case, base, part of its id, ending.

    Who comes first at a path is found by an aggregate, so a path that very many share is no task of its own. A path with part
    of an id may be what a later document asks for: such a one is told too, until none is found.
    """
    asked = scratch.keep(rows.select("id", F.struct("created_at", "id").alias("at"), F.concat(base, ending).alias("plain"), F.concat(F.col(base), F.lit(" ("), F.substring(F.col("id").cast("string"), 1, TIE_CHARS), F.lit(")"), F.col(ending)).alias("tied")), "asked")
    firsts = asked.groupBy(F.lower("plain").alias("k")).agg(F.min("at").alias("first"))
    first = scratch.keep(firsts.select("k", "first", F.col("first.id").alias("id")), "firsts")
    told = asked.join(first.select("id", "k"), "id", "left").select("id", "at", "plain", "tied", F.col("k").isNull().alias("late"))
    fresh = told.filter("late")
    while True:
        taken = fresh.groupBy(F.lower("tied").alias("k")).agg(F.min("at").alias("since"))
        lost = scratch.keep(first.join(taken, "k").filter(F.col("since") < F.col("first")).select("id", "k"), "lost")
        if lost.isEmpty():
            return told.select("id", F.when(F.col("late"), F.col("tied")).otherwise(F.col("plain")).alias("path"))
        first = scratch.keep(first.join(lost.select("id"), "id", "left_anti"), "firsts")
        told = scratch.keep(told.join(lost.select("id", F.lit(True).alias("__lost")), "id", "left").withColumn("late", F.col("late") | F.coalesce("__lost", F.lit(False))).drop("__lost"), "told")
        fresh = told.join(lost.select("id"), "id", "left_semi")


def export_plan(documents: DataFrame, tree: DataFrame) -> DataFrame:
    """The documents that are neither trashed nor still uploading, with original_path, archive_path and text_path.

    Files are named after the title, in their folder's path, each kind in a tree of its own, unique in any case. A document without
    archive_key or content_key has no such path. ``documents`` has id, title, folder_id, original_filename, status, created_at, deleted_at,
    archive_key, content_key, content_format; ids are unique.
    """
    own = documents.filter("deleted_at is null and status <> 'pending_upload'")
    folders = tree.select(F.col("id").alias("__f"), F.col("path").alias("__folder"))
    rows = own.join(folders, F.col("folder_id") == F.col("__f"), "left").drop("__f")
    text_end = F.when(F.col("content_format") == "markdown", ".md").otherwise(".txt")
    with Scratch(documents.sparkSession) as scratch:
        named = rows.select("id", "created_at", F.concat_ws("/", "__folder", safe_name(F.col("title"))).alias("base"), original_ending(F.col("original_filename"), F.col("title")).alias("original"), F.lit(".pdf").alias("archive"), text_end.alias("text"), "archive_key", "content_key")
        named = scratch.keep(named, "named")
        out = own
        for kind, tree_name, has in (("original", "originals", None), ("archive", "archive", "archive_key"), ("text", "text", "content_key")):
            some = named.filter(F.col(has).isNotNull()) if has else named
            paths = _allocated(some, "base", kind, scratch).select(F.col("id").alias("__id"), F.concat(F.lit(f"{tree_name}/"), "path").alias(f"{kind}_path"))
            out = out.join(scratch.result(paths, kind), F.col("id") == F.col("__id"), "left").drop("__id")
        return out


# The fields of a document in a manifest and what they hold; ? may be null, day is a calendar day, size a whole number from 0.
FIELDS = {
    "id": "string", "title": "string", "folder": "string?", "originalFilename": "string", "mimeType": "string", "sizeBytes": "size", "checksumSha256": "string?", "status": "string", "ocrRequested": "boolean", "createdAt": "string",
    "documentDate": "day?", "documentDateSource": "source?", "vendor": "string?", "total": "string?", "currency": "string?", "receiptSource": "source?",
    "files.original": "string?", "files.archive": "string?", "files.text": "string?",
}
SOURCES = ("extracted", "user")


def _read_field(value: Column, path: str) -> Column:
    """A field of a variant as (shape, text): the shape is null where it is missing, VOID where it is null."""
    return F.struct(F.schema_of_variant(F.try_variant_get(value, f"$.{path}", "variant")).alias("shape"), F.try_variant_get(value, f"$.{path}", "string").alias("text"))


def _problem(field: Column, kind: str, path: str) -> Column:
    """What is wrong with a field as ``_read_field`` gives it, or null."""
    shape, text = field["shape"], field["text"]
    rules = {
        "string": (shape == "STRING", "is no text"),
        "path": ((shape == "STRING") & (text != ""), "is no text of one character or more"),
        "boolean": (shape == "BOOLEAN", "is neither true nor false"),
        "size": (((shape == "BIGINT") | shape.startswith("DECIMAL")) & text.rlike(r"^\d+$"), "is no whole number from 0"),
        "day": ((shape == "STRING") & text.rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), "is no calendar day"),
        "source": ((shape == "STRING") & text.isin(*SOURCES), f"is none of {', '.join(SOURCES)}"),
    }
    fits, complaint = rules[kind.rstrip("?")]
    if kind.endswith("?"):
        fits = fits | (shape == "VOID")
    return F.when(shape.isNull(), f"{path} is missing").when(~F.coalesce(fits, F.lit(False)), f"{path} {complaint}")


def _once(value: Column) -> Column:
    """A column that is worked out once a row: a generator of one row, into which no later filter or column is merged."""
    return F.explode(F.array(value))


def read_manifests(manifests: DataFrame, format_name: str = FORMAT, version: int = VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, folders, errors) of manifests (archive, text), each one JSON text.

    Documents have archive, place and the fields as columns; folders archive, path and mcpEnabled, parents first by ``depth``. Errors are
    (archive, place, problem): a text that is no JSON, another format or version, and every field that is missing or of
    the wrong kind, with the place of its document or folder. Only rows without an error are among documents and folders, and none of an
    archive whose head is wrong. Unknown fields are left out.
    """
    schema = "format variant, version variant, exportedAt variant, folders array<variant>, documents array<variant>, _corrupt string"
    read = manifests.select("archive", _once(F.from_json(F.coalesce(F.col("text"), F.lit("")), schema, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})).alias("m")).select("archive", "m.*")
    text = lambda c: F.try_variant_get(c, "$", "string")
    is_ = lambda c, shape: F.coalesce(F.schema_of_variant(c) == shape, F.lit(False))
    head = F.array_compact(
        F.array(
            F.when(F.col("_corrupt").isNotNull() | F.col("format").isNull() & F.col("version").isNull() & F.col("documents").isNull(), "is no manifest in JSON"),
            F.when(~(is_(F.col("format"), "STRING") & (text(F.col("format")) == format_name)), f"format is not {format_name}"),
            F.when(~(is_(F.col("version"), "BIGINT") & (text(F.col("version")) == str(version))), f"version is not {version}"),
            F.when(~is_(F.col("exportedAt"), "STRING"), "exportedAt is no text"),
            F.when(F.col("folders").isNull(), "folders is no list"),
            F.when(F.col("documents").isNull(), "documents is no list"),
        )
    )
    with_head = read.select("archive", "documents", "folders", _once(F.element_at(F.concat(head, F.array(F.lit(None).cast("string"))), 1)).alias("__head"))
    # one list of all items of an archive, so that its text is read once: what is wrong with the head, or documents and folders
    item = lambda kind, n, v: F.struct(F.lit(kind).alias("kind"), n.alias("n"), v.alias("v"))
    listed = F.concat(F.transform("documents", lambda v, n: item("documents", n, v)), F.transform("folders", lambda v, n: item("folders", n, v)))
    wrong = F.array(item("manifest", F.lit(0), F.lit(None).cast("variant")))
    items = with_head.select("archive", "__head", F.explode(F.when(F.col("__head").isNull(), listed).otherwise(wrong)).alias("i")).select("archive", "__head", "i.*")
    kinds = {"documents": FIELDS, "folders": {"path": "path", "mcpEnabled": "boolean"}}
    fields = [F.when(F.col("kind") == name, F.struct(*[_read_field(F.col("v"), path).alias(f"f{k}") for k, path in enumerate(some)])).alias(name) for name, some in kinds.items()]
    seen = items.select("archive", "__head", "kind", "n", "v", _once(F.struct(*fields)).alias("f"))
    found_wrong = F.when(F.col("kind") == "manifest", F.array("__head"))
    for name, some in kinds.items():
        found_wrong = found_wrong.when(F.col("kind") == name, F.array_compact(F.array(*[_problem(F.col("f")[name][f"f{k}"], kind, path) for k, (path, kind) in enumerate(some.items())])))
    place = F.when(F.col("kind") == "manifest", "manifest").otherwise(F.concat("kind", F.lit("["), F.col("n").cast("string"), F.lit("]")))
    checked = seen.select("archive", "kind", place.alias("place"), "v", _once(found_wrong).alias("problems"))
    errors = checked.select("archive", "place", F.explode("problems").alias("problem"))
    docs, folders = (checked.filter(F.col("kind") == name) for name in kinds)
    types = {"size": "long", "boolean": "boolean", "day": "date"}
    column = lambda path, kind: F.try_variant_get(F.col("v"), f"$.{path}", types.get(kind.rstrip("?"), "string")).alias(path.replace("files.", "files_"))
    documents = docs.filter(F.size("problems") == 0).select("archive", "place", *[column(p, k) for p, k in FIELDS.items()])
    path = F.variant_get(F.col("v"), "$.path", "string")
    found = folders.filter(F.size("problems") == 0).select("archive", path.alias("path"), F.variant_get(F.col("v"), "$.mcpEnabled", "boolean").alias("mcpEnabled"), F.size(F.split(path, "/")).alias("depth"))
    return documents, found, errors


def manifest_documents(plan: DataFrame, tree: DataFrame) -> DataFrame:
    """(id, line): each planned document as it stands in the manifest, a line of JSON; ``plan`` is that of ``export_plan`` with all its columns."""
    folders = tree.select(F.col("id").alias("__f"), F.col("path").alias("folder"))
    rows = plan.join(folders, F.col("folder_id") == F.col("__f"), "left")
    fields = {
        "id": F.col("id").cast("string"), "title": F.col("title"), "folder": F.col("folder"), "originalFilename": F.col("original_filename"), "mimeType": F.col("mime_type"), "sizeBytes": F.col("size_bytes"), "checksumSha256": F.col("checksum_sha256"), "status": F.col("status"),
        "ocrRequested": F.col("ocr_requested"), "createdAt": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "documentDate": F.col("document_date").cast("string"), "documentDateSource": F.col("document_date_source"), "vendor": F.col("vendor"), "total": F.col("total"),
        "currency": F.col("currency"), "receiptSource": F.col("receipt_source"), "files": F.struct(F.col("original_path").alias("original"), F.col("archive_path").alias("archive"), F.col("text_path").alias("text")),
    }
    return rows.select("id", F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"}).alias("line"))


def import_plan(manifest: DataFrame, files: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, action): skipped if the checksum is filed, failed if the file is missing or differs, else imported.

    ``files`` has path and content; of equal files in one backup the first path is imported. Paths are unique. The first path of a checksum
    is found by an aggregate, so a file that very many copies have is no task of its own.
    """
    have = files.select("path", F.sha2("content", 256).alias("actual"))
    known = existing.select(F.col("checksum_sha256").alias("known")).distinct()
    rows = manifest.join(have, "path", "left").join(known, F.col("checksum_sha256") == F.col("known"), "left")
    firsts = manifest.groupBy("checksum_sha256").agg(F.min("path").alias("path")).select("path", F.lit(True).alias("__first"))
    action = F.when(F.col("known").isNotNull(), "skipped").when(F.col("actual").isNull() | (F.col("actual") != F.col("checksum_sha256")), "failed").when(F.col("__first").isNull(), "skipped").otherwise("imported")
    return rows.join(firsts, "path", "left").select("path", action.alias("action"))
