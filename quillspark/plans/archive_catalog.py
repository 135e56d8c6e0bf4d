"""More of the archive's operators over the driver's tables: scopes, paths, suggestions, candidates, texts, names, uploads, steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, decode
from ..operators import hierarchy, linkage, processing, relational, suggestions
from ..operators.filters import scoped
from ..session import table
from .catalog import _TREE, registered
from .views import customer_documents, folders, order_documents

NOW = "2026-01-01 00:20:00"


@registered("SELECT o_orderkey AS id FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'")
def tenancy_scope(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of one customer as that user's documents: those of low priority are in the trash, those of status P still uploading."""
    docs = order_documents(spark, sf)
    docs = docs.withColumn("deleted_at", F.when(F.col("title") == "5-LOW", F.col("created_at"))).withColumn("status", F.when(F.col("status") == "processing", "pending_upload").otherwise(F.col("status")))
    return scoped(docs, docs.agg(F.min("user_id")).first()[0], status="status").select("id")


@registered("SELECT c_custkey AS id, r_name || '/' || n_name || '/' || c_mktsegment AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def archive_paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.archive_entries(customer_documents(spark, sf), hierarchy.folder_tree(folders(spark, sf)))


@registered(_TREE + "SELECT id, path FROM t WHERE lower(path) = 'europe' OR starts_with(lower(path), 'europe/')")
def folders_within(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.within(hierarchy.folder_tree(folders(spark, sf)), "Europe").select("id", "path")


@registered("SELECT count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'O') AS queued, CAST(0 AS BIGINT) AS failed, count(*) FILTER (o_orderstatus = 'F' AND (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) >= TIMESTAMP '1995-01-01' - INTERVAL 24 HOUR) AS finished FROM orders")
def queue_totals(spark: SparkSession, sf: str) -> DataFrame:
    docs = order_documents(spark, sf).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_shipdate").cast("timestamp").alias("finished_at"))
    return processing.queue_counts(docs, steps, "1995-01-01")


_LINKS = "l AS (SELECT doc_id // 4 AS member_key, doc_id AS f, doc_id + 1 AS t, round(CAST(0.3 AS DOUBLE) + CAST(0.1 AS DOUBLE) * (doc_id % 7), 6) AS h FROM labels), v AS (SELECT doc_id AS f, doc_id + 1 AS t, quality = 1 AS continues, 0.25 + toxic / 2 AS c FROM labels WHERE doc_id % 3 = 0)"


def _links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Labels as steps of suggestions, four a suggestion, and answers about every third."""
    rows, i = table(spark, sf, "labels"), F.col("doc_id")
    ends = (i.alias("from_id"), (i + 1).alias("to_id"))
    links = rows.select(F.floor(i / 4).alias("member_key"), *ends, F.round(0.3 + 0.1 * (i % 7), 6).alias("heuristic"))
    return links, rows.filter(i % 3 == 0).select(*ends, (F.col("quality") == 1).alias("continues"), (0.25 + F.col("toxic") / 2).alias("certainty"))


@registered(f"WITH {_LINKS} SELECT member_key, round(min(h), 9) AS heuristic_confidence, round(min(CASE WHEN continues IS NULL THEN h ELSE 1 / (1 + exp(-(ln(h / (1 - h)) + 3.0 * c * CASE WHEN continues THEN 1 ELSE -1 END))) END), 9) AS confidence FROM l LEFT JOIN v ON l.f = v.f AND l.t = v.t GROUP BY member_key")
def suggestion_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = linkage.suggestion_confidence(*_links(spark, sf))
    return scores.select("member_key", F.round("heuristic_confidence", 9).alias("heuristic_confidence"), F.round("confidence", 9).alias("confidence"))


@registered(f"WITH {_LINKS} SELECT f AS from_id, t AS to_id FROM l WHERE h BETWEEN 0.4 AND 0.85 AND NOT EXISTS (SELECT 1 FROM v WHERE v.f = l.f AND v.t = l.t) AND NOT (f % 5 = 0 AND f % 2 = 0)")
def steps_to_ask(spark: SparkSession, sf: str) -> DataFrame:
    """Steps in the model's band that have no answer; of those that failed, every second one did so within the last half hour."""
    links, verdicts = _links(spark, sf)
    failed = F.when(F.col("from_id") % 2 == 0, "2026-01-01 00:00:00").otherwise("2025-12-31 23:00:00").cast("timestamp")
    failures = links.filter("from_id % 5 = 0").select("from_id", "to_id", failed.alias("failed_at"))
    return linkage.steps_to_ask(links, verdicts, failures, NOW).select("from_id", "to_id")


@registered("WITH d AS (SELECT doc_id FROM documents WHERE lang <> 'de' AND text IS NOT NULL) SELECT l.doc_id AS member_key FROM labels l WHERE EXISTS (SELECT 1 FROM d WHERE d.doc_id = l.doc_id) AND EXISTS (SELECT 1 FROM d WHERE d.doc_id = l.doc_id + 1)")
def live_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as suggestions of two neighbours; German documents are in the trash, those without text are not ready."""
    stored = table(spark, sf, "labels").select(F.col("doc_id").alias("member_key"), F.array(F.col("doc_id"), F.col("doc_id") + 1).alias("document_ids"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("text").isNull(), "failed").otherwise("ready").alias("status"), F.when(~(F.col("lang") != "de") | F.col("lang").isNull(), F.lit(NOW)).alias("deleted_at"))
    return suggestions.live(stored, docs).select("member_key")


@registered(
    "WITH m AS (SELECT vec_id % 1000 AS id, avg(embedding[1]) AS x FROM embeddings GROUP BY 1) SELECT doc_id AS id, md5(left(text, 1500)) AS head, md5(right(text, 1500)) AS tail, round(m.x, 5) AS x FROM documents LEFT JOIN m ON m.id = doc_id WHERE doc_id % 2 = 1 AND doc_id % 30 <= 13"
)
def merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files, every second one a picture, filed up to thirty days ago: those that may be pages of one, with the ends of their texts and mean vectors."""
    docs, i = table(spark, sf, "documents"), F.col("doc_id")
    own = docs.select(i.alias("id"), F.lit("ready").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"), F.when(i % 2 == 1, "image/png").otherwise("text/plain").alias("mime_type"), (F.lit(NOW).cast("timestamp") - F.make_dt_interval((i % 30).cast("int"))).alias("created_at"))
    passages = table(spark, sf, "embeddings").select((F.col("vec_id") % 1000).alias("document_id"), "embedding")
    rows = suggestions.load_candidates(own, docs.select(i.alias("document_id"), "text"), passages, NOW)
    return rows.select("id", F.md5(F.col("text_head").cast("binary")).alias("head"), F.md5(F.col("text_tail").cast("binary")).alias("tail"), F.round(F.get("mean_embedding", F.lit(0)), 5).alias("x"))


@registered("SELECT doc_id, left(text, 50) AS head, right(text, 50) AS tail, substring(text, 101, 200) AS page, CASE WHEN length(text) > 300 THEN 300 END AS next FROM documents WHERE text IS NOT NULL")
def text_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The head, the tail and a page of every text, by code points."""
    docs = table(spark, sf, "documents").filter("text is not null")
    return docs.select("doc_id", answers.text_head(F.col("text"), 50).alias("head"), answers.text_tail(F.col("text"), 50).alias("tail"), answers.text_page(F.col("text"), 100, 200).alias("p")).select("doc_id", "head", "tail", "p.text", "p.next").withColumnRenamed("text", "page")


_NAME = "CASE p_size % 6 WHEN 0 THEN p_brand || ': ' || p_type || '?.txt. ' WHEN 1 THEN '...' WHEN 2 THEN '/' || p_type || '//' || p_brand || ' / .x' WHEN 3 THEN p_brand || chr(9) || 'a<b>|c*' WHEN 4 THEN p_name || '.PDF' ELSE 'page ' || p_size || ' of ' || p_partkey END"


@registered(
    f"""WITH n AS (SELECT p_partkey AS id, {_NAME} AS x FROM part) SELECT id, CASE WHEN regexp_replace(regexp_replace(x, '[\\x00-\\x1F\\x7F<>:"/\\\\|?*]', '_', 'g'), '[. ]+$', '') = '' THEN '_' ELSE regexp_replace(regexp_replace(x, '[\\x00-\\x1F\\x7F<>:"/\\\\|?*]', '_', 'g'), '[. ]+$', '') END AS safe,
array_to_string(list_filter(list_transform(string_split(x, '/'), lambda p: trim(p)), lambda p: p <> ''), '/') AS path, regexp_matches(x, '^[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}} _.\\-]*$') AND length(x) <= 64 AS fits,
array_to_string(list_transform(regexp_extract_all(lower(x), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '') AS sorted_by FROM n"""
)
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts, some hard on file systems: as safe names, as paths, whether they may name a folder, and what they are sorted by."""
    x = F.col("x")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_NAME.replace("chr(9)", "char(9)")).alias("x"))
    return rows.select("id", decode.safe_name(x).alias("safe"), decode.normal_path(x).alias("path"), decode.folder_name_ok(x).alias("fits"), relational.natural_key(x).alias("sorted_by"))


_UPLOAD = "replace(p_type, ' ', '/') || '/' || CASE p_size % 6 WHEN 0 THEN '.hidden' WHEN 1 THEN 'Thumbs.db' WHEN 2 THEN p_brand || '.pdf' WHEN 3 THEN '@eaDir/' || p_brand WHEN 4 THEN 'b?d/in?/' || p_brand ELSE '/~$lock' END"


@registered(
    f"""WITH f AS (SELECT {_UPLOAD} AS path, p_size % 6 AS k, replace(p_type, ' ', '/') AS folder, p_brand AS b FROM part)
SELECT 'file' AS kind, path, folder, b || '.pdf' AS name FROM f WHERE k = 2 UNION ALL SELECT DISTINCT 'refused', folder || '/b?d', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM f WHERE k = 4"""
)
def folder_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files of a picked folder, some of them junk, some in folders whose name cannot be one."""
    accepted, refused = hierarchy.upload_plan(table(spark, sf, "part").select(F.expr(_UPLOAD).alias("path")))
    none = F.lit(None).cast("string")
    return accepted.select(F.lit("file").alias("kind"), "path", "folder", "name").unionByName(refused.select(F.lit("refused").alias("kind"), "path", none.alias("folder"), none.alias("name")))


@registered("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') UNION ALL SELECT doc_id, 9, 9 FROM documents WHERE lang = 'fr'")
def labels_upserted(spark: SparkSession, sf: str) -> DataFrame:
    """French documents are labelled anew."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    fresh = table(spark, sf, "documents").filter("lang = 'fr'").select("doc_id", F.lit(9).alias("quality"), F.lit(9).alias("toxic"))
    return relational.upsert(labels, fresh, ["doc_id"])


@registered(
    "WITH f AS (SELECT doc_id AS id, source AS vendor FROM documents WHERE lang IN ('en', 'de')) SELECT l.doc_id AS id, CASE WHEN f.id IS NULL THEN 'own' WHEN l.doc_id % 2 = 0 THEN f.vendor END AS vendor, CASE WHEN f.id IS NULL THEN 'user' WHEN l.doc_id % 2 = 0 AND f.vendor IS NOT NULL THEN 'auto' END AS vendor_source FROM labels l LEFT JOIN f ON f.id = l.doc_id"
)
def metadata_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as documents whose vendor a user has set; those in English or German are read again, and half of them name a vendor."""
    docs = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("own").alias("vendor"), F.lit("user").alias("vendor_source"))
    found = table(spark, sf, "documents").filter("lang in ('en', 'de')").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("vendor"))
    return relational.reset_metadata(docs, found, {"vendor_source": ["vendor"]})


@registered(
    "SELECT l_orderkey AS document_id, l_linenumber AS position, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'queued' WHEN l_linestatus = 'F' THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN NOT (l_linestatus = 'F' AND l_returnflag = 'R') THEN CAST(l_shipdate AS VARCHAR) END AS started_at FROM lineitem"
)
def steps_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as steps after a stop of the service: what was returned was running."""
    status = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), "running").when(F.col("l_linestatus") == "F", "succeeded").otherwise("failed")
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("position"), status.alias("status"), F.col("l_shipdate").cast("string").alias("started_at"))
    return processing.resumed(steps)
