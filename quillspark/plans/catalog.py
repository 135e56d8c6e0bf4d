"""The registered queries over the driver's tables, each an operator of the archive, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decode, extract
from ..functions import text as tx
from ..operators import backup, hierarchy, linkage, naming, postings, processing, relational, search, suggestions
from ..operators.components import connected_components
from ..operators.filters import SearchFilter, compile_filter, table_query
from ..session import Scratch, dealt, table
from ..streaming import archive, processors
from . import search_sql
from .views import customer_documents, event_scans, folders, order_documents

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import archive_catalog  # noqa: F401  # registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


_MIN = 0.2


@registered("SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 51 OFFSET 100")
def browse_orders(spark: SparkSession, sf: str) -> DataFrame:
    page = order_documents(spark, sf)
    return relational.browse(page, 50, 100).select("id", "total")


_MIME = "CASE WHEN p_type LIKE 'PROMO%' THEN 'image/png' WHEN p_type = 'SMALL PLATED COPPER' THEN 'application/pdf' WHEN p_type LIKE 'ECONOMY%' THEN 'text/csv' ELSE 'application/zip' END"


@registered("SELECT p_partkey AS id FROM part WHERE (p_type LIKE 'PROMO%' OR p_type = 'SMALL PLATED COPPER') AND p_size BETWEEN 10 AND 30")
def filter_kind_range(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "part").withColumn("mime_type", F.expr(_MIME))
    return docs.filter(compile_filter(SearchFilter(kinds=("IMAGE", "PDF"))) & F.col("p_size").between(10, 30)).select(F.col("p_partkey").alias("id"))


@registered("SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-03-31' AND o_totalprice IS NOT NULL")
def filter_date_receipt(spark: SparkSession, sf: str) -> DataFrame:
    docs = order_documents(spark, sf).withColumn("vendor", F.lit(None).cast("string"))
    return docs.filter(compile_filter(SearchFilter(date_from="1995-01-01", date_to="1995-03-31", has_receipt=True))).select("id")


@registered("SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_acctbal DESC, c_custkey LIMIT 40 OFFSET 5")
def generated_list(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    return table_query(c, {"balance": {"gte": 0}, "c_mktsegment": {"inArray": ["BUILDING", "MACHINERY"]}}, {"balance": ("desc", 2), "id": ("asc", 1)}, 40, 5).select("id", "balance")


@registered("SELECT count(*) FILTER (o_orderstatus = 'F') AS n_ready, count(*) FILTER (o_orderstatus = 'O') AS n_uploaded, count(*) FILTER (o_orderstatus = 'P') AS n_processing, count(*) FILTER (o_orderstatus = 'X') AS n_failed FROM orders")
def count_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return relational.counts_by(order_documents(spark, sf), "status", ["ready", "uploaded", "processing", "failed"])


@registered("SELECT o_orderkey AS id, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS last_finished FROM orders WHERE o_orderstatus = 'F'")
def last_finished(spark: SparkSession, sf: str) -> DataFrame:
    ready = order_documents(spark, sf).filter("status = 'ready'")
    return relational.with_last_child(ready, table(spark, sf, "lineitem"), "id", "l_orderkey", "l_shipdate", "last_finished").select("id", "last_finished")


@registered("SELECT o_orderkey AS id FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') < 2")
def missing_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return relational.missing_children(order_documents(spark, sf), steps, "id", "l_orderkey", 2).select("id")


@registered("SELECT sha256(text) AS digest, array_to_string(list(doc_id ORDER BY doc_id), ',') AS ids FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicates_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit(1).alias("owner"), F.sha2("text", 256).alias("digest"), "doc_id")
    return relational.duplicates(docs, "owner", "digest", "doc_id", "doc_id").select("digest", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@registered("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') || ',' || o_orderpriority || ',' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) || ',' || CASE WHEN c_mktsegment IS NULL THEN '' ELSE c_mktsegment END || chr(13) || chr(10) AS line FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'")
def receipts_export(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    o = o.filter((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-02-01").cast("timestamp_ntz")))
    rows = o.join(c, o.o_custkey == c.c_custkey, "left").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("vendor"), F.round(F.col("o_totalprice") * 100).cast("long").alias("total"), F.col("c_mktsegment").alias("title"))
    return relational.csv_lines(rows, [("date", False), ("vendor", False), ("total", True), ("title", False)]).select("id", "line")


@registered("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')")
def semi_join_scope(spark: SparkSession, sf: str) -> DataFrame:
    owners = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    own = order_documents(spark, sf).join(owners, F.col("user_id") == owners.c_custkey, "left_semi")
    chunks = table(spark, sf, "lineitem")
    return chunks.join(own, chunks.l_orderkey == own.id, "left_semi").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@registered("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def anti_join_known(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_anti").select("doc_id")


@registered("SELECT conv_id, array_to_string(list(role ORDER BY turn), '>') AS roles, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id")
def nest_children_ordered(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    nested = relational.nest_children(turns.select("conv_id").distinct(), turns.withColumnRenamed("conv_id", "c"), "conv_id", "c", "turn", ["role"], "steps")
    return nested.select("conv_id", F.array_join(F.transform("steps", lambda s: s["role"]), ">").alias("roles"), F.size("steps").cast("long").alias("turns"))


@registered("SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND ts <= (SELECT min(ts) + INTERVAL 10 DAY FROM events)")
def trash_retention(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    low = e.agg(F.min("ts").alias("t"), F.min("event_type").alias("k")).first()
    import datetime as dt

    due = relational.trash_due(e.withColumn("deleted_at", F.when(F.col("event_type") == low["k"], F.col("ts"))), "deleted_at", str(low["t"] + dt.timedelta(days=10)))
    return due.select("event_id")


_TREE = "WITH RECURSIVE f AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name, r_regionkey % 3 = 0 AS shared FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey % 5 = 0 FROM nation), t AS (SELECT id, name AS path, 1 AS depth, shared AS visible, CASE WHEN shared THEN id END AS nearest_shared, [id] AS ids FROM f WHERE parent_id IS NULL UNION ALL SELECT f.id, t.path || '/' || f.name, t.depth + 1, t.visible OR f.shared, CASE WHEN f.shared THEN f.id ELSE t.nearest_shared END, list_append(t.ids, f.id) FROM f JOIN t ON f.parent_id = t.id) "


@registered(_TREE + "SELECT id, path, depth FROM t")
def folder_paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.folder_tree(folders(spark, sf)).select("id", "path", "depth")


@registered(_TREE + "SELECT id, path FROM t WHERE list_contains(ids, 'r2')")
def folder_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.folder_tree(folders(spark, sf)), "r2").select("id", "path")


@registered(_TREE + "SELECT id, path, nearest_shared FROM t WHERE visible")
def shared_folders(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.folder_tree(folders(spark, sf), shared="mcp_enabled").filter("visible").select("id", "path", "nearest_shared")


@registered("SELECT p_brand AS name, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand")
def folder_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"))


@registered("SELECT id, CASE WHEN n = 1 THEN title ELSE title || ' (' || n || ')' END AS new_title FROM (SELECT o_orderkey AS id, o_orderpriority AS title, row_number() OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_orderdate, o_orderkey) AS n FROM orders)")
def rename_rank(spark: SparkSession, sf: str) -> DataFrame:
    return relational.rename_rank(order_documents(spark, sf), "user_id", "title", "created_at", "id").select("id", "new_title")


@registered(
    "WITH o AS (SELECT o_orderkey AS id, o_custkey AS u, o_orderpriority AS t, o_orderdate AS d, CAST(o_orderdate AS DATE) >= DATE '1997-07-01' AS late FROM orders), k AS (SELECT DISTINCT u, lower(t) AS t FROM o WHERE NOT late), r AS (SELECT id, o.t, row_number() OVER (PARTITION BY o.u, lower(o.t) ORDER BY d, id) + CASE WHEN k.t IS NULL THEN 0 ELSE 1 END AS n FROM o LEFT JOIN k ON o.u = k.u AND lower(o.t) = k.t WHERE late) SELECT id, CASE WHEN n = 1 THEN t ELSE t || ' (' || n || ')' END AS new_name FROM r"
)
def free_names(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of late 1997 filed beside those before: each gets a free name in its customer's folder."""
    docs = order_documents(spark, sf).withColumn("folder_id", F.lit(None).cast("string"))
    late = F.col("document_date") >= F.lit("1997-07-01").cast("date")
    return naming.assign_names(docs.filter(late).select("id", "user_id", "folder_id", "title", "created_at"), docs.filter(~late), order=["created_at", "id"]).select("id", "new_name")


@registered("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)), 4) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)) DESC, vec_id LIMIT 50")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    query = e.orderBy("vec_id").first()["embedding"]
    top = search.ranked(e, search.unit_dot(F.col("embedding"), query), "vec_id", 50)
    return top.select("vec_id", F.round("score", 4).alias("score"))


@registered("SELECT label, i - 1 AS i, round(avg(x), 5) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def vector_mean(spark: SparkSession, sf: str) -> DataFrame:
    mean = search.vector_mean(table(spark, sf, "embeddings"), "label", "embedding")
    return mean.select("label", F.posexplode("mean").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x"))


_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@registered(f"SELECT doc_id, CAST(len(list_filter({_WORDS}, lambda w: w = 'the')) AS BIGINT) AS n FROM documents WHERE list_contains({_WORDS}, 'the') AND list_contains({_WORDS}, 'from') AND NOT list_contains({_WORDS}, 'with')")
def keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    tokens = tx.words(F.col("text"))
    hit = table(spark, sf, "documents").filter(search.matches(tokens, search.parse_query("the from -with")))
    return hit.select("doc_id", F.round(search.cover_rank(tokens, search.parse_query("the")) * 10).cast("long").alias("n"))


def _covers_sql(name: str, a: str, b: str) -> str:
    """Each cover of two words by itself: where the earlier one of both words' last places moves on, a cover has ended."""
    return f"""{name}h AS (SELECT doc_id, p, w, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM t WHERE w IN ('{a}', '{b}')),
{name}l AS (SELECT doc_id, p, k, least(max(p) FILTER (w = '{a}') OVER x, max(p) FILTER (w = '{b}') OVER x) AS low, least(max(k) FILTER (w = '{a}') OVER x, max(k) FILTER (w = '{b}') OVER x) AS kl, count(DISTINCT w) OVER x AS n FROM {name}h WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
{name}f AS (SELECT *, lag(low) OVER (PARTITION BY doc_id ORDER BY p) AS before, lag(n) OVER (PARTITION BY doc_id ORDER BY p) AS nb FROM {name}l),
{name} AS (SELECT doc_id, sum(CAST(0.1 AS DOUBLE) / ((p - low) - (k - kl) + 1) ORDER BY p) AS s FROM {name}f WHERE n = 2 AND (before IS NULL OR nb < 2 OR low > before) GROUP BY doc_id)"""


_POSTINGS_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM d),
{_covers_sql("c1", "the", "from")}, {_covers_sql("c2", "of", "the")},
m AS (SELECT doc_id FROM d WHERE (list_contains(ws, 'the') AND list_contains(ws, 'from') AND NOT list_contains(ws, 'with')) OR contains(' ' || array_to_string(ws, ' ') || ' ', ' of the '))
SELECT CAST(rank AS BIGINT) AS rank, doc_id, round(score, 6) AS score FROM (SELECT m.doc_id, coalesce(c1.s, 0) + coalesce(c2.s, 0) AS score, row_number() OVER (ORDER BY coalesce(c1.s, 0) + coalesce(c2.s, 0) DESC, m.doc_id) AS rank FROM m LEFT JOIN c1 ON c1.doc_id = m.doc_id LEFT JOIN c2 ON c2.doc_id = m.doc_id) WHERE rank <= 50"""


@registered(_POSTINGS_SQL)
def words_search(spark: SparkSession, sf: str) -> DataFrame:
    """Two words without a third, or a phrase, looked up in the index of words: the 50 best documents by cover density."""
    docs = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    index = Scratch(spark).result(postings.index_words(docs), "postings")
    return postings.top_passages(index, 'the from -with or "of the"', 50).select(F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@registered(
    "WITH m AS (SELECT vec_id AS id, row_number() OVER (ORDER BY list_cosine_similarity(embedding, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)) DESC, vec_id) AS r FROM embeddings), w AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents), l AS (SELECT id, r FROM m WHERE r <= 50 UNION ALL SELECT id, r FROM w WHERE r <= 50) SELECT id, round(sum(1.0 / (60 + r)), 6) AS score FROM l GROUP BY id"
)
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    query = e.orderBy("vec_id").first()["embedding"]
    one = search.ranked(e.withColumnRenamed("vec_id", "id"), search.unit_dot(F.col("embedding"), query), "id", 50)
    two = search.ranked(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), F.col("n_chars"), "id", 50)
    return search.fused_votes([one, two], ["id"]).select("id", F.round("v", 6).alias("score"))


@registered("SELECT l_orderkey AS document_id, max_by(l_comment_, struct_pack(a := l_extendedprice, b := -l_linenumber)) AS best, max(l_extendedprice) AS score FROM (SELECT *, l_shipdate || '/' || l_linenumber AS l_comment_ FROM lineitem) GROUP BY l_orderkey")
def docs_by_best_passage(spark: SparkSession, sf: str) -> DataFrame:
    passages = table(spark, sf, "lineitem").withColumn("content", F.concat_ws("/", F.col("l_shipdate").cast("string"), F.col("l_linenumber").cast("string")))
    return search.by_best_passage(passages, "l_orderkey", "l_extendedprice", "l_linenumber", "content").select(F.col("l_orderkey").alias("document_id"), F.col("content").alias("best"), F.col("l_extendedprice").alias("score"))


@registered(search_sql.CHUNKS)
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(tx.passages_udf("text", F.lit("text/plain"), F.lit("plain"))).alias("position", "p"))
    return rows.select("doc_id", "position", "p.heading", "p.content")


@registered(search_sql.hybrid("the", "thand", _MIN))
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Indexes all documents (passages, embedded with their titles, and their words), then searches: meaning, words and titles, fused."""
    query = "the thand"
    title = F.trim(F.substring_index(F.substring_index("text", ".", 1), "\n", 1))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), title.alias("title"), "text", F.lit("text/plain").alias("mime_type"), F.lit("plain").alias("content_format"))
    index = Scratch(spark).result(search.index_documents(docs, None, tx.embedder()), "passages")
    chunks = index.select(F.struct("document_id", "position").alias("id"), "document_id", "content", "embedding")
    words = Scratch(spark).result(postings.index_words(chunks), "postings")
    found = search.hybrid_search(docs.select("id", "title"), chunks, query, tx.hash_embedding(query), min_cosine=_MIN, postings=words)
    return found.select("document_id", F.round("score", 9).alias("score"), "snippet")


FLAGSHIP = hybrid_search


@registered()
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", decode.html_text_udf("html").alias("text"))


_DATED = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN '2' THEN date_format(o_orderdate, 'dd.MM.yyyy') WHEN '3' THEN date_format(o_orderdate, 'd MMMM yyyy')
WHEN '4' THEN date_format(o_orderdate, 'MMMM d, yyyy') ELSE date_format(o_orderdate, 'd/M/yyyy') END"""


@registered("SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def document_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as letters that write their date in five ways, among numbers that are no dates and days that are too far off."""
    text = F.concat(F.lit("Ref 1.2.3.4, born 31.02.1990, due 2190-01-01. Order of "), F.expr(_DATED), F.lit(". Paid 2024-05-05."))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), extract.document_dates(text, "2026-05-20").cast("string").alias("day"))


@registered(
    "SELECT o_orderkey AS id, c_mktsegment || ' Shop' AS vendor, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS total, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'EUR' WHEN '2' THEN 'GBP' WHEN '3' THEN 'CAD' WHEN '5' THEN 'CHF' END AS currency FROM orders JOIN customer ON o_custkey = c_custkey"
)
def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as receipts: heading, shop, subtotal, total with grouped thousands and a currency written in five ways, change."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    printed = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    kind = F.substring("o_orderpriority", 1, 1)
    total = F.when(kind == "1", F.concat(F.lit("Grand total EUR "), printed)).when(kind == "2", F.concat(F.lit("TOTAL DUE: £"), printed)).when(kind == "3", F.concat(F.lit("Total C$"), printed)).when(kind == "5", F.concat(F.lit("Total\n"), printed, F.lit(" CHF"))).otherwise(F.concat(F.lit("Total $"), printed))
    text = F.concat(F.lit("***\nTax invoice\nTel 555 0101\n* "), F.col("c_mktsegment"), F.lit(" Shop *\nSubtotal 99,999,999.00\n"), total, F.lit("\nChange 88,888,888.00"))
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), extract.receipts(text).alias("r"))
    return rows.select("id", "r.vendor", "r.total", "r.currency")


@registered("SELECT a.event_id AS a, b.event_id AS b, epoch_us(b.ts) - epoch_us(a.ts) AS gap_us FROM events a JOIN events b ON a.user_id = b.user_id AND (a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id)) AND epoch_us(b.ts) - epoch_us(a.ts) <= 3600000000")
def pair_window_join(spark: SparkSession, sf: str) -> DataFrame:
    pairs = linkage.band_pairs(table(spark, sf, "events"), ["user_id"], "ts", "event_id", 3600)
    return pairs.select("a", "b", F.round(F.col("gap_s") * 1_000_000).cast("long").alias("gap_us"))


def _pairs_sql(pages: bool) -> str:
    """Every signal of two events as scans, worked out from their numbers: see ``views.event_scans``."""
    page = "CASE WHEN event_id % 4 <> 3 THEN event_id % 3 + 1 END" if pages else "CAST(NULL AS BIGINT)"
    return f"""e AS (SELECT event_id AS i, user_id, CASE WHEN event_id % 6 = 0 THEN 'f' ELSE '' END AS folder, event_type AS v, ts, CAST(ts AS DATE) AS d, {page} AS page, CASE WHEN event_id % 3 <> 0 THEN 500000 + user_id % 3 + event_id % 2 END AS labelled,
CASE WHEN event_id % 7 = 0 THEN 500000 END AS bare, event_id % 2 = 1 AND event_id % 7 <> 0 AS goes_on, event_id % 5 = 1 AS lower, event_id % 5 IN (0, 2, 4) AS opens, event_id % 10 AS angle FROM events),
p AS (SELECT a.i AS a, b.i AS b, -2.5 + CASE WHEN gap <= 120 THEN 1.5 WHEN gap <= 600 THEN 0.25 WHEN gap > 3600 THEN -1.0 ELSE 0.0 END + CASE WHEN b.i = a.i + 1 THEN 2.0 ELSE 0.5 END
+ CASE WHEN b.page IS NULL THEN CASE WHEN a.page = 3 THEN -1.5 ELSE 0.0 END WHEN b.page = 1 THEN -2.0 WHEN a.page IS NULL THEN 0.0 WHEN b.page = a.page + 1 THEN 3.0 ELSE 1.0 END
+ CASE WHEN a.labelled IN (b.labelled, b.bare) OR b.labelled IN (a.labelled, a.bare) THEN 1.5 ELSE 0.0 END + CASE WHEN contains(a.v, b.v) OR contains(b.v, a.v) THEN 0.5 ELSE -2.5 END + CASE WHEN a.d = b.d THEN 0.5 ELSE -1.5 END
+ CASE WHEN a.goes_on AND b.lower THEN 2.0 WHEN b.opens THEN -1.5 ELSE 0.0 END + CASE WHEN abs(a.angle - b.angle) <= 1 THEN 0.5 WHEN abs(a.angle - b.angle) >= 4 THEN -1.0 ELSE 0.0 END AS points
FROM (SELECT a, b, abs(epoch_us(b.ts) - epoch_us(a.ts)) / 1000000.0 AS gap FROM e a JOIN e b ON a.user_id = b.user_id AND a.folder = b.folder AND a.i <> b.i) WHERE gap <= 21600), s AS (SELECT a, b, CAST(points AS DOUBLE) AS points, 1 / (1 + exp(-CAST(points AS DOUBLE))) AS confidence FROM p)"""


@registered(f"WITH {_pairs_sql(True)} SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(round(points * 100) AS BIGINT) AS points, round(confidence, 6) AS confidence FROM s")
def score_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scans of one user with texts, folders and vectors: every pair within six hours, both ways round, with what all signals come to."""
    return linkage.score_pairs(event_scans(spark, sf)).select("a", "b", F.round(F.col("points") * 100).cast("long").alias("points"), F.round("confidence", 6).alias("confidence"))


@registered(
    f"""WITH RECURSIVE {_pairs_sql(False)}, u AS (SELECT a, b FROM s WHERE confidence >= 0.5 UNION SELECT b, a FROM s WHERE confidence >= 0.5), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.seen = u.a),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node), o AS (SELECT node, component, lag(node) OVER (PARTITION BY component ORDER BY node) AS before FROM c),
g AS (SELECT component, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS ids, min(CASE WHEN before IS NOT NULL THEN coalesce(s.confidence, 0) END) AS confidence FROM o LEFT JOIN s ON s.a = o.before AND s.b = o.node GROUP BY component)
SELECT ids, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END AS band FROM g WHERE confidence >= 0.5"""
)
def merge_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The groups that are proposed for the same scans without page numbers, which stand in the order of their names."""
    return linkage.merge_groups(event_scans(spark, sf, pages=False)).select(F.array_join("document_ids", ",").alias("ids"), F.round("confidence", 6).alias("confidence"), "band")


@registered("WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS fires_at, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k")
def session_debounce(spark: SparkSession, sf: str) -> DataFrame:
    return archive.quiet_periods(table(spark, sf, "events"), "user_id", "ts", 3600)


@registered("SELECT event_id, attempts, attempts > 2 AS refused FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS attempts FROM events)")
def sliding_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return archive.rate_limited(table(spark, sf, "events"), "user_id", "ts", ["event_id"], 2, 3600).select("event_id", "attempts", "refused")


@registered(
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, [ms] AS held, true AS passed, CAST(NULL AS BIGINT) AS retry FROM e WHERE k = 1
UNION ALL SELECT user_id, event_id, k, CASE WHEN len(f) < 2 THEN list_append(f, ms) ELSE f END, len(f) < 2, CASE WHEN len(f) >= 2 THEN (f[1] + 3600000 - ms + 999) // 1000 END FROM (SELECT e.user_id, e.event_id, e.k, e.ms, list_filter(r.held, lambda t: t > e.ms - 3600000) AS f FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
SELECT event_id AS id, passed, CAST(retry AS BIGINT) AS retry_after_s FROM r"""
)
def rate_limit_retries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as attempts of their user, two of which may pass within an hour: which do, and how long the others have to wait."""
    tries = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return processors.limited(tries, most=2, window_s=3600).select("id", "passed", "retry_after_s")


_KIND = "CASE CAST(l_partkey AS BIGINT) % 6 WHEN 0 THEN 'started' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' WHEN 3 THEN 'queued' ELSE 'succeeded' END"
_NAMES = ", ".join(f"('{n}', {i})" for i, n in enumerate(processing.STEPS))


@registered(
    f"""WITH n(step, position) AS (VALUES {_NAMES}), l AS (SELECT l_orderkey AS id, l_linenumber AS seq, l_shipdate AS ms, CAST(l_suppkey AS BIGINT) % 9 AS s, {_KIND} AS kind FROM lineitem),
e AS (SELECT id, seq, ms, step, position, CASE WHEN position IN (0, 1, 6) OR (position = 2 AND id % 2 = 0) THEN 'queued' ELSE 'skipped' END AS status FROM l, n WHERE seq = 1 UNION ALL SELECT id, seq, ms, step, position, CASE kind WHEN 'started' THEN 'running' ELSE kind END FROM l JOIN n ON position = s WHERE seq > 1),
g AS (SELECT id, step, position, arg_max(status, (ms, seq)) AS status, arg_max(seq, (ms, seq)) AS last, count(*) FILTER (status = 'running') AS attempts FROM e GROUP BY id, step, position)
SELECT id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status IN ('succeeded', 'skipped')) THEN 'ready' WHEN bool_or(status = 'running') THEN 'processing' ELSE 'uploaded' END AS status, arg_min(step, position) FILTER (status NOT IN ('succeeded', 'skipped')) AS next_step,
CAST(count(*) FILTER (status IN ('succeeded', 'skipped')) AS BIGINT) AS done, CAST(sum(attempts) AS BIGINT) AS attempts, 'e' || arg_min(last, position) FILTER (status = 'failed') AS error FROM g GROUP BY id"""
)
def step_events(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as events of their order's steps, the first of each a plan: where each order stands. Of events with one time and number the first stored counts (the SQL leaves it open). Lines without a number from 1 on, and later ones whose supplier gives no step, are no events."""
    i, line = F.col("l_orderkey"), F.col("l_linenumber")
    names = lambda *some: F.array(*[F.lit(processing.STEPS[k]) for k in some])
    nth = F.col("l_suppkey").cast("long") % 9
    step = F.get(names(*range(len(processing.STEPS))), nth.cast("int"))
    kind = F.when(line == 1, "planned").otherwise(F.expr(_KIND))
    stored = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    lines = table(spark, sf, "lineitem").filter((line == 1) | ((line > 1) & (nth >= 0)))
    events = lines.select(stored.alias("place"), i.alias("document_id"), line.cast("long").alias("seq"), F.col("l_shipdate").alias("at"), step.alias("step"), kind.alias("kind"), F.concat(F.lit("e"), line.cast("string")).alias("error"), F.when(i % 2 == 0, names(0, 1, 2, 6)).otherwise(names(0, 1, 6)).alias("steps"))
    return processing.fold_step_events(events, place="place").select(F.col("document_id").alias("id"), "status", "next_step", F.col("done").cast("long").alias("done"), "attempts", "error")


@registered(
    """WITH d AS (SELECT o_orderkey AS id, o_orderdate AS updated, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS last, o_orderstatus AS s FROM orders), q AS (SELECT max(last) AS now FROM d)
SELECT state, id, CAST(n AS BIGINT) AS place FROM (SELECT 'running' AS state, id, row_number() OVER (ORDER BY updated, id) AS n FROM d WHERE s = 'P' UNION ALL SELECT 'queued', id, row_number() OVER (ORDER BY updated, id) FROM d WHERE s = 'O'
UNION ALL SELECT 'finished', id, row_number() OVER (ORDER BY last DESC, id) FROM d, q WHERE s = 'F' AND last >= TIMESTAMP '1996-01-01' - INTERVAL 24 HOUR) WHERE n <= 200"""
)
def queue_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents in the queue, line items as their steps: the lists of what runs, waits and has finished, with places."""
    docs = order_documents(spark, sf).withColumn("updated_at", F.col("created_at")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_shipdate").cast("timestamp").alias("finished_at"))
    out = None
    for state in ("running", "queued", "finished"):
        rows = relational.queue_list(docs.drop("finished_at"), steps, state, "1996-01-01")
        by = F.col("updated_at").asc() if state != "finished" else F.coalesce("finished_at", "updated_at").desc()
        # two hundred rows at most
        placed = rows.select(F.lit(state).alias("state"), "id", F.row_number().over(Window.orderBy(by, "id")).cast("long").alias("place"))
        out = placed if out is None else out.unionByName(placed)
    return out


_ENTRY = "replace(p_type, ' ', '/') || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '/page ' || p_size WHEN 2 THEN '//' ELSE '/' || p_brand || '/x' END"


@registered(
    f"""WITH e AS (SELECT list_filter(string_split({_ENTRY}, '/'), lambda x: x <> '') AS p, CASE WHEN p_size % 4 = 2 THEN 'dir' ELSE 'file' END AS type FROM part),
a AS (SELECT p, type, false AS made FROM e UNION ALL SELECT p[1:n], 'dir', true FROM (SELECT p, unnest(range(1, len(p))) AS n FROM e)), n AS (SELECT p, type, bool_and(made) AS made FROM a GROUP BY p, type)
SELECT array_to_string(p, '/') AS path, type, p[-1] AS name, array_to_string(p[1:len(p) - 1], '/') AS parent, CAST(len(p) AS INTEGER) AS depth, made FROM n"""
)
def entry_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files and folders below the words of their type: one tree, with the folders that only their contents name."""
    kind = F.when(F.col("p_size") % 4 == 2, "dir").otherwise("file")
    return hierarchy.entry_tree(table(spark, sf, "part").select(F.expr(_ENTRY).alias("path"), kind.alias("type"))).drop("place")


@registered(
    """WITH s AS (SELECT doc_id AS id, quality, toxic FROM labels), l AS (SELECT id, 'x' AS f, 'y' AS t, 0.25 + 0.5 * quality AS h FROM s UNION ALL SELECT id, 'y', 'z', 0.6 FROM s),
v AS (SELECT id, arg_min(continues, ms) AS continues, arg_min(c, ms) AS c FROM (SELECT doc_id AS id, doc_id % 3 <> 0 AS continues, 0.5 AS c, 2 AS ms FROM labels UNION ALL SELECT doc_id, doc_id % 3 = 0, 0.25, 1 FROM labels WHERE doc_id % 4 = 0) GROUP BY id),
c AS (SELECT s.id, s.toxic = 0 AND s.id % 5 <> 0 AS written, l.h, CASE WHEN s.toxic = 0 AND s.id % 5 <> 0 AND l.f = 'x' THEN 1 / (1 + exp(-(ln(l.h / (1 - l.h)) + 3.0 * v.c * CASE WHEN v.continues THEN 1 ELSE -1 END))) ELSE l.h END AS m FROM s JOIN l ON l.id = s.id JOIN v ON v.id = s.id)
SELECT id, CASE WHEN bool_and(written) THEN 1 ELSE 0 END AS verdicts, round(CASE WHEN bool_and(written) THEN min(m) ELSE 0.5 END, 9) AS confidence FROM c GROUP BY id"""
)
def verdicts_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as suggestions of three documents, and answers about their first step, some twice, some about another set: what is written."""
    i = F.col("doc_id")
    link = lambda a, b, h: F.struct(F.lit(a).alias("fromId"), F.lit(b).alias("toId"), h.cast("double").alias("heuristic"))
    empty = "array<struct<fromId:string,toId:string,continues:boolean,confidence:double,reason:string>>"
    labels = table(spark, sf, "labels")
    stored = labels.select(
        i.alias("id"), F.lit(1).alias("user_id"), F.lit("x,y,z").alias("member_key"), F.when(F.col("toxic") == 0, "open").otherwise("dismissed").alias("status"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("document_ids"), F.array(link("x", "y", F.lit(0.25) + 0.5 * F.col("quality")), link("y", "z", F.lit(0.6))).alias("links"),
        F.array().cast(empty).alias("ai_verdicts"), F.array().cast("array<struct<signal:string,text:string,points:double>>").alias("reasons"), F.lit(0.5).alias("heuristic_confidence"), F.lit(0.5).alias("confidence"),
    )
    answer = lambda rows, continues, sure, at: rows.select(i.alias("id"), F.lit(1).alias("user_id"), F.when(i % 5 == 0, "x,y").otherwise("x,y,z").alias("member_key"), F.lit("x").alias("from_id"), F.lit("y").alias("to_id"), continues.alias("continues"), F.lit(sure).alias("confidence"), F.lit("").alias("reason"), F.lit(at).alias("answered_at"))
    answers = answer(labels, i % 3 != 0, 0.5, 2).unionByName(answer(labels.filter(i % 4 == 0), i % 3 == 0, 0.25, 1))
    after, _ = suggestions.verdicts_merged(stored, answers)
    return after.select("id", F.size("ai_verdicts").alias("verdicts"), F.round("confidence", 9).alias("confidence"))


@registered("SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last_kind, min(ts) AS first_at, max(ts) AS last_at, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id")
def pipeline_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    return archive.fold_events(table(spark, sf, "events"), "user_id", "ts", "event_type", "event_id")


@registered(
    "WITH e AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT event_id, user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM e), m AS (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, k) AS component, count(*) OVER (PARTITION BY user_id, k) AS n FROM s) SELECT event_id AS node, component FROM m WHERE n > 1"
)
def linkage_components(spark: SparkSession, sf: str) -> DataFrame:
    """Each event linked with the one before it, if that is less than an hour ago: chains, whose components are sessions."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.lag("event_id").over(w).alias("before"), F.unix_micros(F.lag("ts").over(w).cast("timestamp")).alias("t0"))
    return connected_components(e.filter(F.col("t") - F.col("t0") < 3_600_000_000).select(F.col("event_id").alias("src"), F.col("before").alias("dst")))


@registered("SELECT coalesce(a.k, b.k) AS member_key, CASE WHEN a.k IS NULL THEN 'insert' WHEN a.status <> 'open' THEN 'keep' WHEN b.k IS NOT NULL THEN 'update' ELSE 'delete' END AS action FROM (SELECT doc_id AS k, CASE WHEN toxic = 1 THEN 'dismissed' ELSE 'open' END AS status FROM labels) a FULL JOIN (SELECT doc_id AS k FROM documents WHERE lang = 'en') b ON a.k = b.k")
def reconcile_plan(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "labels").select(F.col("doc_id").alias("member_key"), F.when(F.col("toxic") == 1, "dismissed").otherwise("open").alias("status"))
    return linkage.reconcile(stored, table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("member_key")))


@registered(
    "WITH a AS (SELECT doc_id AS k, quality / 2.0 AS c, CASE WHEN toxic = 1 THEN 'dismissed' ELSE 'open' END AS status FROM labels), b AS (SELECT doc_id AS k, 0.75 AS c FROM documents WHERE lang = 'en') SELECT coalesce(a.k, b.k) AS member_key, CASE WHEN a.k IS NOT NULL AND (a.status <> 'open' OR b.k IS NULL) THEN a.c ELSE b.c END AS confidence, coalesce(a.status, 'open') AS status FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR a.status <> 'open' OR b.k IS NOT NULL"
)
def suggestions_written(spark: SparkSession, sf: str) -> DataFrame:
    """The stored suggestions after a new scoring of all English documents."""
    ids, level = F.array("doc_id").alias("document_ids"), F.lit("medium").alias("band")
    stored = table(spark, sf, "labels").select(F.col("doc_id").alias("member_key"), ids, (F.col("quality") / 2.0).cast("double").alias("confidence"), level, F.when(F.col("toxic") == 1, "dismissed").otherwise("open").alias("status"))
    groups = table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("member_key"), ids, F.lit(0.75).alias("confidence"), level)
    return suggestions.written(stored, groups).select("member_key", "confidence", "status")


@registered("SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def counts_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@registered(
    "SELECT p_partkey AS id, '\"' || replace(CASE WHEN p_brand LIKE '%1' THEN chr(39) || '=' ELSE '' END || p_type || ', \"' || p_brand || '\"', '\"', '\"\"') || '\"' AS cell FROM part UNION ALL SELECT -c_custkey, CASE WHEN regexp_matches(c_name, '^[=+@-]') THEN chr(39) || c_name ELSE c_name END FROM customer UNION ALL SELECT 1000000000 + o_orderkey, CAST(-o_orderkey AS VARCHAR) FROM orders"
)
def csv_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with commas and quotes, some that a spreadsheet would run; plain names; negative numbers."""
    p, c, o = table(spark, sf, "part"), table(spark, sf, "customer"), table(spark, sf, "orders")
    text = F.concat(F.when(F.col("p_brand").endswith("1"), "=").otherwise(""), F.col("p_type"), F.lit(', "'), F.col("p_brand"), F.lit('"'))
    quoted = p.select(F.col("p_partkey").cast("long").alias("id"), relational.csv_cell(text).alias("cell"))
    plain = c.select((-F.col("c_custkey")).cast("long").alias("id"), relational.csv_cell(F.col("c_name")).alias("cell"))
    numbers = o.select((F.lit(1_000_000_000) + F.col("o_orderkey")).cast("long").alias("id"), relational.csv_cell(-F.col("o_orderkey"), True).alias("cell"))
    return quoted.unionByName(plain).unionByName(numbers)


@registered("SELECT conv_id AS id, coalesce(array_to_string(list(text ORDER BY turn, text) FILTER (text <> ''), chr(10) || chr(10)), '') AS text, CASE WHEN bool_and(role = 'user') THEN 'markdown' ELSE 'plain' END AS format FROM conversations GROUP BY conv_id")
def merge_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents that are merged from their turns."""
    pages = table(spark, sf, "conversations").withColumn("content_format", F.when(F.col("role") == "user", "markdown").otherwise("plain"))
    return processing.merge_documents(pages, "conv_id", "turn", "text").select(F.col("conv_id").alias("id"), "text", F.col("content_format").alias("format"))


_STEP = "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'succeeded' WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'skipped' WHEN l_linestatus = 'F' THEN 'running' WHEN l_quantity > 49 THEN 'failed' ELSE 'queued' END"


@registered(
    f"WITH s AS (SELECT l_orderkey AS id, l_linenumber AS position, 'step' || l_linenumber AS step, {_STEP} AS status, l_quantity AS attempts FROM lineitem) SELECT id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status IN ('succeeded', 'skipped')) THEN 'ready' WHEN bool_or(status = 'running') THEN 'processing' ELSE 'uploaded' END AS status, arg_min(step, (position, step)) FILTER (status NOT IN ('succeeded', 'skipped')) AS next_step, CAST(count(*) FILTER (status IN ('succeeded', 'skipped')) AS BIGINT) AS done FROM s GROUP BY id"
)
def step_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as steps of their order's pipeline: what each document's steps come to."""
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("step"), F.col("l_linenumber").cast("string")).alias("step"), F.expr(_STEP).alias("status"), F.col("l_quantity").alias("attempts"))
    return processing.fold_status(steps).select(F.col("document_id").alias("id"), "status", "next_step", "done")


@registered("SELECT o_orderkey AS id, step, position FROM orders, (VALUES ('A', 0), ('N', 1), ('R', 2)) v(step, position) WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = step)")
def steps_to_catch_up(spark: SparkSession, sf: str) -> DataFrame:
    documents = order_documents(spark, sf).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    steps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("step"))
    return processing.catch_up(documents, steps, ("A", "N", "R"))


@registered("WITH c AS (SELECT 'n' || c_nationkey AS f, count(*) AS n FROM customer GROUP BY 1) SELECT 'n' || n_nationkey AS id, coalesce(n, 0) AS documents, CAST(coalesce(n, 0) AS BIGINT) AS below FROM nation LEFT JOIN c ON f = 'n' || n_nationkey UNION ALL SELECT 'r' || n_regionkey, 0, CAST(coalesce(sum(n), 0) AS BIGINT) FROM nation LEFT JOIN c ON f = 'n' || n_nationkey GROUP BY n_regionkey")
def subtree_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as documents in their nation's folder."""
    return hierarchy.subtree_counts(customer_documents(spark, sf), hierarchy.folder_tree(folders(spark, sf))).select("id", "documents", "below")


@registered("SELECT c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 OR n_nationkey = 5")
def filter_in_folders(spark: SparkSession, sf: str) -> DataFrame:
    tree = hierarchy.folder_tree(folders(spark, sf))
    return hierarchy.in_folders(customer_documents(spark, sf), tree, ["r2", "n5"]).select("id")


@registered("SELECT 'n' || n_nationkey AS id, 'r' || r_regionkey AS \"to\", r_regionkey <> n_regionkey AS valid FROM nation, region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, false FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, false FROM region UNION ALL SELECT 'r' || r_regionkey, NULL, false FROM region UNION ALL SELECT 'n' || n_nationkey, NULL, true FROM nation UNION ALL SELECT 'n' || n_nationkey, 'gone', false FROM nation")
def folder_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation to every region (its own is no move), to the top and to a folder that is not there; each region below its nations, to itself and to the top, where it is."""
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    rid, nid = F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    above = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    regions = n.join(r.groupBy().agg(F.collect_list("r_regionkey").alias("keys")), F.lit(True)).select(nid.alias("id"), F.explode("keys").alias("k"))
    moves = regions.select("id", F.concat(F.lit("r"), F.col("k").cast("string")).alias("to"))
    for df, a, b in ((n, above, nid), (r, rid, rid), (r, rid, F.lit(None).cast("string")), (n, nid, F.lit(None).cast("string")), (n, nid, F.lit("gone"))):
        moves = moves.unionByName(df.select(a.alias("id"), b.alias("to")))
    return hierarchy.valid_moves(moves, hierarchy.folder_tree(folders(spark, sf)))


@registered(
    """WITH c AS (SELECT c_custkey AS id, r_name || '/' || n_name || '/' || c_mktsegment AS base, c_custkey % 2 = 0 AS archived, c_custkey % 3 = 0 AS read, CASE WHEN c_custkey % 6 = 0 THEN '.md' ELSE '.txt' END AS e FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT id, 'original' AS kind, 'originals/' AS tree, base, '.pdf' AS e FROM c UNION ALL SELECT id, 'archive', 'archive/', base, '.pdf' FROM c WHERE archived UNION ALL SELECT id, 'text', 'text/', base, e FROM c WHERE read)
SELECT id, kind, tree || base || CASE WHEN row_number() OVER (PARTITION BY kind, base, e ORDER BY id) > 1 THEN ' (' || left(CAST(id AS VARCHAR), 8) || ')' ELSE '' END || e AS path FROM p"""
)
def export_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as files that are titled after their segment: their paths in the three trees of a backup."""
    plan = backup.export_plan(customer_documents(spark, sf), hierarchy.folder_tree(folders(spark, sf)))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_path").alias("path")) for k in ("original", "archive", "text")])
    return plan.select("id", F.explode(kinds).alias("p")).select("id", "p.kind", "p.path").filter("path is not null")


@registered(
    """SELECT c_custkey AS id, unnest(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'format is not quillspark-export' WHEN c_custkey % 17 = 0 THEN 'version is not 1' END,
CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 13 = 0 THEN 'title is no text' END, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 17 <> 0 AND c_acctbal < 0 THEN 'sizeBytes is no whole number from 0' END,
CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 11 = 0 THEN 'documentDate is no calendar day' END, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 17 <> 0 AND c_mktsegment = 'BUILDING' THEN 'documentDateSource is none of extracted, user' END,
CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 7 = 0 THEN 'files.text is missing' END], lambda x: x IS NOT NULL)) AS problem FROM customer"""
)
def manifest_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest for each customer, many of them wrong in one place or another: what a reader has against them."""
    c, key = dealt(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "c_custkey"), F.col("c_custkey")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "guess").otherwise("user")
    files = F.when(key % 7 == 0, F.to_json(F.struct(F.lit("a").alias("original"), F.lit(None).cast("string").alias("archive")), {"ignoreNullFields": "false"})).otherwise(F.lit('{"original":"a","archive":null,"text":null}'))
    doc = F.struct(
        key.cast("string").alias("id"), F.when(key % 13 != 0, F.col("c_name")).alias("title"), F.lit(None).cast("string").alias("folder"), F.lit("a.pdf").alias("originalFilename"), F.lit("application/pdf").alias("mimeType"), F.floor("c_acctbal").alias("sizeBytes"),
        F.lit(None).cast("string").alias("checksumSha256"), F.lit("ready").alias("status"), (key % 2 == 0).alias("ocrRequested"), F.lit("2024-01-01T00:00:00.000Z").alias("createdAt"), F.when(key % 11 == 0, "2023-02-29").otherwise("2024-02-29").alias("documentDate"), kind.alias("documentDateSource"),
        *[F.lit(None).cast("string").alias(x) for x in ("vendor", "total", "currency", "receiptSource")],
    )
    line = F.concat(F.regexp_replace(F.to_json(doc, {"ignoreNullFields": "false"}), r"\}$", ""), F.lit(',"files":'), files, F.lit("}"))
    head = F.concat(F.lit('{"format":"'), F.when(key % 5 == 0, "tar").otherwise(backup.FORMAT), F.lit('","version":'), F.when(key % 17 == 0, "2").otherwise("1"), F.lit(',"exportedAt":"now","folders":[{"path":"In","mcpEnabled":true}],"documents":['))
    return backup.read_manifests(c.select(key.alias("archive"), F.concat(head, line, F.lit("]}")).alias("text")))[2].select(F.col("archive").alias("id"), "problem")


@registered(
    "WITH m AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS h, lang = 'en' AS there FROM documents WHERE text IS NOT NULL), k AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text IS NOT NULL) SELECT path, CASE WHEN k.h IS NOT NULL THEN 'skipped' WHEN there IS NOT TRUE THEN 'failed' WHEN row_number() OVER (PARTITION BY m.h ORDER BY path) > 1 THEN 'skipped' ELSE 'imported' END AS action FROM m LEFT JOIN k ON m.h = k.h"
)
def import_actions(spark: SparkSession, sf: str) -> DataFrame:
    """A backup of all documents of which only the English files are there, into an archive that holds those of good quality."""
    docs = table(spark, sf, "documents").filter("text is not null")
    manifest = docs.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("checksum_sha256"))
    files = docs.filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    held = docs.join(table(spark, sf, "labels").filter("quality = 1"), "doc_id", "left_semi").select(F.sha2("text", 256).alias("checksum_sha256"))
    return backup.import_plan(manifest, files, held)


@registered("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def insert_ignored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled ids, and those of all documents that are not among them."""
    return relational.insert_ignore(table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").select("doc_id"), ["doc_id"])