"""The driver's tables seen as an archive: orders as documents, line items as steps, regions and nations as folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dealt, table


def order_documents(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "uploaded").otherwise("processing").alias("status"),
        F.col("o_totalprice").alias("total"),
        F.to_date("o_orderdate").alias("document_date"),
        F.col("o_orderdate").alias("created_at"),
    )


def folders(spark: SparkSession, sf: str) -> DataFrame:
    """A two-level tree with string ids: r<key> on top, n<key> below; folders whose key is divisible by 3 are shared."""
    r = table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"), (F.col("r_regionkey") % 3 == 0).alias("mcp_enabled"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 5 == 0).alias("mcp_enabled"))
    return r.unionByName(n)


def customer_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as files in their nation's folder, titled after their segment; every second has an archive copy, every third a text."""
    c, key = table(spark, sf, "customer"), F.col("c_custkey")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("folder_id"),
        F.col("c_mktsegment").alias("title"),
        F.concat(F.col("c_mktsegment"), F.lit(".PDF")).alias("original_filename"),
        F.when(key % 2 == 0, key).alias("archive_key"),
        F.when(key % 3 == 0, key).alias("content_key"),
        F.when(key % 6 == 0, "markdown").otherwise("plain").alias("content_format"),
        F.lit("ready").alias("status"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.lit("2020-01-01").cast("timestamp").alias("created_at"),
    )


def event_scans(spark: SparkSession, sf: str, pages: bool = True) -> DataFrame:
    """Events as scans: a user's, some in a folder, numbered, dated, from a vendor, with both ends of a text and a vector.

    By the event's number: three in four show a page of three (if ``pages``), two in three a contract number, one in seven a bare one;
    the first line greets, goes on in lower case, names a company, says nothing or has a date; the last ends a sentence or does not.
    """
    i, user = F.col("event_id"), F.col("user_id")
    number = lambda x: x.cast("string")
    page = F.when(i % 4 != 3, F.concat(F.lit("Page "), number(i % 3 + 1), F.lit(" of 3"))) if pages else F.lit(None)
    first = F.element_at(F.array(*[F.lit(x) for x in ("Dear reader,", "goes on here", "Muster GmbH", "More text", "17.03.2019 noted")]), (i % 5 + 1).cast("int"))
    labelled = F.when(i % 3 != 0, F.concat(F.lit("Contract no. "), number(F.lit(500000) + user % 3 + i % 2)))
    angle = (i % 10) * 0.3
    return dealt(table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), "event_id").select(
        number(i).alias("id"),
        "user_id",
        F.when(i % 6 == 0, "f").alias("folder_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("scan_"), number(i), F.lit(".png")).alias("original_filename"),
        F.lit("image/png").alias("mime_type"),
        F.to_date("ts").alias("document_date"),
        F.col("event_type").alias("vendor"),
        F.concat_ws("\n", page, first, labelled).alias("text_head"),
        F.concat_ws("\n", F.when(i % 2 == 1, "and so on,").otherwise("the end."), F.when(i % 7 == 0, "500000")).alias("text_tail"),
        F.array(F.cos(angle).cast("float"), F.sin(angle).cast("float")).alias("mean_embedding"),
    )
