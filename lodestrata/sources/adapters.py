"""Given tables in the shapes of the engine: documents, version logs, search sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(prefix: str, number: str, width: int) -> Column:
    return F.format_string(f"{prefix}%0{width}d", number)


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a document table keyed ``event:00000042``."""
    events = table(spark, sf_dir, "events")
    return events.select(padded("event:", "event_id", 8).alias("row_key"), F.col("props").alias("row_value"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as versions per user; errors delete."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("row_key"), F.col("props").alias("row_value"),
        (F.col("event_type") == "error").alias("is_deleted"), F.col("event_type").alias("table_name"),
    )


def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as doc_key, field, text for full-text search: the fields text and source."""
    documents = table(spark, sf_dir, "documents")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("text", "source")])
    return documents.select(padded("doc:", "doc_id", 8).alias("doc_key"), F.inline(fields)).where(F.col("text").isNotNull())


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as JSON documents keyed by number."""
    c = table(spark, sf_dir, "customer")
    value = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").cast("string").alias("nation")).alias("home")))
    return c.select(F.col("c_custkey").cast("string").alias("row_key"), value.alias("row_value"))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as JSON documents that name their customer."""
    o = table(spark, sf_dir, "orders")
    value = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("customerId"), F.col("o_orderstatus").alias("status")))
    return o.select(padded("order:", "o_orderkey", 8).alias("row_key"), value.alias("row_value"))
