"""Equality indexes: covering entries of comparable values, and lookups over a base and later changes.

An entry is ``indexed_value, row_key, row_value, seq``. A *layer* is a DataFrame of entries; the
first layer is the base, later ones hold the newest version of every key that changed since, with
a NULL value where the key was deleted or has no such path. A base entry counts only if no later
layer has its key, so the base is read by value alone and never joined with the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.json_values import comparable, exact_comparable

ENTRY = ["indexed_value", "row_key", "row_value", "seq"]


def index_rows(rows: DataFrame, path: str, exact: bool = True) -> DataFrame:
    """Entries of ``rows`` (row_key, row_value, perhaps seq and is_deleted), NULL values included."""
    value = (exact_comparable if exact else comparable)(F.col("row_value"), path)
    if "is_deleted" in rows.columns:
        value = F.when(~F.coalesce("is_deleted", F.lit(False)), value)
    seq = F.col("seq") if "seq" in rows.columns else F.lit(0).cast("bigint").alias("seq")
    return rows.select(value.alias("indexed_value"), "row_key", "row_value", seq)


def build_index(state: DataFrame, path: str) -> DataFrame:
    """The entries of a state; rows without the path are not indexed."""
    return index_rows(state, path).where(F.col("indexed_value").isNotNull())


def write_index(entries: DataFrame, target: str) -> None:
    """Entries as Parquet, range-partitioned and sorted by value and key, so lookups read few row groups and a frequent value is spread."""
    ordered = entries.repartitionByRange("indexed_value", "row_key").sortWithinPartitions("indexed_value", "row_key")
    ordered.write.mode("overwrite").option("parquet.bloom.filter.enabled#indexed_value", "true").parquet(target)


def current(found: DataFrame, later: list[DataFrame]) -> DataFrame:
    """``found`` (row_key, seq and more) without rows whose key has a newer version in a later layer."""
    if not later:
        return found
    newer = reduce(DataFrame.unionByName, [x.select("row_key", "seq") for x in later]).groupBy("row_key").agg(F.max("seq").alias("seq"))
    f, n = found.alias("f"), newer.alias("n")
    return f.join(n, (F.col("f.row_key") == F.col("n.row_key")) & (F.col("n.seq") > F.col("f.seq")), "left_anti")


def lookup(layers: list[DataFrame], value: str) -> DataFrame:
    """row_key, row_value of all rows that have the value now."""
    hits = reduce(DataFrame.unionByName, [x.where(F.col("indexed_value") == value).select("row_key", "row_value", "seq") for x in layers])
    return current(hits, layers[1:]).select("row_key", "row_value")


def live_entries(layers: list[DataFrame]) -> DataFrame:
    """indexed_value, row_key of all rows that are indexed now."""
    rows = reduce(DataFrame.unionByName, [x.select("indexed_value", "row_key", "seq") for x in layers])
    return current(rows, layers[1:]).where(F.col("indexed_value").isNotNull()).select("indexed_value", "row_key")


def index_entries(index: DataFrame) -> DataFrame:
    """The logical content in order: one row per (indexed_value, row_key)."""
    return index.select("indexed_value", "row_key").distinct().orderBy("indexed_value", "row_key")


def index_summary(index: DataFrame) -> DataFrame:
    """indexed_value, n, first_key, last_key; combined before the shuffle, so a frequent value is no burden."""
    return index.groupBy("indexed_value").agg(F.count("*").alias("n"), F.min("row_key").alias("first_key"), F.max("row_key").alias("last_key"))
