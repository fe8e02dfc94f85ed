"""Applying inserts, updates and deletes as sequenced insert rows and equality deletes.

Every entry of the feed appends an equality delete (table, key, sequence); entries that put a
value append an insert row with the same sequence. A reader drops each insert row for which a
later delete of its key exists. Arrival order and repetition do not matter, because only
sequences are compared and a delete never hits the insert of its own sequence.

Both sides are reduced to the newest sequence per key before they are shuffled, so a key with a
large share of all rows arrives as one row per task. Table names ignore case, null is ``kv``; null
keys are a key of their own; entries without a sequence are ignored; an entry deletes when
``is_deleted`` says so or, where that is null, when the operation is delete.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.files import Files

KEY = ["table_name", "row_key"]


def table_of(name: str = "table_name") -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("kv")))


def deletes() -> Column:
    said = F.lower(F.expr("trim(BOTH ' \t\r\n' FROM operation)")) == "delete"
    return F.coalesce(F.col("is_deleted"), said, F.lit(False))


def split_changes(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(insert rows, equality deletes) of a feed; both carry table_name, row_key and seq."""
    clean = feed.where(F.col("seq").isNotNull()).withColumn("table_name", table_of())
    inserts = clean.where(~deletes()).select(*KEY, "seq", "row_value")
    return inserts, clean.select(*KEY, "seq")


def read_live(inserts: DataFrame, removed: DataFrame, values: bool = True) -> DataFrame:
    """Live rows: inserts without a later equality delete of their key.

    Repeated deliveries of one sequence give one row (the largest value text, should they differ).
    """
    grouped = inserts.groupBy(*KEY)
    if values:
        i = grouped.agg(F.max(F.struct("seq", "row_value")).alias("r")).select(*KEY, "r.*").alias("i")
    else:
        i = grouped.agg(F.max("seq").alias("seq")).alias("i")
    d = removed.groupBy(*KEY).agg(F.max("seq").alias("seq")).alias("d")
    later = (
        F.col("i.table_name").eqNullSafe(F.col("d.table_name")) & F.col("i.row_key").eqNullSafe(F.col("d.row_key"))
        & (F.col("d.seq") > F.col("i.seq"))
    )
    return i.join(d, later, "left_anti")


class EqualityDeleteTable:
    """The same on files: each batch is a folder with ``inserts`` and ``deletes`` and one record that commits both.

    A reader sees the batches that have a record, so never an insert whose batch's deletes are missing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def _commit(self, batch_id: str, inserts: DataFrame, removed: DataFrame) -> bool:
        if self.files.exists(f"records/{batch_id}.json"):
            return False
        folder = f"batches/{batch_id}-{uuid.uuid4().hex}"
        inserts.write.parquet(self.files.at(f"{folder}/inserts"))
        removed.write.parquet(self.files.at(f"{folder}/deletes"))
        try:
            self.files.create(f"records/{batch_id}.json", folder)
        except FileExistsError:
            self.files.delete(folder)
            return False
        return True

    def append(self, feed: DataFrame, batch_id: str) -> bool:
        """Idempotent by batch identifier: False if the batch was appended before."""
        return self._commit(batch_id, *split_changes(feed))

    def _parts(self) -> tuple[DataFrame, DataFrame] | None:
        folders = [self.files.read(f"records/{n}") for n in self.files.names("records")]
        return tuple(self.spark.read.parquet(*[self.files.at(f"{f}/{part}") for f in folders]) for part in ("inserts", "deletes")) if folders else None

    def read(self) -> DataFrame | None:
        """The live rows; None before the first batch."""
        parts = self._parts()
        return None if parts is None else read_live(*parts)

    def compact(self, target: str) -> None:
        """A new table of live inserts and the newest delete of each key, which late arrivals still need."""
        inserts, removed = self._parts()
        newest = removed.groupBy(*KEY).agg(F.max("seq").alias("seq"))
        EqualityDeleteTable(self.spark, target)._commit("compacted", read_live(inserts, removed), newest)
