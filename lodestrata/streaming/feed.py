"""The change feed as a stream: replay, resume, deduplication and materialised state."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators import exactly_once, versions
from lodestrata.session import cut_lineage
from lodestrata.sources.files import Files
from lodestrata.sources.version_log import ENTRY

STATE = T.StructType().add("row_key", T.StringType()).add("seq", T.LongType()).add("row_value", T.StringType()).add("is_deleted", T.BooleanType())


def read_feed(spark: SparkSession, path: str, schema: T.StructType = ENTRY, after: int = 0, table: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A streaming DataFrame of log entries strictly after a sequence, optionally of one table.

    New parts are picked up as they are renamed into the log, replay and live entries alike, so
    there is no gap between the two. Resuming is the checkpoint's business.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    found = reader.parquet(path).where(F.col("seq") > after)
    return found if table is None else found.where(F.lower("table_name") == table)


def deduplicated(feed: DataFrame) -> DataFrame:
    """Each sequence once, over the whole life of the query; the state grows with the sequences (see :class:`SeenRanges`)."""
    return feed.dropDuplicates(["seq"])


class SeenRanges:
    """Each sequence once over the whole life of a feed, with disjoint ranges of sequences as state.

    The state of a feed without lasting gaps is a few ranges per chunk of the sequence space. It is
    written per micro-batch, so a batch that is delivered again gives the same rows again and counts once.
    """

    def __init__(self, spark: SparkSession, path: str, handle: Callable[[DataFrame, int], None]):
        self.spark, self.files, self.handle = spark, Files(spark, path), handle

    def _seen(self, number: int) -> DataFrame | None:
        known = [n for n in self.files.names("") if n.startswith("seen-") and int(n.split("-")[1]) < number and self.files.exists(f"{n}/_SUCCESS")]
        return self.spark.read.parquet(self.files.at(known[-1])) if known else None

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Hands the rows with new sequences (one each, the smallest of equals) to ``handle``, then keeps the ranges."""
        seen = self._seen(batch_id)
        others = [c for c in batch.columns if c != "seq"]
        first = batch.where(F.col("seq").isNotNull()).groupBy("seq").agg(F.min(F.struct(*others)).alias("row")).withColumn("producer", F.lit(""))
        new = cut_lineage(exactly_once.uncovered(first, seen))
        self.handle(new.select("seq", "row.*").select(*batch.columns), batch_id)
        exactly_once.merge_ranges(new, seen).write.mode("overwrite").parquet(self.files.at(f"seen-{batch_id:012d}"))
        for name in self.files.names(""):
            if name.startswith("seen-") and int(name.split("-")[1]) < batch_id - 1:
                self.files.delete(name)

    def start(self, feed: DataFrame, checkpoint: str) -> StreamingQuery:
        return feed.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_state(feed: DataFrame) -> DataFrame:
    """Newest version per key as a streaming aggregation (complete or update mode)."""
    version = F.struct("seq", "is_deleted", "row_value")
    return feed.groupBy("row_key").agg(F.max(version).alias("v")).select("row_key", "v.seq", "v.row_value", "v.is_deleted")


class Materializer:
    """Follower state on files: every micro-batch appends the newest versions of its keys.

    A read merges the last base with the batches after it; every ``compact_every`` batches a new
    base is written. Files are named by the batch, so a batch that is delivered again overwrites
    its own output. Tombstones stay in the state, because an older put may still arrive.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 20):
        self.spark, self.files, self.compact_every = spark, Files(spark, path), compact_every

    def _numbers(self, kind: str) -> list[int]:
        names = [n for n in self.files.names("") if n.startswith(f"{kind}-") and self.files.exists(f"{n}/_SUCCESS")]
        return [int(n.split("-")[1]) for n in names]

    def _read(self, kind: str, number: int) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(self.files.at(f"{kind}-{number:012d}"))

    def read(self) -> DataFrame:
        """row_key, seq, row_value, is_deleted of every key ever seen."""
        base = max(self._numbers("base"), default=-1)
        parts = [self._read("batch", n) for n in self._numbers("batch") if n > base]
        if base >= 0:
            parts.append(self._read("base", base))
        elif self._numbers("seed"):
            parts.append(self._read("seed", 0))
        return versions.newest(reduce(DataFrame.unionByName, parts)) if parts else self.spark.createDataFrame([], STATE)

    def seed(self, rows: DataFrame) -> None:
        """The live rows (row_key, seq, row_value) of a snapshot that the batches follow."""
        rows.withColumn("is_deleted", F.lit(False)).select(STATE.names).write.mode("overwrite").parquet(self.files.at(f"seed-{0:012d}"))

    def live(self) -> DataFrame:
        return self.read().where("NOT is_deleted").drop("is_deleted")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        fresh = versions.newest(batch.select("row_key", *versions.VERSION))
        fresh.select(STATE.names).write.mode("overwrite").parquet(self.files.at(f"batch-{batch_id:012d}"))
        if batch_id % self.compact_every == self.compact_every - 1:
            self.read().select(STATE.names).write.mode("overwrite").parquet(self.files.at(f"base-{batch_id:012d}"))
            # The base before and its batches stay for readers that have them open.
            kept = sorted(self._numbers("base"))[-2:]
            for kind, last in (("base", kept[0] - 1), ("batch", kept[0])):
                for number in self._numbers(kind):
                    if len(kept) > 1 and number <= last:
                        self.files.delete(f"{kind}-{number:012d}")

    def start(self, feed: DataFrame, checkpoint: str) -> StreamingQuery:
        return feed.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(feed: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Runs ``handle`` over everything that is there since the checkpoint, then stops."""
    query = feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
