"""Versioned rows: latest state, ranges, snapshots, sequence numbers, compaction.

A version log has the columns seq, row_key, row_value, is_deleted and often table_name; the newest
sequence of a key counts, a tombstone hides it. Rows of equal sequence are repeats of one version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.names import EngineError
from lodestrata.session import cut_lineage

VERSION = ("seq", "row_value", "is_deleted")


def newest(log: DataFrame, keys: tuple[str, ...] = ("row_key",)) -> DataFrame:
    """The newest version of every key, tombstones included.

    ``max`` over a struct combines before the shuffle, so a key with very many versions sends one
    row per task.
    """
    version = F.struct("seq", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), "row_value")
    return log.groupBy(*keys).agg(F.max(version).alias("v")).select(*keys, "v.seq", "v.row_value", "v.is_deleted")


def latest_state(log: DataFrame, keys: tuple[str, ...] = ("row_key",)) -> DataFrame:
    """Live rows: keys, seq, row_value."""
    return newest(log, keys).where(~F.col("is_deleted")).drop("is_deleted")


def latest_state_by_window(log: DataFrame, keys: tuple[str, ...] = ("row_key",)) -> DataFrame:
    """The same by row number; keeps all columns of the log."""
    order = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return log.withColumn("rn", F.row_number().over(order)).where("rn = 1").where(~F.coalesce("is_deleted", F.lit(False))).drop("rn")


def tombstones(log: DataFrame, keys: tuple[str, ...] = ("row_key",)) -> DataFrame:
    """Keys whose newest version is a delete, with its sequence."""
    return newest(log, keys).where("is_deleted").select(*keys, "seq")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The log as it stood at a sequence."""
    return log.where(F.col("seq") <= seq)


def snapshot_sequence(log: DataFrame) -> DataFrame:
    """One row: snapshot_seq (highest sequence) and live_rows."""
    last = newest(log)
    return last.agg(F.max("seq").alias("snapshot_seq"), F.count_if(~F.col("is_deleted")).alias("live_rows"))


def key_range(state: DataFrame, start: str | None = None, end: str | None = None, limit: int | None = None, key: str = "row_key") -> DataFrame:
    """Rows in an inclusive key range, either side open; with a limit the first keys in order."""
    if start is not None and end is not None and start > end:
        raise EngineError("start must not be after end")
    if start is not None:
        state = state.where(F.col(key) >= start)
    if end is not None:
        state = state.where(F.col(key) <= end)
    return state if limit is None else state.orderBy(key).limit(limit)


def compact(*runs: DataFrame, keys: tuple[str, ...] = ("row_key",), full: bool = False) -> DataFrame:
    """Runs merged to the newest version of each key; only a full compaction may drop tombstones."""
    from functools import reduce

    merged = newest(reduce(DataFrame.unionByName, runs), keys)
    return merged.where(~F.col("is_deleted")) if full else merged


def assign_sequences(rows: DataFrame, base: int, order: list[str | Column] | None = None) -> DataFrame:
    """``rows`` with seq = base + 1, base + 2, ... in the given order (else as they come), without gaps.

    Range partitions are sorted and counted; only one count per partition meets in one place.
    """
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(rows.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = ranged.withColumn("part", part).join(F.broadcast(offsets), "part")
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("seq", F.lit(base + 1) + F.col("offset") + inside).drop("at", "part", "offset")


def apply_replicated(log: DataFrame, incoming: DataFrame, applied: int) -> DataFrame:
    """The log with incoming versions after ``applied``; repeats of a sequence count once."""
    fresh = incoming.where(F.col("seq") > applied).dropDuplicates(["seq"])
    return log.unionByName(fresh)


def changes_after(log: DataFrame, seq: int, limit: int | None = None, table: str | None = None) -> DataFrame:
    """The change feed strictly after a sequence, in order; optionally one table."""
    found = log.where(F.col("seq") > seq)
    if table is not None:
        found = found.where(F.lower("table_name") == table)
    return found if limit is None else found.orderBy("seq").limit(limit)
