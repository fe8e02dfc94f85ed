"""A transaction's staged writes over committed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_writes(staged: DataFrame, keys: tuple[str, ...] = ("row_key",)) -> DataFrame:
    """The last staged write of each key; ``staged`` has keys, row_value, is_deleted and staged_at (order)."""
    last = F.max(F.struct("staged_at", "is_deleted", "row_value")).alias("w")
    return staged.groupBy(*keys).agg(last).select(*keys, "w.row_value", "w.is_deleted")


def overlay(committed: DataFrame, staged: DataFrame, keys: tuple[str, ...] = ("row_key",)) -> DataFrame:
    """Committed rows as the transaction sees them: staged keys replaced, staged deletes hidden."""
    writes = last_writes(staged, keys)
    kept = committed.select(*keys, "row_value").join(writes, list(keys), "left_anti")
    return kept.unionByName(writes.where(~F.col("is_deleted")).select(*keys, "row_value"))
