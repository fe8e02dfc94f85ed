"""What changed between consecutive full snapshots, by a sorted merge per key range.

Rows are range-partitioned and sorted by (table, key, snapshot); a pass over each range holds the
row before and compares it with the row at hand, like a two-pointer merge of all snapshots at
once. Texts that are equal need no parsing; only pairs whose texts differ are compared by fields.

Repeated rows of a key in one snapshot count once (the smallest value text). A null value is a
value of its own. Rows without table, key or snapshot number are compared like any others, nulls
being equal; rows without a snapshot number are left out.

:class:`SnapshotStore` keeps snapshots in that layout: ranges of the keys' hash, sorted, with borders that
never move, so a snapshot is shuffled once in its life and any two are merged range by range without
a shuffle, by a streaming two-pointer pass over the files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.json_values import differing_paths, json_loader, unequal_paths
from lodestrata.session import ship
from lodestrata.sources.files import Files
from lodestrata.sources.log_source import listed, opened

KEY = ["table_name", "row_key"]


def snapshot_order(rows: DataFrame) -> DataFrame:
    """table_name, snapshot_seq with the sequence before and after it in its table."""
    order = Window.partitionBy("table_name").orderBy("snapshot_seq")
    return rows.select("table_name", "snapshot_seq").distinct().select(
        "table_name", "snapshot_seq", F.lag("snapshot_seq").over(order).alias("before"), F.lead("snapshot_seq").over(order).alias("after")
    )


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """table_name, snapshot_seq (the later one), row_key, change_kind, changed_paths.

    changed_paths lists the unequal fields of a changed row, '' if the values are not both objects.
    """
    rows = rows.where(F.col("snapshot_seq").isNotNull())
    # Equal rows of a snapshot, however many, are one before the shuffle; unequal rows of a key meet in the ranged pass.
    single = rows.select(*KEY, "snapshot_seq", "row_value").distinct().alias("s")
    order = snapshot_order(rows).alias("o")
    placed = single.join(
        order, F.col("s.table_name").eqNullSafe(F.col("o.table_name")) & (F.col("s.snapshot_seq") == F.col("o.snapshot_seq"))
    ).select("s.*", "before", "after")
    ranged = placed.repartitionByRange(*KEY).sortWithinPartitions(*KEY, "snapshot_seq", "row_value")
    smallest = F.row_number().over(Window.partitionBy(*KEY, "snapshot_seq").orderBy("row_value"))
    ranged = ranged.withColumn("nth", smallest).where("nth = 1").drop("nth")
    merge = Window.partitionBy(*KEY).orderBy("snapshot_seq")
    event = "struct<snapshot_seq:bigint,change_kind:string,old:string,new:string>"
    here = ranged.select(
        *KEY, "snapshot_seq", "before", "after", "row_value",
        F.lag("snapshot_seq").over(merge).alias("prev_seq"), F.lag("row_value").over(merge).alias("prev_value"),
        F.lead("snapshot_seq").over(merge).alias("next_seq"),
    )
    kept = F.col("prev_seq").eqNullSafe(F.col("before"))
    none = F.lit(None).cast("string")

    def emit(seq: str, kind: str, old, new):
        return F.struct(F.col(seq).alias("snapshot_seq"), F.lit(kind).alias("change_kind"), old.alias("old"), new.alias("new")).cast(event)

    events = F.array_compact(F.array(
        F.when(~kept & F.col("before").isNotNull(), emit("snapshot_seq", "added", none, none)),
        F.when(F.col("after").isNotNull() & ~F.col("next_seq").eqNullSafe(F.col("after")), emit("after", "removed", none, none)),
        F.when(kept & F.col("before").isNotNull() & ~F.col("prev_value").eqNullSafe(F.col("row_value")),
               emit("snapshot_seq", "changed", F.col("prev_value"), F.col("row_value"))),
    ))
    found = here.select(*KEY, F.explode(events).alias("e")).select(*KEY, "e.*")
    compared = found.withColumn("changed_paths", differing_paths("old", "new"))
    return compared.where((F.col("change_kind") != "changed") | (F.size("changed_paths") > 0)).select(
        "table_name", "snapshot_seq", "row_key", "change_kind", "changed_paths"
    )


def _sorted_rows(root: str, folder: str | None, table: str | None) -> Iterator[tuple]:
    """((hash, key), value) of a table in a range of a snapshot, in order; nothing for no folder."""
    import pyarrow.dataset as ds

    if folder is None:
        return
    system, _ = opened(root)
    mine = ds.field("table_name") == table if table is not None else ds.field("table_name").is_null()
    for path in listed(system, folder):
        if path.endswith(".parquet"):
            batches = ds.dataset(path, format="parquet", filesystem=system).to_batches(filter=mine, columns=["key_hash", "row_key", "row_value"])
            for batch in batches:
                for h, key, value in zip(*(c.to_pylist() for c in batch.columns)):
                    yield (h, key is not None, key or ""), value


def two_pointers(old: Iterator[tuple], new: Iterator[tuple]) -> Iterator[tuple]:
    """(place, kind, old value, new value) of what differs between two sorted runs of (place, value)."""
    a, b = next(old, None), next(new, None)
    while a or b:
        if b is None or (a and a[0] < b[0]):
            yield a[0], "removed", a[1], None
            a = next(old, None)
        elif a is None or b[0] < a[0]:
            yield b[0], "added", None, b[1]
            b = next(new, None)
        else:
            if a[1] != b[1]:
                yield a[0], "changed", a[1], b[1]
            a, b = next(old, None), next(new, None)


class SnapshotStore:
    """Snapshots kept on files: ``snapshot_seq=N/r=R/``, one sorted file per range, named by numbered records."""

    def __init__(self, spark: SparkSession, path: str, ranges: int = 64):
        self.spark, self.files = spark, Files(spark, path)
        if not self.files.exists("ranges.json"):
            self.files.create("ranges.json", str(ranges))
        self.ranges = int(self.files.read("ranges.json"))

    def add(self, rows: DataFrame) -> None:
        """Adds whole snapshots (table_name, snapshot_seq, row_key, row_value), any number at once, as one commit."""
        once = rows.where(F.col("snapshot_seq").isNotNull()).groupBy(*KEY, "snapshot_seq").agg(F.min("row_value").alias("row_value"))
        placed = once.withColumn("key_hash", F.xxhash64("row_key")).withColumn("r", F.pmod(F.shiftright("key_hash", 40), F.lit(self.ranges)).cast("int"))
        part, number = f"parts/{uuid.uuid4().hex}", len(self.files.names("records")) + 1
        placed.repartition("snapshot_seq", "r").sortWithinPartitions("snapshot_seq", "r", "table_name", "key_hash", F.asc_nulls_first("row_key")).write.partitionBy("snapshot_seq", "r").parquet(self.files.at(part))
        held = self.spark.read.parquet(self.files.at(part)).select("table_name", F.col("snapshot_seq").cast("bigint").alias("s")).distinct().collect() if self.files.size(part) else []
        try:
            self.files.create(f"records/{number:012d}.json", json.dumps({"part": part, "held": sorted([[r.table_name, r.s] for r in held], key=str)}))
        except FileExistsError:
            self.files.delete(part)
            raise RuntimeError("snapshots were added meanwhile; add these again") from None

    def _places(self) -> dict[str | None, dict[int, str]]:
        """The part of each snapshot of each table; of a snapshot that was added twice the later one counts."""
        places: dict[str | None, dict[int, str]] = {}
        for name in self.files.names("records"):
            record = json.loads(self.files.read(f"records/{name}"))
            for table, seq in record["held"]:
                places.setdefault(table, {})[seq] = record["part"]
        return places

    def changes(self, since: int | None = None) -> DataFrame:
        """What :func:`snapshot_changes` gives, of snapshots after ``since`` (all, if it is None); no row is shuffled."""
        root, tasks = self.files.root, []
        _, path = opened(root)
        for table, parts in self._places().items():
            order = sorted(parts)
            for before, seq in zip(order, order[1:]):
                if since is None or seq > since:
                    at = [f"{path}/{parts[s]}/snapshot_seq={s}/r=" for s in (before, seq)]
                    tasks += [(table, seq, f"{at[0]}{r}", f"{at[1]}{r}") for r in range(self.ranges)]
        work = self.spark.createDataFrame(tasks, "table_name string, snapshot_seq bigint, old string, new string")

        def merge(batches):
            load = json_loader()
            for batch in batches:
                for task in batch.itertuples():
                    table = task.table_name if isinstance(task.table_name, str) else None
                    out = []
                    for (_, known, key), kind, old, new in two_pointers(_sorted_rows(root, task.old, table), _sorted_rows(root, task.new, table)):
                        paths = unequal_paths(old, new, load) if kind == "changed" else []
                        if kind != "changed" or paths:
                            out.append((table, task.snapshot_seq, key if known else None, kind, paths))
                    yield pd.DataFrame(out, columns=["table_name", "snapshot_seq", "row_key", "change_kind", "changed_paths"])

        schema = "table_name string, snapshot_seq bigint, row_key string, change_kind string, changed_paths array<string>"
        spread = work.repartition(max(1, min(len(tasks), 4 * self.spark.sparkContext.defaultParallelism)))
        return spread.mapInPandas(merge, schema)


ship(__name__)
