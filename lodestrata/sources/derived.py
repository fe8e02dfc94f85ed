"""Data derived from a table and kept on files: equality indexes and the postings of search indexes.

Either is a list of *runs* named in the catalog. The first run covers the table up to a sequence,
each later one the newest versions of the keys that changed in a range of sequences; what changed
after the last run is derived when it is read, from the end of the log alone. Bulk writes and
flushes append a run. Runs are merged into one when there are more than ``MOST_RUNS`` of them for
the storage kind: BTREE keeps few for fast reads, FASTWRITE many for cheap writes.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import indexes, search, versions
from lodestrata.session import stored

MOST_RUNS = {"btree": 2, "fastwrite": 8, "postings": 4}


class Derived:
    """The runs of one index or search index of a store."""

    #: Which part of the catalog the definitions are in.
    kind: str

    def __init__(self, store, name: str):
        self.store, self.name = store, name
        self.definition = store.catalog[self.kind][name]
        self.table = self.definition["table"]

    def _write(self, rows: DataFrame, path: str, base: bool) -> dict:
        raise NotImplementedError

    def _versions(self, after: int, upto: int) -> DataFrame:
        """The newest version of every key that changed in (after, upto]."""
        return versions.newest(self.store.log(max(after, self.store.info(self.table)["since"]), upto).where(F.col("table_name") == self.table))

    def build(self) -> None:
        """One run over the whole table in place of all runs."""
        attached = self.table in self.store.attached
        self.store.flush()
        upto = 0 if attached else self.store.flushed
        rows = self.store.state(self.table) if attached else versions.latest_state(self.store.versions_of(self.table, upto))
        old = self.definition.get("runs", [])
        self._replace([self._run(rows, 0, upto, True)])
        for run in old[:-1]:  # the last of the old runs stays for readers that have begun
            self.store.files.delete(run["path"])

    def extend(self) -> None:
        """A run for what changed since the last one, or a new whole run if there are too many."""
        runs, upto = self.definition.get("runs", []), self.store.flushed
        if not runs or len(runs) >= MOST_RUNS[self.definition.get("storage", "postings")]:
            self.build()
        elif upto > runs[-1]["upto"]:
            after = runs[-1]["upto"]
            self._replace([*runs, self._run(self._versions(after, upto), after, upto, False)])

    def _run(self, rows: DataFrame, after: int, upto: int, base: bool) -> dict:
        path = f"derived/{self.name}-{uuid.uuid4().hex}"
        return {"path": path, "after": after, "upto": upto} | self._write(rows, self.store.files.at(path), base)

    def _replace(self, runs: list[dict]) -> None:
        self.definition["runs"] = runs
        self.store.save_catalog()

    def runs(self) -> list[dict]:
        if not self.definition.get("runs"):
            self.build()
        return self.definition["runs"]

    def tail(self) -> DataFrame | None:
        """The newest versions of keys that changed after the last run; None if nothing can have."""
        last = self.runs()[-1]["upto"]
        if self.table in self.store.attached or self.store.sequence <= last:
            return None
        return self._versions(last, self.store.sequence)


class StoredIndex(Derived):
    kind = "indexes"

    def _write(self, rows: DataFrame, path: str, base: bool) -> dict:
        # Written once before they are ranged: sampling for the ranges would parse every text again.
        entries = stored(indexes.index_rows(rows, self.definition["path"]), "entries")
        indexes.write_index(entries.where(F.col("indexed_value").isNotNull()) if base else entries, path)
        return {}

    def layers(self) -> list[DataFrame]:
        layers = [self.store.spark.read.parquet(self.store.files.at(r["path"])) for r in self.runs()]
        tail = self.tail()
        return layers if tail is None else [*layers, indexes.index_rows(tail, self.definition["path"])]

    def rows_with(self, value: str) -> DataFrame:
        """row_key, row_value of the rows that have the value now."""
        return indexes.lookup(self.layers(), value)

    def entries(self) -> DataFrame:
        return indexes.live_entries(self.layers())


class StoredPostings(Derived):
    kind = "search"

    def _write(self, rows: DataFrame, path: str, base: bool) -> dict:
        search.write_postings(self._postings(rows, None), f"{path}/postings")
        if not base:
            rows.select(F.col("row_key"), "seq", "is_deleted").write.parquet(f"{path}/docs")
            return {}
        seq = "seq" if "seq" in rows.columns else F.lit(0).cast("bigint").alias("seq")
        rows.select("row_key", seq, F.lit(False).alias("is_deleted")).write.parquet(f"{path}/docs")
        return {"docs": self.store.spark.read.parquet(f"{path}/docs").count()}

    def _postings(self, rows: DataFrame, only: list[str] | None) -> DataFrame:
        if "is_deleted" in rows.columns:
            rows = rows.where(~F.col("is_deleted"))
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.lit(0).cast("bigint"))
        return search.postings(search.field_texts(rows, self.definition["fields"], ["seq"]), only, ["seq"])

    def _read(self, run: dict, part: str) -> DataFrame:
        return self.store.spark.read.parquet(self.store.files.at(f"{run['path']}/{part}"))

    def found(self, terms: list[str]) -> DataFrame:
        """The postings of some terms as they stand now."""
        runs, tail = self.runs(), self.tail()
        parts = [self._read(r, "postings").where(F.col("term").isin(terms)) for r in runs]
        later = [self._read(r, "docs") for r in runs[1:]]
        if tail is not None:
            parts.append(self._postings(tail, terms))
            later.append(tail)
        hits = reduce(DataFrame.unionByName, parts).withColumnRenamed("doc_key", "row_key")
        return indexes.current(hits, later).withColumnRenamed("row_key", "doc_key").drop("seq")

    def total(self) -> int:
        """How many rows the table has."""
        runs, tail = self.runs(), self.tail()
        if len(runs) == 1 and tail is None:
            return runs[0]["docs"]
        docs = [self._read(r, "docs") for r in runs] + ([tail.select("row_key", "seq", "is_deleted")] if tail is not None else [])
        newest = reduce(DataFrame.unionByName, docs).groupBy("row_key").agg(F.max_by("is_deleted", "seq").alias("gone"))
        return newest.where("NOT gone").count()
