"""Processing only new or changed input, with a manifest as the single point of commit.

The listing of input units (files, or blocks of a log) carries a size and a checksum. Units whose
(name, size, checksum) stand in the manifest are done; the anti-join of the listing against the
manifest is what a run has to process. Output is written under the batch identifier (a repeated
run overwrites its own output) and the manifest entry is committed last, so a failure anywhere
before it leaves nothing skipped and nothing counted twice: :func:`committed_output` reads the
output of committed batches only. Commits are numbered records that one run only can create; a
run whose plan was made before another's commit is refused and plans anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import cut_lineage
from lodestrata.sources.files import Files

UNIT = "unit string, size bigint, checksum bigint"
#: Files up to so many bytes are hashed as a whole, larger ones line by line by many tasks.
WHOLE = 1 << 28


class Manifest:
    """Committed units of one consumer: a numbered record per batch, the units as Parquet beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark, path)

    def version(self) -> int:
        """The number of the last commit."""
        return max((int(n.split(".")[0]) for n in self.files.names("committed")), default=0)

    def _records(self, upto: int | None = None) -> list[dict]:
        names = [n for n in self.files.names("committed") if upto is None or int(n.split(".")[0]) <= upto]
        return [json.loads(self.files.read(f"committed/{n}")) for n in names]

    def read(self, upto: int | None = None) -> DataFrame:
        """unit, size, checksum, batch_id of all batches committed (up to a version)."""
        schema = T._parse_datatype_string(UNIT + ", batch_id string")
        paths = [self.files.at(r["units"]) for r in self._records(upto)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def batches(self) -> list[str]:
        """The identifiers of committed batches."""
        return [r["batch_id"] for r in self._records()]

    def is_committed(self, batch_id: str) -> bool:
        return batch_id in self.batches()

    def commit(self, batch_id: str, units: DataFrame, after: int) -> None:
        """Writes the units aside, then creates the record with the next number: that is the commit."""
        if self.is_committed(batch_id):
            raise RuntimeError(f"batch {batch_id} is committed already")
        folder = f"units/{batch_id}-{uuid.uuid4().hex}"
        units.select("unit", "size", "checksum", F.lit(batch_id).alias("batch_id")).write.parquet(self.files.at(folder))
        try:
            self.files.create(f"committed/{after + 1:012d}.json", json.dumps({"batch_id": batch_id, "units": folder}))
        except FileExistsError:
            self.files.delete(folder)
            raise RuntimeError(f"another batch was committed since {batch_id} was planned; run it again") from None


def list_files(spark: SparkSession, path: str, pattern: str = "*", whole: int = WHOLE) -> DataFrame:
    """The listing of a folder: unit (path), size and checksum of every file, read by executors.

    The checksum is over the whole content, so a file rewritten with the same size is found. Files
    above ``whole`` bytes are hashed by lines (with their number and sum), which any number of tasks
    share. Empty files hold nothing to process and are not listed.
    """
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    files = spark.read.format("binaryFile").options(**options).load(path)
    small = files.where(F.col("length") <= whole).select(F.col("path").alias("unit"), F.col("length").alias("size"), F.xxhash64("content").alias("checksum"))
    large = files.select("path", "length").where(F.col("length") > whole)
    if large.isEmpty():
        return small
    paths = [r.path for r in large.select("path").collect()]  # names only, of files above the bound
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("unit"), F.col("_metadata.file_size").alias("size"), "value")
    summed = lines.groupBy("unit", "size").agg(F.xxhash64(F.count("*"), F.sum(F.xxhash64("value").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("value"))).alias("checksum"))
    return small.unionByName(summed)


def pending_units(listing: DataFrame, manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Anti-join of the listing against the manifest on name, size and checksum (and ``by``)."""
    on = [*(by or []), "unit", "size", "checksum"]
    return listing.join(manifest.select(*on).distinct(), on, "left_anti")


def run_batch(
    spark: SparkSession, listing: DataFrame, manifest: Manifest, batch_id: str, output: str,
    process: Callable[[DataFrame], DataFrame],
) -> bool:
    """Process the pending units of one batch; False if this batch was committed before.

    ``process`` gets the pending units and returns the rows to write. The set of units is written
    first and read back, so that output and manifest agree even if files arrive meanwhile.
    """
    if manifest.is_committed(batch_id):
        return False
    after = manifest.version()
    fixed = f"{manifest.path}/planned/{batch_id}"
    pending_units(listing, manifest.read(after)).write.mode("overwrite").parquet(fixed)
    units = spark.read.schema(UNIT).parquet(fixed)
    process(units).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")
    manifest.commit(batch_id, units, after)
    return True


def committed_output(spark: SparkSession, manifest: Manifest, output: str) -> DataFrame | None:
    """The output of committed batches, with ``batch_id``; None before the first commit."""
    paths = [f"{output}/batch_id={b}" for b in manifest.batches()]
    return spark.read.option("basePath", output).parquet(*paths) if paths else None


def _cover(low: str, high: str) -> str:
    """SQL for the dyadic intervals (level, part) that make up [low, high]: at most two a level."""
    a, b = f"-shiftright(-({low}), k)", f"shiftright({high} + 1, k)"
    one = (
        f"filter(array(CASE WHEN {a} < {b} AND {a} & 1 = 1 THEN named_struct('level', k, 'part', {a}) END, "
        f"CASE WHEN {a} < {b} AND {b} & 1 = 1 THEN named_struct('level', k, 'part', {b} - 1) END), x -> x IS NOT NULL)"
    )
    return f"flatten(transform(sequence(0, 62), k -> {one}))"


def units_within(listing: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` (low, high and more) with each ``unit`` of the listing that lies in them.

    An equi-join over dyadic intervals: the work follows the units there are, not the width of the ranges.
    """
    parts = ranges.select("*", F.expr(f"inline({_cover('low', 'high')})"))
    levels = sorted(r.level for r in parts.select("level").distinct().collect())  # 63 at most
    at = F.explode(F.array(*map(F.lit, levels))) if levels else F.lit(None).cast("int")
    units = listing.select("unit", at.alias("level")).withColumn("part", F.expr("shiftright(unit, level)"))
    return units.join(parts, ["level", "part"]).drop("level", "part")


def unprocessed_entries(entries: DataFrame, runs: DataFrame, block: int = 8192) -> DataFrame:
    """Entries of a log that none of a consumer's successful runs has processed.

    ``entries``: seq (unique), committed_at. ``runs``: consumer, outcome, from_seq (exclusive),
    to_seq (inclusive), read_at. Blocks of the sequence space that hold entries are the input units;
    gaps of any width cost nothing. Each successful run puts its blocks into its consumer's manifest
    with the size and checksum of the entries that it could see (in its range and committed when it
    read). A block that stands so now falls out in the anti-join; blocks changed since or seen in
    part do not, and only these are searched entry by entry. Null outcomes count as not successful,
    entries without a commit time as never processed, entries without a sequence are left out.
    Result: consumer, seq. The names of the consumers are collected, nothing else.
    """
    entries = entries.where(F.col("seq").isNotNull()).withColumn("unit", F.floor(F.col("seq") / block))
    content = F.count("*").alias("size"), F.bit_xor(F.xxhash64("seq", "committed_at")).alias("checksum")
    listing = cut_lineage(entries.groupBy("unit").agg(*content))
    good = runs.where((F.col("outcome") == "succeeded") & (F.col("from_seq") < F.col("to_seq")) & F.col("read_at").isNotNull() & F.col("consumer").isNotNull())
    first, last = F.col("from_seq") + 1, F.col("to_seq")
    ranges = good.select("consumer", "read_at", first.alias("first"), last.alias("last"), F.floor(first / block).alias("low"), F.floor(last / block).alias("high"))
    inside = units_within(listing.select("unit"), ranges).select(
        "consumer", "unit", "read_at",
        F.greatest("first", F.col("unit") * block).alias("first"), F.least("last", F.col("unit") * block + (block - 1)).alias("last"),
    )
    # Of runs over the same part of a block the one that read last has seen all that the others have.
    done = cut_lineage(inside.groupBy("consumer", "unit", "first", "last").agg(F.max("read_at").alias("read_at")))
    manifest = (
        entries.join(done, "unit").where("seq BETWEEN first AND last AND committed_at <= read_at")
        .groupBy("consumer", "unit", "first", "last", "read_at").agg(*content)
        .select("consumer", "unit", "size", "checksum")
    )
    consumers = [r[0] for r in runs.where(F.col("consumer").isNotNull()).select("consumer").distinct().collect()]
    if not consumers:
        return entries.select(F.lit(None).cast(runs.schema["consumer"].dataType).alias("consumer"), "seq").limit(0)
    units = listing.select("*", F.explode(F.array(*map(F.lit, consumers))).alias("consumer"))
    open_units = pending_units(units, manifest, ["consumer"]).select("consumer", "unit")
    e, d = entries.select("unit", "seq", "committed_at").join(open_units, "unit").alias("e"), done.alias("d")
    covered = (
        (F.col("e.consumer") == F.col("d.consumer")) & (F.col("e.unit") == F.col("d.unit"))
        & F.col("e.seq").between(F.col("d.first"), F.col("d.last")) & (F.col("e.committed_at") <= F.col("d.read_at"))
    )
    return e.join(d, covered, "left_anti").select("consumer", "seq")
