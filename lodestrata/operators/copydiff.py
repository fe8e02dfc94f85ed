"""Differences between two copies of keyed, versioned data by invertible Bloom lookup tables.

Each row is hashed where it is read, to 64 bits for the key and 64 for the value (different for values
that differ), and only hashes are shuffled to find the live newest rows, which enter the tables. Per
bucket of keys the two copies' tables are subtracted cell by cell, which cancels all equal rows; the
rest is peeled to the keys that differ. Only rows of those keys are fetched and compared field by field.

The table size follows an estimate of the number of differences on a fixed hash stratum. Buckets
that cannot be peeled are built again four times as large; if that fails twice, all keys of
the bucket are fetched, so no difference is lost. Hash collisions of unequal values (2^-64 a pair)
are the only way to miss one.

Null keys and tables are values of their own; rows without a sequence lose to any with one; among
rows with equal sequence the larger (is_deleted, value hash) counts; a null is_deleted means live.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.json_values import differing_paths, text_hash
from lodestrata.session import cut_lineage, ship

KEY = ["table_name", "row_key"]
#: Differences a bucket is sized for, and the part of its cells they may fill.
PER_BUCKET, LOAD = 8192, 0.6
#: One in so many elements is counted exactly to estimate the number of differences.
STRATUM = 64

#: Fixed values of the public 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5),
)


def _rotate(x, bits):
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hash_long(values, seed):
    with np.errstate(over="ignore"):
        h = seed + _P5 + np.uint64(8)
        h = h ^ (_rotate(values * _P2, 31) * _P1)
        h = _rotate(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def element_hash(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64(key, row)`` gives for two long columns."""
    seed = np.full(len(key), 42, np.uint64)
    return _hash_long(row.astype(np.int64).view(np.uint64), _hash_long(key.astype(np.int64).view(np.uint64), seed)).view(np.int64)


def positions(element: np.ndarray, cells: int) -> np.ndarray:
    """Three cells per element, one in each third of the table."""
    bits = element.view(np.uint64)
    return np.stack([((bits >> np.uint64(20 * j)) & np.uint64(cells - 1)).astype(np.int64) + j * cells for j in range(3)])


def peel(cell, count, key, row, element, cells):
    """(keys peeled, whether the table came out empty). Arrays are the non-zero cells of a table."""
    size = 3 * cells
    c, k, r, e = (np.zeros(size, np.int64) for _ in range(4))
    c[cell], k[cell], r[cell], e[cell] = count, key, row, element
    found: list[np.ndarray] = []
    look = np.asarray(cell)
    while len(look):
        one = look[np.abs(c[look]) == 1]
        one = one[e[one] == element_hash(k[one], r[one])]
        if not len(one):
            break
        _, first = np.unique(e[one], return_index=True)
        one = one[first]
        keys, rows, ids, signs = k[one].copy(), r[one].copy(), e[one].copy(), c[one].copy()
        found.append(keys)
        at = positions(ids, cells)
        for j in range(3):
            np.subtract.at(c, at[j], signs)
            np.bitwise_xor.at(k, at[j], keys)
            np.bitwise_xor.at(r, at[j], rows)
            np.bitwise_xor.at(e, at[j], ids)
        look = np.unique(at)
    clean = not (c.any() or k.any() or r.any() or e.any())
    return (np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)), clean


def _version(*more: str) -> Column:
    """What orders the versions of a key, and ``more`` to take along."""
    return F.struct("seq", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), text_hash(F.col("row_value")).alias("row_hash"), *more)


def newest_rows(copy: DataFrame) -> DataFrame:
    """The row with the highest sequence of each key: table_name, row_key, seq, is_deleted, row_hash, row_value."""
    return copy.groupBy(*KEY).agg(F.max(_version("row_value")).alias("r")).select(*KEY, "r.*")


def sketch_rows(copy: DataFrame, side: int) -> DataFrame:
    """key_id, row_hash, side of every live newest row; keys and values are hashed before they are shuffled."""
    newest = copy.select(F.xxhash64(*KEY).alias("key_id"), _version().alias("r")).groupBy("key_id").agg(F.max("r").alias("r"))
    return newest.where(~F.col("r.is_deleted")).select("key_id", "r.row_hash", F.lit(side).alias("side"))


def subtracted_tables(elements: DataFrame, buckets: int, cells: int) -> DataFrame:
    """Non-zero cells of (left table - right table) per bucket: bucket, cell, n, key_x, row_x, el_x."""
    e = elements.withColumn("el", F.xxhash64("key_id", "row_hash"))
    spots = F.array(*[
        F.shiftrightunsigned("el", 20 * j).bitwiseAND(F.lit(cells - 1)) + F.lit(j * cells) for j in range(3)
    ])
    return (
        e.select(F.pmod("key_id", F.lit(buckets)).alias("bucket"), F.explode(spots).alias("cell"), "side", "key_id", "row_hash", "el")
        .groupBy("bucket", "cell")
        .agg(F.sum("side").alias("n"), F.bit_xor("key_id").alias("key_x"), F.bit_xor("row_hash").alias("row_x"), F.bit_xor("el").alias("el_x"))
        .where("n <> 0 OR key_x <> 0 OR row_x <> 0 OR el_x <> 0")
    )


def _peeler(cells: int):
    def run(table: pd.DataFrame) -> pd.DataFrame:
        keys, clean = peel(*(table[c].to_numpy() for c in ("cell", "n", "key_x", "row_x", "el_x")), cells)
        bucket = int(table["bucket"].iloc[0])
        out = pd.DataFrame({"bucket": bucket, "key_id": pd.array(keys, dtype="Int64")})
        if clean:
            return out
        return pd.concat([out, pd.DataFrame({"bucket": [bucket], "key_id": pd.array([None], dtype="Int64")})])

    return run


def _table_size(differences: int) -> tuple[int, int]:
    buckets = max(1, -(-differences // PER_BUCKET))
    need = max(64, differences / buckets / LOAD / 3)
    return buckets, 1 << int(np.ceil(np.log2(need)))


def differing_keys(elements: DataFrame, first_estimate: int | None = None) -> DataFrame:
    """key_id of every key whose live rows are not equal on both sides (rarely others, never fewer).

    ``elements``: key_id, row_hash, side (+1 or -1), as from :func:`sketch_rows` of both copies.
    """
    elements = cut_lineage(elements)
    if first_estimate is None:
        stratum = elements.withColumn("el", F.xxhash64("key_id", "row_hash")).where(F.pmod("el", F.lit(STRATUM)) == 0)
        unequal = stratum.groupBy("el").agg(F.sum("side").alias("n")).where("n <> 0").count()
        first_estimate = int((unequal + 3 * unequal**0.5 + 4) * STRATUM)
    buckets, cells = _table_size(first_estimate)
    todo, found = elements, []
    for attempt in range(3):
        peeled = cut_lineage(
            subtracted_tables(todo, buckets, cells).groupBy("bucket").applyInPandas(_peeler(cells), "bucket bigint, key_id bigint")
        )
        found.append(peeled.where("key_id IS NOT NULL").select("key_id"))
        stuck = peeled.where("key_id IS NULL").select("bucket")
        if stuck.isEmpty():
            break
        left = todo.withColumn("bucket", F.pmod("key_id", F.lit(buckets))).join(stuck, "bucket", "left_semi").drop("bucket")
        todo = left
        buckets *= 4
    else:
        found.append(todo.select("key_id"))
    return reduce(DataFrame.unionAll, found).distinct()


def latest_reports(status: DataFrame) -> DataFrame:
    """table_name, node_id, last_applied_seq of the newest dated report that states one."""
    known = status.where(F.col("reported_at").isNotNull() & F.col("last_applied_seq").isNotNull())
    newest = F.max(F.struct("reported_at", "last_applied_seq")).alias("r")
    return known.groupBy("table_name", "node_id").agg(newest).select("table_name", "node_id", "r.last_applied_seq")


def compare_copies(leader: DataFrame, follower: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """table_name, row_key, finding (leader_only, follower_only, differs), field_path.

    With ``status`` the keys whose newest leader sequence the follower's node has not applied yet
    by its latest report are left out; a table without follower node or report leaves out nothing.
    """
    keys = differing_keys(sketch_rows(leader, 1).unionAll(sketch_rows(follower, -1)))
    keys = cut_lineage(keys)

    def fetch(copy: DataFrame) -> DataFrame:
        wanted = copy.select(*KEY, "seq", "is_deleted", "row_value", F.xxhash64(*KEY).alias("key_id"))
        return newest_rows(wanted.join(keys, "key_id", "left_semi"))

    a, b = fetch(leader).alias("a"), fetch(follower).alias("b")
    same = F.col("a.table_name").eqNullSafe(F.col("b.table_name")) & F.col("a.row_key").eqNullSafe(F.col("b.row_key"))
    here, there = F.col("a.is_deleted") == F.lit(False), F.col("b.is_deleted") == F.lit(False)
    both = a.join(b, same, "full").select(
        F.when(F.col("a.is_deleted").isNotNull(), F.col("a.table_name")).otherwise(F.col("b.table_name")).alias("table_name"),
        F.when(F.col("a.is_deleted").isNotNull(), F.col("a.row_key")).otherwise(F.col("b.row_key")).alias("row_key"),
        F.col("a.seq").alias("leader_seq"), F.coalesce(here, F.lit(False)).alias("here"), F.coalesce(there, F.lit(False)).alias("there"),
        F.col("a.row_value").alias("left"), F.col("b.row_value").alias("right"),
    ).where("here OR there")
    if status is not None:
        nodes = follower.groupBy("table_name").agg(F.max("node_id").alias("node_id"))
        applied = nodes.join(latest_reports(status), ["table_name", "node_id"]).select("table_name", "last_applied_seq")
        both = both.join(applied, "table_name", "left").where(
            F.coalesce(F.col("leader_seq") <= F.col("last_applied_seq"), F.lit(True))
        )
    paired = F.col("here") & F.col("there")
    compared = both.select(
        *KEY, "here", "there", differing_paths(F.when(paired, F.col("left")), F.when(paired, F.col("right"))).alias("paths")
    )
    finding = F.when(F.col("here") & F.col("there"), "differs").when(F.col("here"), "leader_only").otherwise("follower_only")
    paths = F.when(F.col("here") & F.col("there"), F.col("paths")).otherwise(F.array(F.lit("")))
    return compared.select(*KEY, finding.alias("finding"), F.explode(paths).alias("field_path"))


ship(__name__)
