"""Replica lag, read consistency and table placement as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.names import EngineError

POLICIES = ("eventual", "session", "bounded", "strong")


def lag(leader: Column, applied: Column) -> Column:
    """max(0, leader - applied); NULL if either is unknown."""
    return F.when(leader.isNotNull() & applied.isNotNull(), F.greatest(F.lit(0), leader - applied))


def lag_status(leader: Column, applied: Column) -> Column:
    behind = lag(leader, applied)
    return F.when(behind.isNull(), "unknown").when(behind == 0, "caught-up").otherwise("behind")


def policy(name: str | None) -> str:
    """The read policy of a name; eventual if none is given."""
    chosen = (name or "eventual").strip().lower()
    if chosen not in POLICIES:
        raise EngineError(f"unknown read consistency '{name}'")
    return chosen


def min_eligible(latest: int, max_lag: int) -> int:
    """The lowest sequence a bounded read may be served from."""
    return max(0, latest - max_lag)


def eligible(applied: Column, name: str, latest: Column | None = None, max_lag: Column | None = None, token: Column | None = None) -> Column:
    """Whether a replica that has applied a sequence may serve a read."""
    chosen = policy(name)
    if chosen == "eventual":
        return F.lit(True)
    need = {"session": token, "strong": latest, "bounded": None if latest is None or max_lag is None else F.greatest(F.lit(0), latest - max_lag)}[chosen]
    if need is None:
        raise EngineError(f"{chosen} reads need a sequence to compare with")
    return F.coalesce(applied >= need, F.lit(False))


def least_loaded(assigned: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node that leads fewest tables (ties by name): node_id, tables."""
    led = assigned.groupBy("node_id").agg(F.count("*").alias("tables"))
    return nodes.join(led, "node_id", "left").select("node_id", F.coalesce("tables", F.lit(0)).alias("tables")).orderBy("tables", "node_id").limit(1)


def monitoring(reports: DataFrame, leader: DataFrame) -> DataFrame:
    """The state of every table on every node by its newest report, with its lag behind the leader.

    ``reports``: table_name, node_id, enabled, node_role, current_term, last_applied_seq, reported_at;
    ``leader``: table_name, leader_seq. Reports without a time are older than any. Of reports of one time the
    one with the highest term and sequence counts. A node that is not enabled is ``disabled``, whatever it reports;
    tables of which no leader is known have an unknown lag.
    """
    newest = F.max(F.struct("reported_at", "current_term", "last_applied_seq", "node_role", "enabled")).alias("r")
    latest = reports.groupBy("table_name", "node_id").agg(newest).select("table_name", "node_id", "r.*")
    both = latest.join(leader, "table_name", "left")
    behind = lag(F.col("leader_seq"), F.col("last_applied_seq"))
    status = F.when(~F.coalesce("enabled", F.lit(False)), "disabled").otherwise(lag_status(F.col("leader_seq"), F.col("last_applied_seq")))
    return both.select("table_name", "node_id", "node_role", "current_term", "last_applied_seq", "leader_seq", behind.alias("lag"), status.alias("status"))


def ring_start(table: Column, nodes: int) -> Column:
    """Where a table starts in the sorted node list: the first two bytes of SHA-256, little-endian."""
    digest = F.sha2(table, 256)
    low, high = F.conv(F.substring(digest, 1, 2), 16, 10), F.conv(F.substring(digest, 3, 2), 16, 10)
    return ((low.cast("int") + high.cast("int") * 256) % nodes).cast("int")


def plan_ownership(tables: DataFrame, nodes: list[str], factor: int) -> DataFrame:
    """table_name, term, leader and members; the same for any order of the inputs.

    Members follow the ring from where the table starts. ``tables`` may carry ``current_leader`` and
    ``current_term``: a leader that is among the planned members stays and so does its term, any
    other gives way to the first member in the next term. Table names ignore case, repeated ones
    count once (by the highest term); blank node names are no nodes.
    """
    ring = sorted({n for n in nodes if n and n.strip()})
    if not ring:
        raise EngineError("no nodes", 503)
    count = min(max(1, factor), len(ring))
    ringed = F.array(*map(F.lit, ring * 2))
    leader = F.col("current_leader") if "current_leader" in tables.columns else F.lit(None).cast("string")
    term = F.col("current_term") if "current_term" in tables.columns else F.lit(None).cast("bigint")
    known = tables.groupBy(F.lower("table_name").alias("table_name")).agg(F.max(F.struct(term.alias("term"), leader.alias("leader"))).alias("old"))
    planned = known.withColumn("members", F.slice(ringed, ring_start(F.col("table_name"), len(ring)) + 1, F.lit(count)))
    stays = F.coalesce(F.array_contains("members", F.col("old.leader")), F.lit(False))
    moved = F.when(F.col("old.leader").isNotNull() & ~stays, 1).otherwise(0)
    return planned.select(
        "table_name", F.coalesce(F.col("old.term") + moved, F.lit(1)).cast("bigint").alias("term"),
        F.when(stays, F.col("old.leader")).otherwise(F.col("members")[0]).alias("leader"), "members",
    )


def nearest_rank(samples: DataFrame, value: str, fractions: list[float], by: list[str] | None = None) -> DataFrame:
    """Percentiles by nearest rank, the value at sorted index ceil(n * f) - 1, per group: fraction, value.

    The exact built-in aggregate keeps a count per distinct value and combines before the shuffle.
    """
    by = by or []
    picks = [F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY {value})").alias(f"p{i}") for i, f in enumerate(fractions)]
    wide = samples.groupBy(*by).agg(*picks)
    pairs = F.array(*[F.struct(F.lit(f).cast("double").alias("fraction"), F.col(f"p{i}").alias("value")) for i, f in enumerate(fractions)])
    return wide.select(*by, F.inline(pairs))
