"""Queries that must give every row of their job, at sizes where a cut would show."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import exactly_once, incremental
from lodestrata.queries import data_problems, engine_queries

LARGE = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", [
    "rel_select_text_eq_ci", "join_where", "join_star_projection", "view_filter", "view_over_view", "doc_value_exact", "doc_json_eq_int", "index_eq_lookup",
])
def test_no_row_is_cut(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("events", "customer", "orders"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{LARGE}/{table}.parquet'")
    sql = engine_queries.ORACLE[name]
    want = sorted(map(repr, con.sql(sql).fetchall()))
    got = engine_queries.QUERIES[name](spark, LARGE)
    assert "LIMIT" not in sql and sorted(repr(tuple(r)) for r in got.collect()) == want and len(want) > 900


def test_p7_found_comes_from_ranges_carried_over_batches(spark, sf_dir, monkeypatch):
    merged = []

    def merge(accepted, seen=None, chunk=exactly_once.CHUNK, build=exactly_once.merge_ranges):
        merged.append(build(accepted, seen, chunk))
        return merged[-1]

    monkeypatch.setattr(exactly_once, "merge_ranges", merge)
    got = sorted(map(tuple, data_problems.p7_found(spark, sf_dir).select("seq", "delivery_id").collect()))
    log = spark.read.parquet(f"{sf_dir}/change_log.parquet").select("seq", "delivery_id").toPandas().dropna()
    late = log[log.delivery_id > log.groupby("seq").delivery_id.transform("min")]
    assert got == sorted(zip(late.seq, late.delivery_id)) and got
    assert len(merged) == exactly_once.BATCHES - 1 and 0 < merged[0].count() and merged[0].agg({"high": "max"}).first()[0] <= log.seq.max()


def test_odd_deliveries_over_batches(spark):
    rows = [(1, 10), (1, 10), (2, 11), (90, 10), (100, 12), (101, 12), (None, 10), (None, None), (5, None)]
    got = exactly_once.screen_batches(spark.createDataFrame(rows, "delivery_id long, seq long"))
    assert sorted(tuple(r) for r in got.where("late").select("seq", "delivery_id").collect()) == [(10, 90), (12, 101)]
    assert exactly_once.screen_batches(spark.createDataFrame([], "delivery_id long, seq long")).count() == 0


def test_the_manifest_holds_what_a_run_could_see(spark, monkeypatch):
    taken = []

    def pending(listing, manifest, by=None, join=incremental.pending_units):
        taken.extend([listing, manifest])
        return join(listing, manifest, by)

    monkeypatch.setattr(incremental, "pending_units", pending)
    entries = spark.createDataFrame([(1, 10), (2, 10), (3, 30), (4, 10), (11, 10), (12, 10)], "seq long, committed_at long")
    runs = spark.createDataFrame([("a", "succeeded", 0, 20, 20)], "consumer string, outcome string, from_seq long, to_seq long, read_at long")
    got = incremental.unprocessed_entries(entries, runs, block=10).collect()
    assert [tuple(r) for r in got] == [("a", 3)]
    sizes = [{(r.consumer, r.unit): r["size"] for r in rows.collect()} for rows in taken]
    # The block with the late entry stands in the manifest as it was; the anti-join finds that it changed.
    assert sizes == [{("a", 0): 4, ("a", 1): 2}, {("a", 0): 3, ("a", 1): 2}]


def test_ranges_of_any_width_cost_what_there_is(spark):
    entries = spark.createDataFrame([(1, 10), (10**17, 10), (-(10**15), 10), (5, 99)], "seq long, committed_at long")
    runs = spark.createDataFrame([("a", "succeeded", 0, 10**18, 50), ("b", "succeeded", -(10**16), 4, 50), ("c", "failed", 0, 1, 1)], "consumer string, outcome string, from_seq long, to_seq long, read_at long")
    got = {tuple(r) for r in incremental.unprocessed_entries(entries, runs).collect()}
    assert got == {("a", -(10**15)), ("a", 5), ("b", 10**17), ("b", 5), ("c", 1), ("c", 10**17), ("c", -(10**15)), ("c", 5)}


def test_dyadic_cover_is_exact(spark):
    units = spark.range(-40, 200).select(F.col("id").alias("unit"))
    ranges = [(a, b) for a in (-33, -1, 0, 1, 7, 64, 150) for b in (-20, 0, 1, 8, 63, 100, 300) if a <= b]
    got = incremental.units_within(units, spark.createDataFrame(ranges, "low long, high long")).collect()
    want = sorted((a, b, u) for a, b in ranges for u in range(-40, 200) if a <= u <= b)
    assert sorted((r.low, r.high, r.unit) for r in got) == want


def test_without_the_ranges_nothing_is_late_across_batches(spark, sf_dir, monkeypatch):
    """Rows come from the ranges: if these are left out, deliveries of later batches slip through."""
    whole = data_problems.p7_found(spark, sf_dir).count()
    monkeypatch.setattr(exactly_once, "uncovered", lambda numbers, seen, chunk=0: numbers)
    assert data_problems.p7_found(spark, sf_dir).count() < whole
