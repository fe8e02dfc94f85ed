"""The general data problems over whole given tables against brute force, and their odd cases."""

import brute
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions.json_values import json_loader, text_hash, unequal_paths
from lodestrata.operators import change_feed, copydiff, drift, exactly_once, incremental, nested, snapshots
from lodestrata.queries import data_problems as q


def rows_of(df, *columns):
    found = [tuple(r) for r in df.select(*columns).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_p1_found(spark, sf_dir):
    got = rows_of(q.p1_found(spark, sf_dir), "table_name", "file_id", "change_kind", "field_path", "old_path")
    assert got == brute.p1(brute.read(sf_dir, "kv_files")) and len(got) > 5


def test_p2_found(spark, sf_dir):
    got = rows_of(q.p2_found(spark, sf_dir), "table_name", "row_key", "parent_path", "node_path")
    assert got == brute.p2(brute.read(sf_dir, "doc_rows"), q.NESTED) and len(got) > 50


def test_p4_found(spark, sf_dir):
    got = rows_of(q.p4_found(spark, sf_dir), "table_name", "row_key", "finding", "field_path")
    want = brute.p4(*(brute.read(sf_dir, n) for n in ("kv_leader", "kv_follower", "node_status")))
    assert got == want and {x[2] for x in got} == {"leader_only", "follower_only", "differs"}


def test_p6_found(spark, sf_dir):
    got = rows_of(q.p6_found(spark, sf_dir), "table_name", "snapshot_seq", "row_key", "change_kind")
    assert got == brute.p6(brute.read(sf_dir, "table_snapshots")) and len(got) > 3


def test_p3_p5_p7_found(spark, sf_dir):
    log, runs = brute.read(sf_dir, "change_log"), brute.read(sf_dir, "run_log")
    first, newest = {}, {}
    for r in log:
        if r["seq"] not in first or r["delivery_id"] < first[r["seq"]]["delivery_id"]:
            first[r["seq"]] = r
        k = (r["table_name"] or "kv").lower(), r["row_key"]
        if k not in newest or r["seq"] > newest[k]["seq"]:
            newest[k] = r
    done = [r for r in runs if r["outcome"] == "succeeded"]
    p3 = {
        (c, s) for c in {r["consumer"] for r in runs} for s, e in first.items()
        if not any(r["consumer"] == c and r["from_seq"] < s <= r["to_seq"] and e["committed_at"] <= r["read_at"] for r in done)
    }
    gone = lambda r: (r["operation"].strip().lower() == "delete") if r["is_deleted"] is None else r["is_deleted"]
    assert rows_of(q.p3_found(spark, sf_dir), "consumer", "seq") == p3
    assert rows_of(q.p5_found(spark, sf_dir), "table_name", "row_key", "seq") == {(*k, r["seq"]) for k, r in newest.items() if not gone(r)}
    late = {(r["seq"], r["delivery_id"]) for r in log if first[r["seq"]]["delivery_id"] != r["delivery_id"]}
    assert rows_of(q.p7_found(spark, sf_dir), "seq", "delivery_id") == late


FILES = "table_name string, file_id long, written_at timestamp_ntz, row_key string, row_value string, fields int"


def test_drift_odd_cases(spark, tmp_path):
    import datetime

    day = [datetime.datetime(2025, 1, d) for d in range(1, 6)]
    data = [
        ("t", 1, day[0], "a", '{"x": 1, "k": "u"}', 0), ("t", 1, day[0], "b", '{"x": 2, "k": "v"}', 0),
        ("t", 2, day[1], "a", '{"y": 1, "k": "u"}', 0), ("t", 2, day[1], "b", '{"y": 2, "k": "v"}', 0), ("t", 2, day[1], "b", '{"y": 2, "k": "v"}', 0),
        ("t", 3, day[2], "a", '{"z": 1, "k": 5}', 0), ("t", 3, day[2], "b", '{"z": 2.0, "k": 6, "z2": null}', 0), ("t", 3, day[2], "c", "{broken", 0),
        ("t", 4, day[3], "a", None, 0), (None, 9, None, None, None, 0), (None, 10, day[0], None, '{"n": true}', 0),
    ]
    rows = spark.createDataFrame(data, FILES)
    got = rows_of(drift.migration_steps(rows), "table_name", "file_id", "change_kind", "field_path", "old_path")
    assert got == {
        ("t", 2, "renamed", "y", "x"), ("t", 3, "renamed", "z", "y"), ("t", 3, "retyped", "k", ""), ("t", 3, "added", "z2", ""),
        ("t", 4, "removed", "z", ""), ("t", 4, "removed", "k", ""), ("t", 4, "removed", "z2", ""), (None, 10, "added", "n", ""),
    }
    registry = drift.SchemaRegistry(spark, str(tmp_path / "r"))
    registry.add(rows)
    table = drift.consistent_rows(rows, registry).select("file_id", "row_key", F.inline("fields"))
    flat = {(r.file_id, r.row_key, r.field_path): (r.value, r.cast_failed) for r in table.collect()}
    assert flat[1, "a", "z"] == ("1", False) and flat[2, "b", "z"] == ("2", False)
    assert flat[1, "a", "k"] == ("u", True) and flat[3, "a", "k"] == ("5", False) and flat[3, "c", "k"] == (None, False)
    assert flat[10, None, "n"] == ("true", False) and flat[9, None, "n"] == (None, False)
    assert drift.migration_steps(rows.limit(0)).count() == 0
    assert drift.schema_versions(drift.file_schemas(rows)).where("table_name = 't'").count() == 4
    assert rows_of(registry.steps(), "table_name", "file_id", "change_kind", "field_path", "old_path") == got


def _files(spark, *files):
    """Files of table t in order; each a dict of row keys to JSON."""
    import datetime

    data = [("t", n, datetime.datetime(2025, 1, 1, n), k, v, 0) for n, file in enumerate(files) for k, v in file.items()]
    return spark.createDataFrame(data, FILES)


def test_names_that_end_and_come_back(spark, tmp_path):
    """b is b, ends, then a is renamed to b; c ends and comes back as another field."""
    rows = _files(
        spark, {"x": '{"a": 1, "b": 7, "c": "old"}', "y": '{"a": 2, "b": 8, "c": "old"}'}, {"x": '{"a": 1}', "y": '{"a": 2}'},
        {"x": '{"b": 1, "c": 5}', "y": '{"b": 2, "c": 6}'},
    )
    registry = drift.SchemaRegistry(spark, str(tmp_path / "r"))
    registry.add(rows)
    found = drift.consistent_rows(rows, registry, {"b": "0"}).select("file_id", "row_key", F.inline("fields")).collect()
    assert len(found) == len({(r.file_id, r.row_key, r.field_path, r.since) for r in found}) == 6 * 4
    value = {(r.file_id, r.row_key, r.field_path, r.since): r.value for r in found}
    assert [value[n, "x", "b", 3] for n in range(3)] == ["1", "1", "1"] and [value[n, "x", "b", 1] for n in range(3)] == ["7", "0", "0"]
    assert [value[n, "y", "c", 3] for n in range(3)] == [None, None, "6"] and [value[n, "y", "c", 1] for n in range(3)] == ["old", None, None]
    wide = drift.consistent_table(rows, registry, "t")
    assert dict(wide.dtypes)["b"] == "bigint" and dict(wide.dtypes)["c@1"] == "string"
    assert {(r.file_id, r.row_key): (r.b, r["b@1"], r.c, r["c@1"]) for r in wide.collect()}[1, "y"] == (2, None, None, None)


def test_renames_in_a_cycle_and_a_chain(spark, tmp_path):
    rows = _files(spark, *[{"x": f'{{"{n}": 1, "k": {i}}}', "y": f'{{"{n}": 2, "k": {i}}}'} for i, n in enumerate("abcabd")])
    registry = drift.SchemaRegistry(spark, str(tmp_path / "r"))
    registry.add(rows)
    assert {r.field_path for r in registry.steps().where("change_kind = 'renamed'").collect()} == set("abcd")
    found = drift.consistent_rows(rows, registry).select("file_id", "row_key", F.inline("fields")).where("field_path <> 'k'").collect()
    assert {(r.field_path, r.row_key, r.value) for r in found} == {("d", "x", "1"), ("d", "y", "2")} and len(found) == 12


def test_the_registry_profiles_only_new_files(spark, tmp_path, monkeypatch):
    files = [{"x": '{"a": 1}'}, {"x": '{"b": 1}'}, {"x": '{"c": 1, "n": 5}'}, {"x": '{"c": 1, "m": 5}'}]
    rows = _files(spark, *files)
    registry, parsed = drift.SchemaRegistry(spark, str(tmp_path / "r")), []

    def leaves(part, read=drift.row_leaves):
        parsed.append({r.file_id for r in part.select("file_id").distinct().collect()})
        return read(part)

    monkeypatch.setattr(drift, "row_leaves", leaves)
    registry.add(rows.where("file_id IN (0, 2)"))
    registry.add(rows.where("file_id IN (0, 2, 3)"))
    registry.add(rows)  # file 1 arrives late, between 0 and 2
    registry.add(rows)
    assert parsed == [{0, 2}, {3}, {2}, {1}, {0, 2}, set(), set()]
    got = rows_of(registry.steps(), "file_id", "change_kind", "field_path", "old_path")
    assert got == rows_of(drift.migration_steps(rows), "file_id", "change_kind", "field_path", "old_path") and len(got) == 4


def test_nested_odd_cases(spark):
    data = [
        ("t", "1", '{"a": [{"b": {"x": 1}}, 3, null, "void", "{\\"b\\": \\"[{}, {}]\\"}"]}', 0),
        ("t", "2", '{"a": {"b": [1]}} junk', 0), ("t", "3", None, 0), ("t", "4", "", 0), ("t", "5", "[]", 0), ("t", "6", '{"a": "[1,"}', 0),
        ("t", "7", '"{\\"a\\": {}}"', 0), ("t", "8", '{"a": [' + ",".join(["{}"] * 3000) + "]}", 0), ("t", None, '{"a": [{}]}', 0), ("t", None, '{"a": [{}]}', 0),
    ]
    rows = spark.createDataFrame(data, "table_name string, row_key string, row_value string, node_path int")
    found = [tuple(r) for r in nested.all_nodes(rows, {"t": ["a", "a.b"]}).collect()]
    got = {x[1:] for x in found if x[1] != "8"}
    assert got == {
        ("1", "", "a[0]"), ("1", "", "a[4]"), ("1", "a[0]", "a[0].b[0]"), ("1", "a[4]", "a[4].b[0]"), ("1", "a[4]", "a[4].b[1]"),
        ("7", "", "a[0]"), (None, "", "a[0]"),
    }
    assert len(found) == len(got) + 3000
    flat = nested.flatten_records(rows, ["a", "a.b"], ["row_key"])["a.b"]
    assert [r.x for r in nested.typed_columns(flat, "x int").where("row_key = '1' AND parent_path = 'a[0]'").collect()] == [1]
    assert nested.all_nodes(rows.limit(0), {"t": ["a"]}).count() == 0
    # The last of repeated members counts; a second value or an early end of the text breaks a record.
    odd = [("t", "1", '{"a": 5, "a": [{"b": {}, "b": "\\u005b{}, {}]"}]}'), ("t", "2", '{"a": [{}]}], [{}'), ("t", "3", '{"a": [{}]},{"a": [{}]}'), ("t", "4", "{'a': [{}]}"), ("t", "5", '{"a": [{"b": NaN}]}')]
    found = nested.all_nodes(spark.createDataFrame(odd, "table_name string, row_key string, row_value string"), {"t": ["a", "a.b"]})
    assert {tuple(r)[1:] for r in found.collect()} == {("1", "", "a[0]"), ("1", "a[0]", "a[0].b[0]"), ("1", "a[0]", "a[0].b[1]")}


def test_incremental_survives_failure(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "a.txt").write_text("one\ntwo")
    manifest = incremental.Manifest(spark, str(tmp_path / "manifest"))

    def listing():
        return incremental.list_files(spark, str(inbox))

    def process(units):
        return units.select("unit")

    def fails(units):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        incremental.run_batch(spark, listing(), manifest, "b1", out, fails)
    assert manifest.read().count() == 0
    assert incremental.run_batch(spark, listing(), manifest, "b1", out, process)
    assert not incremental.run_batch(spark, listing(), manifest, "b1", out, process)
    assert incremental.pending_units(listing(), manifest.read()).count() == 0
    (inbox / "a.txt").write_text("one\ntwa")
    (inbox / "b.txt").write_text("new")
    (inbox / "empty.txt").write_text("")
    assert incremental.pending_units(listing(), manifest.read()).count() == 2
    assert incremental.run_batch(spark, listing(), manifest, "b2", out, process)
    assert spark.read.parquet(out).count() == 3


def test_unprocessed_odd_cases(spark):
    entries = spark.createDataFrame([(1, 10), (2, 10), (3, 99), (4, None), (None, 1)], "seq long, committed_at long")
    runs = spark.createDataFrame(
        [("c", "succeeded", 0, 3, 50), ("c", None, 0, 9, 500), ("d", "failed", 0, 9, 500), ("c", "succeeded", None, 9, 500), (None, "succeeded", 0, 9, 500)],
        "consumer string, outcome string, from_seq long, to_seq long, read_at long",
    )
    want = {("c", 3), ("c", 4), ("d", 1), ("d", 2), ("d", 3), ("d", 4)}
    for block in (1, 2, 8192):
        assert rows_of(incremental.unprocessed_entries(entries, runs, block), "consumer", "seq") == want
    assert incremental.unprocessed_entries(entries.limit(0), runs).count() == 0
    assert incremental.unprocessed_entries(entries, runs.limit(0)).count() == 0


def test_element_hash_is_sparks(spark):
    keys = np.array([0, -1, 5, 2**62, -(2**63)], np.int64)
    rows = np.array([7, 7, -9, 1, 0], np.int64)
    df = spark.createDataFrame(list(zip(keys.tolist(), rows.tolist())), "k long, r long").coalesce(1)
    assert [r[0] for r in df.select(F.xxhash64("k", "r")).collect()] == copydiff.element_hash(keys, rows).tolist()


def test_tables_too_small_are_rebuilt(spark):
    left = spark.range(3000).select(F.xxhash64("id").alias("key_id"), F.col("id").alias("row_hash"), F.lit(1).alias("side"))
    right = spark.range(50).select(F.xxhash64("id").alias("key_id"), (F.col("id") + 1).alias("row_hash"), F.lit(-1).alias("side"))
    for estimate in (1, 200):
        assert copydiff.differing_keys(left.unionAll(right), estimate).count() == 3000
    assert copydiff.differing_keys(left.unionAll(left.withColumn("side", F.lit(-1)))).count() == 0


def test_copydiff_odd_cases(spark):
    schema = "seq long, table_name string, row_key string, row_value string, is_deleted boolean, finding int"
    left = [(1, "t", "a", '{"p": 1.0, "q": null}', False, 0), (2, "t", "b", "x", None, 0), (3, "t", None, "n", False, 0), (4, "t", "d", None, False, 0),
            (5, "t", "e", '{"p": {"q": [1, 2]}}', False, 0), (6, "t", "f", "y", True, 0), (1, "t", "a", '{"p": 1}', False, 0)]
    right = [(1, "t", "a", ' {"p":1}', False, 0), (2, "t", "b", "x ", False, 0), (4, "t", "d", None, False, 0), (5, "t", "e", '{"p": {"q": [2, 1], "r": ""}}', False, 0),
             (5, "t", "f", "y", False, 0)]
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = rows_of(copydiff.compare_copies(a, b), "row_key", "finding", "field_path")
    assert got == {("b", "differs", ""), (None, "leader_only", ""), ("e", "differs", "p.q"), ("e", "differs", "p.r"), ("f", "follower_only", "")}
    assert copydiff.compare_copies(a.limit(0), b.limit(0)).count() == 0
    assert {r.finding for r in copydiff.compare_copies(a.limit(0), b).collect()} == {"follower_only"}


def test_equality_deletes(spark, tmp_path):
    schema = "seq long, table_name string, row_key string, operation string, is_deleted boolean, row_value string, salt int"
    data = [(3, "KV", "a", "put", False, "3", 0), (1, None, "a", " DELETE ", None, None, 0), (2, "kv", "a", "put", None, "2", 0), (3, "kv", "a", "PUT", False, "3", 0),
            (5, "kv", "b", None, True, None, 0), (4, "kv", "b", "put", False, "4", 0), (6, "kv", None, None, None, "n", 0), (None, "kv", "z", "put", False, "", 0)]
    feed = spark.createDataFrame(data, schema)
    table = change_feed.EqualityDeleteTable(spark, str(tmp_path / "t"))
    for _ in range(2):
        table.append(feed.where("seq < 4"), "one")
    table.append(feed.where("seq >= 4"), "two")
    want = {("kv", "a", 3, "3"), ("kv", None, 6, "n")}
    assert rows_of(table.read(), "table_name", "row_key", "seq", "row_value") == want
    table.compact(str(tmp_path / "c"))
    small = change_feed.EqualityDeleteTable(spark, str(tmp_path / "c"))
    assert rows_of(small.read(), "table_name", "row_key", "seq", "row_value") == want
    small.append(spark.createDataFrame([(4, "kv", "b", "put", False, "late", 0)], schema), "late")
    assert rows_of(small.read(), "table_name", "row_key", "seq", "row_value") == want
    assert change_feed.read_live(*change_feed.split_changes(feed.limit(0))).count() == 0


def test_snapshots_odd_cases(spark):
    data = [("t", 1, "a", '{"x": 1}', 0), ("t", 1, "a", '{"x": 1}', 0), ("t", 1, "b", "p", 0), ("t", 1, None, "n", 0), ("t", 1, "v", None, 0),
            ("t", 5, "a", '{"x":1.0,"y":null}', 0), ("t", 5, "c", "q", 0), ("t", 5, None, "m", 0), ("t", 5, "v", "", 0),
            ("t", 9, "b", "p", 0), ("u", 3, "a", "z", 0), ("t", None, "a", "lost", 0)]
    rows = spark.createDataFrame(data, "table_name string, snapshot_seq long, row_key string, row_value string, before int")
    got = rows_of(snapshots.snapshot_changes(rows).drop("changed_paths"), "snapshot_seq", "row_key", "change_kind")
    assert got == {(5, "b", "removed"), (5, "c", "added"), (5, None, "changed"), (5, "v", "changed"), (9, "a", "removed"), (9, "c", "removed"),
                   (9, None, "removed"), (9, "v", "removed"), (9, "b", "added")}
    assert snapshots.snapshot_changes(rows.limit(0)).count() == 0


def test_kept_snapshots(spark, tmp_path):
    data = [("t", 1, "a", '{"x": 1}'), ("t", 1, "a", '{"x": 1}'), ("t", 1, "b", "p"), ("t", 1, None, "n"), ("t", 1, "v", None), ("t", 5, "a", '{"x":1.0,"y":null}'), ("t", 5, "c", "q"),
            ("t", 5, None, "m"), ("t", 5, "v", ""), ("t", 9, "b", "p"), ("u", 3, "a", "z"), (None, 2, "a", "1"), (None, 4, "a", "2"), ("t", None, "a", "lost"), ("t", 9, "", "e")]
    rows = spark.createDataFrame(data, "table_name string, snapshot_seq long, row_key string, row_value string")
    want = rows_of(snapshots.snapshot_changes(rows).drop("changed_paths"), "table_name", "snapshot_seq", "row_key", "change_kind")
    store = snapshots.SnapshotStore(spark, str(tmp_path / "s"), ranges=3)
    assert store.changes().count() == 0
    store.add(rows.where("snapshot_seq <> 5"))
    store.add(rows.where("snapshot_seq = 5 OR snapshot_seq IS NULL"))
    store.add(rows.limit(0))
    again = snapshots.SnapshotStore(spark, str(tmp_path / "s"), ranges=99)
    assert again.ranges == 3 and rows_of(again.changes().drop("changed_paths"), "table_name", "snapshot_seq", "row_key", "change_kind") == want and len(want) == 11
    assert {r.snapshot_seq for r in again.changes(since=5).collect()} == {9}


def test_snapshot_merge_has_no_hash_exchange_after_ranging(spark, sf_dir, capsys):
    q.p6_found(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    above = plan[: plan.index("rangepartitioning")]
    assert "Window" in above and "hashpartitioning" not in above


def test_ranges_over_batches(spark):
    one = spark.createDataFrame([(1, 10), (2, 11), (3, 10), (4, 70000), (5, None)], "delivery_id long, seq long")
    first = exactly_once.screen(one)
    assert rows_of(first.where("late"), "delivery_id") == {(3,)}
    seen = exactly_once.merge_ranges(first.where("NOT late"))
    assert rows_of(seen, "low", "high") == {(10, 11), (70000, 70000)}
    two = spark.createDataFrame([(6, 11), (7, 12), (8, 9), (9, 70000), (10, 12)], "delivery_id long, seq long")
    second = exactly_once.screen(two, seen)
    assert rows_of(second.where("late"), "delivery_id") == {(6,), (9,), (10,)}
    seen = exactly_once.merge_ranges(second.where("NOT late"), seen)
    assert rows_of(seen, "low", "high") == {(9, 12), (70000, 70000)}
    hot = spark.range(5000).select(F.col("id").alias("delivery_id"), F.lit(7).cast("long").alias("seq"))
    assert exactly_once.screen(hot).where("NOT late").collect()[0].delivery_id == 0
    assert exactly_once.screen(hot).where("late").count() == 4999
    assert exactly_once.screen(hot.limit(0)).count() == 0


def test_malformed_identifiers(spark):
    data = [(1, "p:1"), (2, "p:1"), (3, "q:1"), (4, "??"), (5, "??"), (6, None), (7, None), (8, "p:x1"), (9, "old"), (10, "p:99999999999999999999")]
    got = exactly_once.screen_identifiers(
        spark.createDataFrame(data, "delivery_id long, identifier string"), seen_texts=spark.createDataFrame([("old",)], "identifier string")
    )
    assert rows_of(got.where("late"), "delivery_id") == {(2,), (5,), (9,)}
    assert got.count() == len(data)


def test_value_hashes_differ_where_values_do(spark):
    groups = [
        ['{"a": 1.0, "b": [1, 2]}', '{"b":[1,2],"a":1}'], ['{"a": 2}'], ['{"a": "1"}'], ['{"a": 1e2}'], ['{"a": 100000000000000000000000000000000000000001e1}'],
        ['{"a": 100000000000000000000000000000000000000002e1}'], ['{"a": 1} x'], ['{"a": 1}'], ["1"], ["1.0"], ["[1]"], ["[1.0]"], ["1], [2"], ['{"a": 1}], [{}'], [""], [None], ["x"],
    ]
    rows = [(i, v) for i, g in enumerate(groups) for v in g]
    got = spark.createDataFrame(rows, "g int, v string").select("g", text_hash(F.col("v")).alias("h")).distinct().collect()
    assert len(got) == len({r.h for r in got}) == len(groups)


def test_changes_that_hash_alike_are_no_differences(spark):
    schema = "seq long, table_name string, row_key string, row_value string, is_deleted boolean"
    a = spark.createDataFrame([(1, "t", str(i), '{"p": 1e2, "q": null, "r": 1}', False) for i in range(50)], schema)
    b = spark.createDataFrame([(1, "t", str(i), '{"r": 1.00, "p": 100}', False) for i in range(50)], schema)
    assert copydiff.compare_copies(a, b).count() == 0
    two = a.unionAll(a.withColumn("row_value", F.lit('{"p": 3}')))
    assert copydiff.compare_copies(two, two).count() == 0 and copydiff.compare_copies(two, a).where("finding <> 'differs'").count() == 0


_NUMBERS = st.sampled_from(["0", "-0", "1", "1.0", "10", "1e1", "1.5", "1.50", "0.1", "12345678901234567", "12345678901234568", "1234567890123456789.5", "100000000000000000000", "1E2"])
_VALUES = st.recursive(
    _NUMBERS | st.sampled_from(['"a"', '"1"', '"1.0"', "true", "null", '"\\u0061"', '"\\n"', '""', '"a\\"b"']),
    lambda inner: st.lists(inner, max_size=3).map(lambda x: "[" + ", ".join(x) + "]") | st.dictionaries(st.sampled_from("abc"), inner, max_size=3).map(lambda d: "{" + ",".join(f'"{k}":{v}' for k, v in d.items()) + "}"),
    max_leaves=5,
)
_RECORDS = st.dictionaries(st.sampled_from("ab"), _VALUES, max_size=2).map(lambda d: "{" + ", ".join(f'"{k}": {v}' for k, v in d.items()) + "}")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow, HealthCheck.data_too_large])
@given(st.lists(_RECORDS | _VALUES | st.sampled_from(["{} x", "{", "", '{"a":1}], [{}']), min_size=30, max_size=60))
def test_equal_hashes_mean_equal_values(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "v string").coalesce(1)
    hashes = [r.h for r in rows.select(text_hash(F.col("v")).alias("h")).collect()]
    load = json_loader()
    for a, h in zip(texts, hashes):
        for b, g in zip(texts, hashes):
            assert h != g or not unequal_paths(a, b, load), (a, b)
