"""Operators apart from the engine, and properties that hold between them."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions.json_values import comparable, equals_text, exact_comparable, number_text, strict_comparable
from lodestrata.functions.names import EngineError, ParseError, clamp, normal_name
from lodestrata.operators import indexes, overlay, placement, search, versions
from lodestrata.plans import sqlfront
from lodestrata.queries import engine_queries, store_queries
from lodestrata.sources.version_log import Store
from lodestrata.streaming import feed

LOG = "seq bigint, row_key string, row_value string, is_deleted boolean"


def triples(df):
    return {tuple(r) for r in df.select("row_key", "seq", "row_value").collect()}


def test_names_and_limits():
    assert normal_name(" Users ") == "users" and normal_name(None) == "kv"
    for bad in ("1a", "a-b", "a" * 65):
        with pytest.raises(EngineError):
            normal_name(bad)
    assert (clamp(None, 100, 1000), clamp(5000, 100, 1000), clamp(0, 100, 1000)) == (100, 1000, 1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.sampled_from("xyz"))), max_size=12), st.integers(0, 12))
def test_merges_agree(spark, writes, cut):
    log = spark.createDataFrame([(i, k, v, v is None) for i, (k, v) in enumerate(writes)], LOG)
    want = {k: (k, i, v) for i, (k, v) in enumerate(writes)}
    want = {w for w in want.values() if w[2] is not None}
    assert triples(versions.latest_state(log)) == want
    assert triples(versions.latest_state_by_window(log)) == want
    early, late = log.where(F.col("seq") < cut), log.where(F.col("seq") >= cut)
    assert triples(versions.compact(versions.compact(early), versions.compact(late), full=True)) == want
    assert triples(versions.latest_state(versions.apply_replicated(early, log.unionByName(log), cut - 1))) == want
    committed = versions.latest_state(early).select("row_key", "row_value")
    staged = late.select("row_key", "row_value", "is_deleted", F.col("seq").alias("staged_at"))
    assert {tuple(r) for r in overlay.overlay(committed, staged).collect()} == {(k, v) for k, _, v in want}


def test_sequences_have_no_gaps(spark):
    rows = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("n"))
    got = versions.assign_sequences(rows, 10, ["n"]).collect()
    assert all(r.seq == r.n + 11 for r in got) and len(got) == 1000
    assert versions.assign_sequences(rows.limit(0), 10, ["n"]).count() == 0


def test_comparable_rules(spark):
    data = ['{"a": {"b": "x"}}', '{"a": {"b": null}}', '{"a": {"b": 1.0}}', '{"a": {"b": true}}', '{"a": 1}', "[1]", "{", None, '{"a": {"b": 1e3}}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "i int, v string").coalesce(1)
    assert [r[0] for r in df.orderBy("i").select(comparable(F.col("v"), "a.b")).collect()][:8] == ["x", "null", "1.0", "true", None, None, None, None]
    strict = [r[0] for r in df.orderBy("i").select(strict_comparable("v", F.lit("a.b"))).collect()]
    assert strict == ["x", "null", "1.0", "true", None, None, None, None, "1e3"]
    assert [r[0] for r in df.orderBy("i").select(comparable(F.col("v"), "a.b")).collect()] == strict


def test_comparable_text_is_as_written(spark):
    data = {
        '{"n": 1.50}': "1.50", '{"n":1e2}': "1e2", '{"n": -0}': "-0", '{"n": 12345678901234567890.10 }': "12345678901234567890.10", '{"n": 1, "n": 2}': "2",
        '{"n": 1, "n": null}': "null", '{"n": {"a":  [1.0, "x"]}}': '{"a":  [1.0, "x"]}', '{"n": [ 1 ]}': "[ 1 ]", '{"n": "{ }"}': "{ }", '{"n": "5: 6, 7"}': "5: 6, 7",
        '{"n": 1.2.3}': None, '{"n": 01}': None, '{"n": 1} x': None, "{'n': 1}": None, '{"n": NaN}': None, '{"N": 1}': None, '{"n": "' + "y " * 50_000 + '"}': "y " * 50_000,
        '{"m": "\\\\", "n": 3}': "3", '{"m": "\\" 4, ", "n": true}': "true", '{"n": ""}': "",
    }
    df = spark.createDataFrame(list(data.items()), "v string, want string")
    for read in (exact_comparable(F.col("v"), "n"), strict_comparable("v", F.lit("n"))):
        assert [(r.v[:60], r.got) for r in df.select("v", "want", read.alias("got")).where("NOT (got <=> want)").collect()] == []
    for literal, n in (("1.50", 1), ("1.5", 0), ('{"a":  [1.0, "x"]}', 1), ('{"a":[1.0,"x"]}', 0), ("{ }", 1)):
        assert df.where(equals_text(F.col("v"), "n", literal)).count() == n, literal
    assert len({number_text(n) for n in ("1", "1.0", "1e0", "10e-1", "0.1e1")}) == 1 and number_text("-0.0") == number_text("0") and number_text("-1") != number_text("1")


def test_index_equals_scan(spark):
    rows = spark.createDataFrame([("1", '{"t":"a"}'), ("2", '{"t":null}'), ("3", "{}"), ("4", '{"t":"a"}')], "row_key string, row_value string")
    index = indexes.build_index(rows, "t")
    for value in ("a", "null", "zz"):
        by_index = {r[0] for r in indexes.lookup([index], value).select("row_key").collect()}
        assert by_index == {r[0] for r in rows.where(comparable(F.col("row_value"), "t") == value).select("row_key").collect()}


def test_index_and_postings_are_written_sorted(spark, tmp_path):
    rows = spark.createDataFrame([("1", '{"t":"b a"}'), ("2", '{"t":"a"}')], "row_key string, row_value string")
    indexes.write_index(indexes.build_index(rows, "t"), str(tmp_path / "i"))
    assert {r[0] for r in indexes.lookup([spark.read.parquet(str(tmp_path / "i"))], "a").collect()} == {"2"}
    search.write_postings(search.postings(search.field_texts(rows, ["value.t"])), str(tmp_path / "p"))
    assert [r[0] for r in search.rank(spark.read.parquet(str(tmp_path / "p")), "a b", 2, "and").collect()] == ["1"]


def test_query_clauses():
    c = search.parse_query('Title:Storage "a:b c" plain_word title:"x y"')
    assert [(x.term, x.field, x.phrase) for x in c] == [
        ("storage", "title", None), ("b", "a", 0), ("c", "a", 0), ("plain", None, None), ("word", None, None), ("x", "title", None), ("y", None, None)]
    assert search.parse_query("") == search.parse_query("...") == search.parse_query(None) == []
    assert search.field_alias("value.Profile.City") == "profile.city" and search.field_alias("value") == ""


def test_repeated_terms_and_empty_texts(spark):
    rows = spark.createDataFrame([("1", "alpha beta alpha", "t"), ("2", None, "t"), ("3", "", "t")], "doc_key string, text string, field string")
    found = search.postings(rows.select("doc_key", "field", "text"))
    assert {(r.term, r.tf, tuple(r.positions), r.len) for r in found.collect()} == {("alpha", 2, (0, 2), 3), ("beta", 1, (1,), 3)}
    one, two = (search.rank(found, q, 3).collect()[0].score for q in ("beta", "beta beta"))
    assert abs(two - 2 * one) < 1e-12 and search.rank(found, "", 3).count() == 0


def test_policies_and_planner(spark):
    assert placement.min_eligible(1000, 25) == 975 and placement.min_eligible(10, 25) == 0
    with pytest.raises(EngineError):
        placement.policy("quorum")
    tables = spark.createDataFrame([("users", "node-b"), ("orders", "gone")], "table_name string, current_leader string")
    a, b = (sorted((x.table_name, x.leader, x.members) for x in placement.plan_ownership(t, n, 2).collect()) for t, n in ((tables, ["node-a", "node-b", "node-c"]), (tables.orderBy("table_name"), ["node-c", "node-a", "node-b"])))
    assert a == b and all(len(x[2]) == 2 and x[1] in x[2] for x in a) and dict((x[0], x[1]) for x in a)["users"] in (("node-b",) if "node-b" in dict((x[0], x[2]) for x in a)["users"] else ("node-a", "node-c"))
    start = tables.select("table_name", placement.ring_start(F.col("table_name"), 3).alias("n")).collect()
    assert all(r.n == int.from_bytes(hashlib.sha256(r.table_name.encode()).digest()[:2], "little") % 3 for r in start)
    # A leader that is not among the planned members gives way, in the next term; members follow the ring.
    ring = ["n1", "n2", "n3", "n4"]
    at = int.from_bytes(hashlib.sha256(b"users").digest()[:2], "little") % 4
    planned = [ring[at], ring[(at + 1) % 4]]
    for current, want in ((ring[(at + 2) % 4], (4, planned[0])), (planned[1], (3, planned[1])), (None, (3, planned[0]))):
        one = spark.createDataFrame([("USERS", current, 3)], "table_name string, current_leader string, current_term int")
        assert [tuple(r) for r in placement.plan_ownership(one, ring, 2).collect()] == [("users", *want, planned)]


def test_parser_rejects():
    for bad in ("", "FLY", "SELECT", "SELECT * FROM", "SELECT * FROM t WHERE", "SELECT * FROM t LIMIT x", "SELECT * FROM t; SELECT", "CREATE TABLE t (a INT)", "CREATE TABLE t (a BLOB PRIMARY KEY)",
                "CREATE INDEX i ON t (other.a)", "CREATE INDEX i ON t (value) USING HASH", "SEARCH i MATCH 'a' OPERATOR XOR", "SEARCH i MATCH 'a' LIMIT 0", "BEGIN ISOLATION LEVEL SOMETIMES", "SELECT * FROM t WHERE key = 'open"):
        with pytest.raises(EngineError):
            record = sqlfront.parse(bad)
            from lodestrata.operators.relational import RelationalSchema

            RelationalSchema(record.columns)
    assert sqlfront.parse("select key from T where KEY between 'a' and 'b' and value.x = 'y' limit 5").limit == 5
    assert sqlfront.bind("a = ? AND b = '?' AND c = ?", [None, 1.5]) == "a = NULL AND b = '?' AND c = 1.5"
    with pytest.raises(ParseError):
        sqlfront.tokens_of("a > 'b'")


def test_stream_follows_the_log(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"), flush_at=2)
    state = feed.Materializer(spark, str(tmp_path / "state"))

    def catch_up():
        changes = feed.read_feed(spark, str(tmp_path / "db" / "log"), table="kv")
        state.start(changes, str(tmp_path / "checkpoint")).awaitTermination()

    store.commit([("kv", "a", "1", False), ("kv", "b", "2", False)])
    catch_up()
    store.commit([("kv", "a", "3", False), ("kv", "b", None, True)])
    catch_up()
    catch_up()
    assert triples(state.live()) == {("a", 3, "3")} and state.read().count() == 2
    state.merge(spark.createDataFrame([(1, "a", "1", False)], LOG), 98)
    assert triples(state.live()) == {("a", 3, "3")}


def test_materialised_state_is_compacted(spark, tmp_path):
    state = feed.Materializer(spark, str(tmp_path / "state"), compact_every=2)
    assert state.live().count() == 0
    for n in range(5):
        for _ in range(2):
            state.merge(spark.createDataFrame([(n, "k", str(n), False), (n, f"k{n}", "x", n % 2 == 0)], LOG), n)
    assert triples(state.live()) == {("k", 4, "4"), ("k1", 1, "x"), ("k3", 3, "x")} and state.read().count() == 6
    assert sorted(n for n in state.files.names("")) == ["base-000000000001", "base-000000000003", "batch-000000000002", "batch-000000000003", "batch-000000000004"]


def test_every_query_matches_its_sql(spark, sf_dir):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    wrong = []
    oracle = engine_queries.ORACLE | store_queries.ORACLE
    for name, run in (engine_queries.queries() | store_queries.queries()).items():
        df = run(spark, sf_dir)
        got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
        if name in oracle:
            rel = con.sql(oracle[name])
            at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
            want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
            if got != want or sorted(df.columns) != sorted(rel.columns):
                wrong.append(name)
    assert not wrong
