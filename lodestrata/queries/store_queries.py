"""Queries that write through the engine and its store, then read: one per operation, with its SQL.

Every query opens an engine on a fresh folder of the shared directory, loads whole given tables with
bulk writes and runs the statements a user would run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.engine import Engine
from lodestrata.functions.names import EngineError
from lodestrata.operators import change_feed, relational
from lodestrata.operators.versions import latest_state
from lodestrata.session import scratch_path
from lodestrata.sources import adapters
from lodestrata.streaming import feed

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

CUST = """(SELECT CAST(c_custkey AS VARCHAR) AS key, '{"name":"' || c_name || '","segment":"' || c_mktsegment || '","home":{"nation":"' || c_nationkey || '"}}' AS value,
          c_mktsegment AS segment, c_nationkey AS nation FROM customer)"""
LOG = "(SELECT seq, lower(coalesce(table_name, 'kv')) AS table_name, row_key, CASE WHEN NOT gone THEN row_value END AS row_value, gone FROM (SELECT *, coalesce(is_deleted, lower(trim(operation)) = 'delete', false) AS gone FROM change_log))"
STATE = f"(SELECT table_name, row_key, max(seq) AS seq, arg_max(struct_pack(v := row_value), struct_pack(s := seq, v := coalesce(row_value, ''))).v AS row_value, arg_max(gone, seq) AS gone FROM {LOG} GROUP BY 1, 2)"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(QUERIES)


def opened(spark, **options) -> Engine:
    return Engine(spark, scratch_path(spark, "engine"), **options)


def again(e: Engine) -> Engine:
    """The same store opened anew, as after a restart."""
    return Engine(e.spark, e.store.files.root)


def customers(spark, d, name: str = "users", **options) -> Engine:
    """An engine with all customers as documents."""
    e = opened(spark, **options)
    e.sql(f"CREATE TABLE {name}")
    e.store.put_rows(name, adapters.customer_documents(spark, d))
    return e


def replicated(spark, d) -> Engine:
    """An engine that has applied the whole change log of a leader."""
    e = opened(spark)
    log = adapters.table(spark, d, "change_log")
    e.store.apply_replicated_rows(log.select("seq", "table_name", "row_key", "row_value", change_feed.deletes().alias("is_deleted")))
    return e


def rows(e: Engine, table: str) -> DataFrame:
    return e.store.state(table).select(F.col("row_key").alias("key"), F.col("row_value").alias("value"))


# -- documents ---------------------------------------------------------------------------------

_CHANGED = f"""SELECT key, CASE key WHEN '7' THEN '{{"name":"Bo"}}' ELSE value END AS value FROM {CUST} WHERE key <> '8'
               UNION ALL SELECT 'new''s', '{{"name": "O''Hara"}}'"""


def _change(e: Engine, table: str = "users", tx: str | None = None) -> Engine:
    e.sql(f"""INSERT INTO {table} VALUES ('new''s', '{{"name": "O''Hara"}}')""", tx)
    e.sql(f"""UPDATE {table} SET value = '{{"name":"Bo"}}' WHERE key = '7'""", tx)
    e.sql(f"DELETE FROM {table} WHERE key = '8'", tx)
    return e


@query(f"SELECT key, value FROM {CUST}")
def store_bulk_put(spark, d):
    return rows(customers(spark, d), "users")


@query(f"SELECT key, value FROM {CUST} WHERE nation <> 3 UNION ALL SELECT key, '{{}}' FROM {CUST} WHERE nation = 5")
def store_bulk_upsert_and_delete(spark, d):
    """Rows of nation 3 deleted and those of nation 5 put once more, both in bulk."""
    e = customers(spark, d)
    c = adapters.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("row_key"), "c_nationkey")
    e.store.put_rows("users", c.where("c_nationkey = 3").select("row_key", F.lit(None).cast("string").alias("row_value"), F.lit(True).alias("is_deleted")))
    e.store.put_rows("users", c.where("c_nationkey = 5").select(F.concat("row_key", F.lit("+")).alias("row_key"), F.lit("{}").alias("row_value")))
    return rows(e, "users").withColumn("key", F.regexp_replace("key", "[+]$", ""))


@query(_CHANGED)
def store_insert_update_delete(spark, d):
    return rows(_change(customers(spark, d)), "users")


@query(_CHANGED)
def store_recovered(spark, d):
    """The same read by an engine opened anew: the bulk part from the log, the rest from commit records."""
    return rows(again(_change(customers(spark, d))), "users")


@query(_CHANGED)
def store_flushed_and_compacted(spark, d):
    e = _change(customers(spark, d, flush_at=2))
    e.store.compact("users")
    return rows(again(e), "users")


@query(f"SELECT 7 AS n, (SELECT value FROM {CUST} WHERE key = '6') AS untouched, '{{\"name\":\"Bo\"}}' AS updated, CAST(NULL AS VARCHAR) AS deleted")
def store_point_gets(spark, d):
    e = _change(customers(spark, d))
    e.store.compact("users")
    return spark.createDataFrame([(7, *(e.get("users", k) for k in ("6", "7", "8")))], "n int, untouched string, updated string, deleted string")


@query(f"""SELECT key, value FROM ({_CHANGED}) WHERE key BETWEEN '6' AND '9' ORDER BY key LIMIT 50""")
def store_range_with_buffered_writes(spark, d):
    return _change(customers(spark, d)).range("users", "6", "9", 50)


@query("SELECT 'document' AS target, 1 AS refused, (SELECT count(*) FROM customer) AS rows_left UNION ALL SELECT 'relational', 1, 0")
def store_refuses_broken_bulks(spark, d):
    """One bad row among all customers refuses the whole commit."""
    e = customers(spark, d)
    e.sql("CREATE RELATIONAL TABLE people (id INT PRIMARY KEY, name TEXT NOT NULL, segment TEXT)")
    bad = adapters.customer_documents(spark, d)
    out = []
    for kind, table, broken in (("document", "users", bad.withColumn("row_value", F.when(F.col("row_key") == "77", "{").otherwise(F.col("row_value")))), ("relational", "people", bad)):
        try:
            e.store.put_rows(table, broken)
            out.append((kind, 0, e.store.state(table).count()))
        except EngineError:
            out.append((kind, 1, e.store.state(table).count()))
    return spark.createDataFrame(out, "target string, refused int, rows_left bigint")


# -- relational tables -------------------------------------------------------------------------

_TYPED = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer"


def _relational(spark, d) -> Engine:
    e = opened(spark)
    e.sql("CREATE RELATIONAL TABLE customer (c_custkey BIGINT PRIMARY KEY, c_name VARCHAR(40) NOT NULL, c_acctbal DOUBLE, c_mktsegment TEXT)")
    c = adapters.table(spark, d, "customer")
    # The names are spelled in capitals, as some clients do; typed reads find them all the same.
    value = F.to_json(F.struct(F.col("c_name").alias("C_NAME"), "c_acctbal", "c_mktsegment"))
    e.store.put_rows("customer", c.select(F.col("c_custkey").cast("string").alias("row_key"), value.alias("row_value")))
    return e


@query(_TYPED)
def rel_bulk_put(spark, d):
    return _relational(spark, d).query("SELECT * FROM customer")


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def rel_update_by_pk(spark, d):
    e = _relational(spark, d)
    e.sql("UPDATE customer SET c_mktsegment = 'MOVED' WHERE c_custkey = 7")
    return e.query("SELECT c_custkey, c_mktsegment FROM customer")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey <> 7")
def rel_delete_by_pk(spark, d):
    e = _relational(spark, d)
    e.sql("DELETE FROM customer WHERE c_custkey = 7")
    return e.query("SELECT c_custkey, c_name FROM customer")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey <> 3 UNION ALL SELECT 3, 'replaced' UNION ALL SELECT 999999999, 'new'")
def rel_insert_upsert(spark, d):
    e = _relational(spark, d)
    insert = e.prepare("INSERT INTO customer (c_custkey, c_name) VALUES (?, ?)")
    for row in ((3, "replaced"), (999999999, "new")):
        insert.execute(row)
    return e.query("SELECT c_custkey, c_name FROM customer")


@query("SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE lower(c_mktsegment) = 'building'")
def rel_physical_columns(spark, d):
    """A relational table read by key and JSON value."""
    return _relational(spark, d).query("SELECT key FROM customer WHERE value.c_mktsegment = 'BUILDING'")


@query("SELECT c_name FROM customer WHERE lower(c_mktsegment) = 'building' AND c_custkey >= 100")
def rel_view_on_store(spark, d):
    e = _relational(spark, d)
    e.sql("CREATE VIEW builders AS SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'building'")
    return again(e).query("SELECT c_name FROM builders WHERE c_custkey >= 100")


_RULES = "SELECT * FROM (VALUES ('bad_key', 1), ('missing', 1), ('null', 1), ('wrong_type', 1), ('unknown', 1), ('update_key', 1), ('fine', 0)) AS t(rule, refused)"


@query(_RULES)
def rel_row_rules(spark, d):
    e = _relational(spark, d)
    tries = {
        "bad_key": "INSERT INTO customer (c_custkey, c_name) VALUES ('x', 'a')", "missing": "INSERT INTO customer (c_custkey, c_acctbal) VALUES (1, 2.0)",
        "null": "UPDATE customer SET c_name = NULL WHERE c_custkey = 1", "wrong_type": "INSERT INTO customer (c_custkey, c_name) VALUES (1, 5)",
        "unknown": "INSERT INTO customer (c_custkey, c_name, nick) VALUES (1, 'a', 'b')", "update_key": "UPDATE customer SET c_custkey = 5 WHERE c_custkey = 1",
        "fine": "INSERT INTO customer (c_custkey, c_name, c_acctbal) VALUES (1, 'a', 1.5)",
    }
    out = []
    for rule, text in tries.items():
        try:
            e.sql(text)
            out.append((rule, 0))
        except EngineError:
            out.append((rule, 1))
    return spark.createDataFrame(out, "rule string, refused int")


# -- transactions ------------------------------------------------------------------------------


@query(_CHANGED)
def tx_commit(spark, d):
    e = customers(spark, d)
    tx = e.begin()
    _change(e, tx=tx)
    e.commit(tx)
    return rows(again(e), "users")


@query(f"SELECT key, value FROM {CUST}")
def tx_rollback(spark, d):
    e = customers(spark, d)
    tx = e.begin()
    _change(e, tx=tx)
    e.rollback(tx)
    return rows(e, "users")


@query(f"SELECT 'inside' AS seen_by, count(*) AS n FROM ({_CHANGED}) WHERE value LIKE '%name%' UNION ALL SELECT 'outside', count(*) FROM {CUST}")
def tx_isolated_view(spark, d):
    """A transaction's own writes seen by it alone."""
    e = customers(spark, d)
    tx = e.begin()
    _change(e, tx=tx)
    seen = {"inside": e.query("SELECT key FROM users", tx), "outside": e.query("SELECT key FROM users")}
    one, two = (r.agg(F.count("*").alias("n")).select(F.lit(who).alias("seen_by"), "n") for who, r in seen.items())
    return one.unionByName(two)


@query(f"SELECT key, value FROM {CUST}")
def tx_repeatable_read(spark, d):
    """What a transaction has read once it reads again, whatever others commit."""
    e = customers(spark, d)
    tx = e.begin("REPEATABLE READ")
    e.get("users", "1", tx)
    _change(e)
    e.store.flush()
    return e.query("SELECT key, value FROM users", tx)


@query(f"""SELECT 'users' AS place, key FROM ({_CHANGED}) WHERE key IN ('7', '8', 'new''s') UNION ALL SELECT 'kv', 'mark'""")
def tx_over_tables(spark, d):
    """One commit over two tables."""
    e = customers(spark, d)
    tx = e.begin()
    _change(e, tx=tx)
    e.put("kv", "mark", "x", tx)
    e.commit(tx)
    found = rows(e, "users").where(F.col("key").isin("7", "8", "new's")).select(F.lit("users").alias("place"), "key")
    return found.unionByName(rows(e, "kv").select(F.lit("kv").alias("place"), "key"))


@query(_CHANGED)
def tx_two_phase(spark, d):
    """A prepared transaction is committed by an engine that is opened after a crash in the second phase; another is aborted."""
    e = customers(spark, d)
    one, two = e.begin(), e.begin()
    _change(e, tx=one)
    e.put("users", "lost", "{}", two)
    e.prepare_commit(one)
    e.prepare_commit(two)
    e.abort_prepared(two)
    e.store.files.create(f"journal/{one}.committing", "")
    e.put("kv", "between", "x")
    after = again(e)
    after.commit_prepared(one)
    return rows(after, "users")


@query("SELECT * FROM (VALUES ('aborted', 1), ('committed', 1), ('prepared', 1)) AS t(state, n)")
def tx_prepared_states(spark, d):
    e = customers(spark, d)
    for finish in (e.commit_prepared, e.abort_prepared, lambda tx: None):
        tx = e.begin()
        e.put("users", "k", "{}", tx)
        e.prepare_commit(tx)
        finish(tx)
    return again(e).prepared_transactions().groupBy("state").agg(F.count("*").cast("int").alias("n"))


# -- indexes and search ------------------------------------------------------------------------

_BY_SEGMENT = f"SELECT key FROM ({_CHANGED}) WHERE json_extract_string(value, '$.segment') = 'BUILDING'"


@query(_BY_SEGMENT)
def index_btree_after_changes(spark, d):
    e = customers(spark, d)
    e.sql("CREATE INDEX by_segment ON users (value.segment)")
    return _change(e).query("SELECT key FROM users WHERE value.segment = 'BUILDING'")


@query(_BY_SEGMENT)
def index_fastwrite_after_changes(spark, d):
    """Changes flushed into runs of their own, the rest still in commit records, read after a restart."""
    e = customers(spark, d, flush_at=2)
    e.sql("CREATE INDEX by_segment ON users (value.segment) USING FASTWRITE")
    return again(_change(e)).query("SELECT key FROM users WHERE value.segment = 'BUILDING'")


@query(f"SELECT json_extract_string(value, '$.home.nation') AS indexed_value, key AS row_key FROM ({_CHANGED}) WHERE json_extract_string(value, '$.home.nation') IS NOT NULL")
def index_entries_after_changes(spark, d):
    e = customers(spark, d, flush_at=2)
    e.sql("CREATE INDEX by_nation ON users (value.home.nation)")
    return _change(e).index_entries("by_nation")


@query("SELECT 0 AS indexes, 0 AS rows")
def index_dropped_with_table(spark, d):
    """Dropping a table drops its indexes; created anew it is empty."""
    e = customers(spark, d)
    e.sql("CREATE INDEX by_segment ON users (value.segment)")
    e.sql("CREATE SEARCH INDEX words ON users (value.name)")
    e.sql("DROP TABLE users")
    e.sql("CREATE TABLE users")
    return e.query("SELECT key FROM users").agg(F.count("*").cast("int").alias("rows")).select(F.lit(e.index_list().count()).cast("int").alias("indexes"), "rows")


_WORDS = """(SELECT doc_key, field, words, len(words) AS len FROM (
    SELECT printf('doc:%08d', doc_id) AS doc_key, unnest(['text', 'source']) AS field, unnest([regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+')]) AS words
    FROM documents) WHERE words IS NOT NULL)"""


def _search_sql(clauses: list[str], limit: str, only: str = "true") -> str:
    """BM25 over the documents without the two that are changed; each clause is a term."""
    wanted = ", ".join(f"({i}, '{t}')" for i, t in enumerate(clauses))
    return f"""
        WITH w AS MATERIALIZED (SELECT * FROM {_WORDS} WHERE doc_key <> 'doc:00000001' UNION ALL SELECT 'doc:extra', 'text', ['snapshot', 'parser', 'snapshot'], 3),
        hit AS (SELECT doc_key, field, clause, len, len([x for x in words if x = want]) AS tf FROM w, (VALUES {wanted}) AS c(clause, want)),
        h AS (SELECT * FROM hit WHERE tf > 0),
        f AS (SELECT clause, count(DISTINCT doc_key) AS df FROM h GROUP BY 1),
        s AS (SELECT doc_key, clause, max(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
              / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / 100.0::DOUBLE))) AS best FROM h JOIN f USING (clause) GROUP BY 1, 2)
        SELECT doc_key AS key, round(sum(best), 6) AS score FROM s WHERE {only} GROUP BY 1 ORDER BY sum(best) DESC, 1 {limit}"""


def _searchable(spark, d, **options) -> Engine:
    """All documents with a stored search index, then one put and one deleted."""
    e = opened(spark, **options)
    e.sql("CREATE TABLE docs")
    doc = adapters.table(spark, d, "documents")
    e.store.put_rows("docs", doc.select(adapters.padded("doc:", "doc_id", 8).alias("row_key"), F.to_json(F.struct("text", "source")).alias("row_value")))
    e.sql("CREATE SEARCH INDEX words ON docs (value.text, value.source)")
    e.sql("INSERT INTO docs VALUES ('doc:extra', '{\"text\": \"snapshot parser; SNAPSHOT\"}')")
    e.sql("DELETE FROM docs WHERE key = 'doc:00000001'")
    return e


def _scored(hits: DataFrame) -> DataFrame:
    return hits.select("key", F.round("score", 6).alias("score"))


@query(_search_sql(["snapshot", "parser"], "LIMIT 20"))
def search_after_changes(spark, d):
    return _scored(_searchable(spark, d).sql("SEARCH words MATCH 'snapshot parser'").rows)


@query(_search_sql(["snapshot", "parser"], "LIMIT 30"))
def search_runs_after_restart(spark, d):
    return _scored(again(_searchable(spark, d, flush_at=2)).sql("SEARCH words MATCH 'snapshot parser' LIMIT 30").rows)


@query(_search_sql(["may", "be", "missing"], "LIMIT 1000", "doc_key IN (SELECT doc_key FROM w WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' may be missing '))"))
def search_phrase_stored(spark, d):
    return _scored(_searchable(spark, d).sql("SEARCH words MATCH '\"may be missing\"' LIMIT 1000").rows)


# -- changes and replicas ----------------------------------------------------------------------


@query(f"SELECT table_name, row_key, row_value, seq FROM {STATE} WHERE NOT gone")
def store_replicated_state(spark, d):
    """A leader's change log (repeated and out of order) applied with its sequences; read table by table."""
    e = replicated(spark, d)
    parts = [latest_state(e.store.versions_of(name)).select(F.lit(name).alias("table_name"), "row_key", "row_value", "seq") for name in e.list_tables()]
    return reduce(DataFrame.unionByName, parts)


@query(f"SELECT DISTINCT seq, table_name, row_key, gone AS is_deleted FROM {LOG} WHERE seq > 100 AND table_name = 'carts'")
def store_changes_of_table(spark, d):
    e = replicated(spark, d)
    found = e.store.log(100).where("table_name = 'carts'")
    return found.select("seq", "table_name", "row_key", "is_deleted")


@query(f"SELECT DISTINCT seq, CASE WHEN gone THEN 'delete' ELSE 'put' END AS operation FROM {LOG} WHERE seq > 50 ORDER BY seq LIMIT 100")
def store_changes_default_100(spark, d):
    return replicated(spark, d).changes(50).select("seq", "operation")


@query(f"SELECT row_key, row_value, seq FROM {STATE} WHERE NOT gone AND table_name = 'carts'")
def store_bootstrapped_follower(spark, d):
    """Snapshot and feed from one sequence: a follower that starts from the first and follows the second."""
    e = replicated(spark, d)
    path = scratch_path(spark, "follower")
    at, live, tail = e.bootstrap("carts")
    state = feed.Materializer(spark, path)
    state.seed(latest_state(e.store.versions_of("carts", at)))
    state.start(tail, f"{path}-checkpoint").awaitTermination()
    return state.live().select("row_key", "row_value", "seq")


@query("SELECT 'bounded' AS policy, 1 AS served UNION ALL SELECT 'eventual', 1 UNION ALL SELECT 'session', 1 UNION ALL SELECT 'strong', 0")
def store_read_policies(spark, d):
    """A replica ten sequences behind, asked under each policy."""
    e = customers(spark, d)
    behind = e.store.sequence - 10
    out = []
    for name, options in (("eventual", {}), ("session", {"after": behind}), ("bounded", {"max_lag": 10}), ("strong", {})):
        try:
            e.read("users", name, applied=behind, **options)
            out.append((name, 1))
        except EngineError:
            out.append((name, 0))
    return spark.createDataFrame(out, "policy string, served int")


@query(f"""SELECT key AS "users.key", printf('order:%08d', o_orderkey) AS "orders.key" FROM ({_CHANGED}) c JOIN orders ON c.key = CAST(o_custkey AS VARCHAR)""")
def store_join(spark, d):
    e = _change(customers(spark, d))
    e.sql("CREATE TABLE orders")
    e.store.put_rows("orders", adapters.order_documents(spark, d))
    return e.query("SELECT users.key, orders.key FROM users JOIN orders ON users.key = orders.value.customerId")


@query("SELECT 'store.last_sequence' AS name, (SELECT count(*) FROM customer) + 3 AS value UNION ALL SELECT 'statements.insert', 1 UNION ALL SELECT 'statements.delete', 1 UNION ALL SELECT 'failed_statements', 1")
def store_metrics(spark, d):
    e = _change(customers(spark, d))
    try:
        e.sql("FLY")
    except EngineError:
        pass
    wanted = ["store.last_sequence", "statements.insert", "statements.delete", "failed_statements"]
    return e.metrics().where(F.col("name").isin(wanted))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, '' AS segment FROM customer WHERE c_custkey <= 3""")
def store_wire_texts(spark, d):
    """Rows as the wire shows them."""
    e = opened(spark)
    e.sql("CREATE RELATIONAL TABLE people (id INT PRIMARY KEY, name TEXT, segment TEXT)")
    c = adapters.table(spark, d, "customer")
    e.store.put_rows("people", c.select(F.col("c_custkey").cast("string").alias("row_key"), F.to_json(F.struct(F.col("c_name").alias("name"))).alias("row_value")))
    return relational.render_text(e.query("SELECT * FROM people WHERE id <= 3"))
