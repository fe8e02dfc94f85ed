"""One query per operator of the engine over the given tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import terms
from lodestrata.operators import indexes, keyed_joins, overlay, placement, relational, search, versions
from lodestrata.operators.relational import ColumnSpec, RelationalSchema
from lodestrata.plans.planner import Tables
from lodestrata.session import scratch_path
from lodestrata.sources import adapters
from lodestrata.streaming import feed

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

CUSTOMER = RelationalSchema([
    ColumnSpec("c_custkey", "bigint", True, True), ColumnSpec("c_name", "text"), ColumnSpec("c_nationkey", "int"),
    ColumnSpec("c_acctbal", "double"), ColumnSpec("c_mktsegment", "text"),
])
#: SQL of the shapes that the adapters give.
EV = "(SELECT printf('event:%08d', event_id) AS key, props AS value FROM events)"
LOG = "(SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS row_key, props AS row_value, event_type = 'error' AS is_deleted, event_type AS table_name FROM events)"
NEWEST = f"(SELECT row_key, max(seq) AS seq, arg_max(row_value, seq) AS row_value, arg_max(is_deleted, seq) AS is_deleted FROM {LOG} GROUP BY row_key)"
STATE = f"(SELECT row_key, seq, row_value FROM {NEWEST} WHERE NOT is_deleted)"
TEXTS = """(SELECT printf('doc:%08d', doc_id) AS doc_key, 'text' AS field, text FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT printf('doc:%08d', doc_id), 'source', source FROM documents WHERE source IS NOT NULL)"""
WORDS = f"(SELECT doc_key, field, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS words FROM {TEXTS})"
PLACED = f"(SELECT doc_key, field, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS pos, len(words) AS len FROM {WORDS})"
POSTINGS = f"(SELECT field, term, doc_key, count(*) AS tf, len, list(pos ORDER BY pos) AS positions FROM {PLACED} GROUP BY field, term, doc_key, len)"


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


def _ev(spark: SparkSession, d: str, **more) -> Tables:
    return Tables({"ev": adapters.event_documents(spark, d)}, **more)


def _customers(spark: SparkSession, d: str, **more) -> Tables:
    return Tables({"customer": adapters.table(spark, d, "customer").select(*[c.name for c in CUSTOMER.columns])}, {"customer": CUSTOMER}, **more)


# -- keys and ranges ---------------------------------------------------------------------------


@query(f"SELECT key, value FROM {EV} WHERE key = 'event:00000042'")
def kv_point_get(spark, d):
    return _ev(spark, d).sql("SELECT * FROM ev WHERE key = 'event:00000042'")


@query(f"SELECT count(*) AS n FROM {EV} WHERE key = 'event:none'")
def kv_point_get_missing(spark, d):
    return _ev(spark, d).sql("SELECT key FROM ev WHERE key = 'event:none'").agg(F.count("*").alias("n"))


@query(f"SELECT key, value FROM {EV} WHERE key BETWEEN 'event:00000100' AND 'event:00000150' ORDER BY key LIMIT 100")
def kv_range_between(spark, d):
    return _ev(spark, d).sql("SELECT key, value FROM ev WHERE key BETWEEN 'event:00000100' AND 'event:00000150'")


@query(f"SELECT key, value FROM {EV} WHERE key >= 'event:00000900' ORDER BY key LIMIT 25")
def kv_range_lower_only(spark, d):
    return _ev(spark, d).sql("SELECT key, value FROM ev WHERE key >= 'event:00000900' LIMIT 25")


@query(f"SELECT key, value FROM {EV} WHERE key <= 'event:00000030' ORDER BY key LIMIT 50")
def kv_range_upper_only(spark, d):
    return _ev(spark, d).sql("SELECT key, value FROM ev WHERE key <= 'event:00000030' LIMIT 50")


@query(f"SELECT key, value FROM {EV} ORDER BY key LIMIT 100")
def kv_default_limit_100(spark, d):
    return _ev(spark, d).sql("SELECT * FROM ev")


@query(f"SELECT key, value FROM {EV} ORDER BY key LIMIT 1000")
def kv_limit_clamp_1000(spark, d):
    return _ev(spark, d).sql("SELECT * FROM ev LIMIT 5000")


@query(f"SELECT key FROM {EV} ORDER BY key LIMIT 7")
def kv_key_projection(spark, d):
    return _ev(spark, d).sql("SELECT key, key FROM ev LIMIT 7")


@query("SELECT printf('event:%08d', event_id) AS row_key FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def kv_lookup_join(spark, d):
    """Many keys at once: the bulk form of point gets."""
    wanted = adapters.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    events = adapters.table(spark, d, "events").select("user_id", adapters.padded("event:", "event_id", 8).alias("row_key"))
    return events.join(wanted, "user_id", "left_semi").select("row_key")


# -- documents ---------------------------------------------------------------------------------


@query(f"SELECT key FROM {EV} WHERE value = '{{\"k\": 69}}'")
def doc_value_exact(spark, d):
    return _ev(spark, d).whole("SELECT key FROM ev WHERE value = '{\"k\": 69}'")


@query(f"SELECT key, value FROM {EV} WHERE json_extract_string(value, '$.k') = '69'")
def doc_json_eq_int(spark, d):
    return _ev(spark, d).whole("SELECT key, value FROM ev WHERE value.k = '69'")


@query(f"SELECT key, value FROM {EV} WHERE key >= 'event:00000100' AND json_extract_string(value, '$.k') = '69' ORDER BY key LIMIT 50")
def doc_json_eq_in_range(spark, d):
    return _ev(spark, d).sql("SELECT key, value FROM ev WHERE key >= 'event:00000100' AND value.k = '69' LIMIT 50")


@query(f"SELECT count(*) AS n FROM {EV} WHERE json_extract_string(value, '$.k') >= '0'")
def doc_json_fullscan_uncapped_count(spark, d):
    from lodestrata.functions.json_values import comparable

    rows = adapters.event_documents(spark, d)
    return rows.where(comparable(F.col("row_value"), "k") >= "0").agg(F.count("*").alias("n"))


_FILES = "(SELECT concat_ws('/', file_id, row_key) AS key, row_value AS value FROM kv_files)"
#: SQL for a member's comparable text: strings decoded, null as text, anything else as it is written.
_AT = "CASE WHEN json_valid(value) THEN CASE WHEN json_type(value, '{0}') = 'NULL' THEN 'null' ELSE json_extract_string(value, '{0}') END END"


def _files(spark, d) -> Tables:
    rows = adapters.table(spark, d, "kv_files")
    return Tables({"files": rows.select(F.concat_ws("/", "file_id", "row_key").alias("row_key"), "row_value"), "records": adapters.table(spark, d, "doc_rows").select("row_key", "row_value")})


@query(f"SELECT row_key AS key FROM (SELECT row_key, row_value AS value FROM doc_rows) WHERE {_AT.format('$.header.origin.city')} = 'Tellaway'")
def doc_json_nested_path(spark, d):
    return _files(spark, d).whole("SELECT key FROM records WHERE value.header.origin.city = 'Tellaway'")


@query(f"SELECT key FROM {_FILES} WHERE {_AT.format('$.carrier')} = 'null'")
def doc_json_null_literal(spark, d):
    return _files(spark, d).whole("SELECT key FROM files WHERE value.carrier = 'null'")


@query(f"SELECT count(*) AS n FROM {_FILES} WHERE {_AT.format('$.carrier.none')} = 'null'")
def doc_json_missing_path(spark, d):
    return _files(spark, d).whole("SELECT key FROM files WHERE value.carrier.none = 'null'").agg(F.count("*").alias("n"))


@query(f"SELECT key, value, coalesce(json_valid(value), false) AS valid FROM {_FILES}")
def doc_json_validity(spark, d):
    from lodestrata.functions.json_values import is_valid_json

    return _files(spark, d).state("files").select(F.col("row_key").alias("key"), F.col("row_value").alias("value"), is_valid_json(F.col("row_value")).alias("valid"))


_PRICES = "(SELECT o_orderkey, concat('{\"total\": ', printf('%.2f', o_totalprice), ', \"tag\": {\"p\":  \"', o_orderpriority, '\"}, \"n\": 0, \"n\": 1e', o_custkey % 7, '}') AS value, printf('%.2f', o_totalprice) AS total, o_orderpriority AS p, o_custkey % 7 AS e FROM orders)"


@query(f"""SELECT o_orderkey, total, '1e' || e AS n, '{{"p":  "' || p || '"}}' AS tag FROM {_PRICES}""")
def doc_text_as_written(spark, d):
    """Numbers and objects keep the spelling they are written in; the last of repeated members counts."""
    from lodestrata.functions.json_values import exact_comparable

    o = adapters.table(spark, d, "orders")
    value = F.format_string('{"total": %.2f, "tag": {"p":  "%s"}, "n": 0, "n": 1e%d}', "o_totalprice", "o_orderpriority", F.col("o_custkey") % 7)
    rows = o.select("o_orderkey", value.alias("v"))
    return rows.select("o_orderkey", *[exact_comparable(F.col("v"), m).alias(m) for m in ("total", "n", "tag")])


@query(f"SELECT o_orderkey FROM {_PRICES} WHERE e = 3")
def doc_json_eq_exponent(spark, d):
    from lodestrata.functions.json_values import equals_text

    o = adapters.table(spark, d, "orders")
    value = F.format_string('{"total": %.2f, "n": 0, "n": 1e%d}', "o_totalprice", F.col("o_custkey") % 7)
    return o.select("o_orderkey", value.alias("v")).where(equals_text(F.col("v"), "n", "1e3")).select("o_orderkey")


# -- versions ----------------------------------------------------------------------------------


@query(f"SELECT row_key, seq, row_value FROM {STATE}")
def lsm_latest_state(spark, d):
    return versions.latest_state(adapters.event_log(spark, d))


@query(f"SELECT row_key, seq, row_value FROM {STATE}")
def lsm_latest_state_window(spark, d):
    return versions.latest_state_by_window(adapters.event_log(spark, d)).select("row_key", "seq", "row_value")


@query(f"SELECT row_key, seq FROM {NEWEST} WHERE is_deleted")
def lsm_tombstone_keys(spark, d):
    return versions.tombstones(adapters.event_log(spark, d))


@query(f"""SELECT row_key, seq, row_value FROM (SELECT row_key, max(seq) AS seq, arg_max(row_value, seq) AS row_value, arg_max(is_deleted, seq) AS gone
           FROM {LOG} WHERE seq <= 700 GROUP BY row_key) WHERE NOT gone""")
def lsm_as_of_sequence(spark, d):
    return versions.latest_state(versions.as_of(adapters.event_log(spark, d), 700))


@query(f"SELECT max(seq) AS snapshot_seq, count(*) FILTER (WHERE NOT is_deleted) AS live_rows FROM {NEWEST}")
def lsm_snapshot_sequence(spark, d):
    return versions.snapshot_sequence(adapters.event_log(spark, d))


@query(f"SELECT row_key, seq, row_value FROM {STATE}")
def lsm_compaction_invariance(spark, d):
    """Two runs (late and early versions) compacted apart, then fully."""
    log = adapters.event_log(spark, d).drop("table_name")
    early, late = log.where("seq <= 500"), log.where("seq > 500")
    runs = [versions.compact(r) for r in (late, early)]
    return versions.compact(*runs, full=True).select("row_key", "seq", "row_value")


@query(f"SELECT row_key, row_value FROM {STATE} WHERE row_key >= '10' AND row_key <= '50' ORDER BY row_key LIMIT 20")
def lsm_range_on_merged(spark, d):
    state = versions.latest_state(adapters.event_log(spark, d))
    return versions.key_range(state, "10", "50", 20).select("row_key", "row_value")


@query("SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders")
def bulk_sequence_assignment(spark, d):
    orders = adapters.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return versions.assign_sequences(orders, 1000, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "seq")


@query(f"SELECT row_key, seq, row_value FROM {STATE}")
def replicated_apply_idempotent(spark, d):
    """The log after 400 arrives twice over a copy that stopped there."""
    log = adapters.event_log(spark, d)
    have, incoming = log.where("seq <= 400"), log.unionByName(log.where("seq > 300"))
    return versions.latest_state(versions.apply_replicated(have, incoming, 400))


@query("""SELECT l_orderkey, v.n AS seq, v.q AS l_quantity FROM (
            SELECT l_orderkey, max(struct_pack(n := l_linenumber, q := l_quantity)) AS v FROM lineitem GROUP BY l_orderkey)""")
def bulk_upsert_latest(spark, d):
    """Line items as successive versions of their order."""
    items = adapters.table(spark, d, "lineitem")
    newest = items.groupBy("l_orderkey").agg(F.max(F.struct("l_linenumber", "l_quantity")).alias("v"))
    return newest.select("l_orderkey", F.col("v.l_linenumber").alias("seq"), "v.l_quantity")


# -- relational --------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def rel_select_pk(spark, d):
    return _customers(spark, d).sql("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")


@query("SELECT c_name, c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def rel_select_text_eq_ci(spark, d):
    return _customers(spark, d).whole("SELECT c_name, c_custkey FROM customer WHERE c_mktsegment = 'bUiLdInG'")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 12")
def rel_select_star_limit(spark, d):
    return _customers(spark, d).sql("SELECT * FROM customer LIMIT 12")


def _deliveries(spark, d) -> Tables:
    schema = RelationalSchema([ColumnSpec("delivery_id", "bigint", True, True), ColumnSpec("operation", "text"), ColumnSpec("is_deleted", "boolean"), ColumnSpec("table_name", "text")])
    return Tables({"deliveries": adapters.table(spark, d, "change_log").select(*[c.name for c in schema.columns])}, {"deliveries": schema})


@query("SELECT delivery_id FROM change_log WHERE coalesce(table_name, '') = ''")
def rel_null_as_empty(spark, d):
    return _deliveries(spark, d).whole("SELECT delivery_id FROM deliveries WHERE table_name = ''")


@query("""SELECT CAST(delivery_id AS VARCHAR) AS delivery_id, coalesce(operation, '') AS operation,
          CASE WHEN is_deleted THEN 'True' WHEN NOT is_deleted THEN 'False' ELSE '' END AS is_deleted, coalesce(table_name, '') AS table_name FROM change_log""")
def rel_render_text(spark, d):
    return relational.render_text(_deliveries(spark, d).whole("SELECT * FROM deliveries"))


_RULES = RelationalSchema([
    ColumnSpec("row_key", "text", True, True), ColumnSpec("colour", "text", False, True), ColumnSpec("markers", "text"), ColumnSpec("temperature", "int"),
    ColumnSpec("fragile", "boolean"), ColumnSpec("weightGrams", "double"),
])


@query("""
    WITH f AS (SELECT file_id, row_key, row_value, CASE WHEN json_valid(row_value) THEN row_value END AS v FROM kv_files),
    k AS (SELECT file_id, row_key, row_value, v, [lower(x) for x in CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) END] AS names FROM f),
    u AS (SELECT *, len([x for x in names if x NOT IN ('colour', 'markers', 'temperature', 'fragile', 'weightgrams')]) AS unknown,
          json_type(v, '$.colour') AS colour, json_type(v, '$.markers') AS markers, json_type(v, '$.temperature') AS temperature, json_type(v, '$.fragile') AS fragile, json_type(v, '$.weightGrams') AS weight FROM k)
    SELECT file_id, row_key, row_value, CASE WHEN v IS NULL THEN 'bad_json' WHEN names IS NULL THEN 'not_an_object' WHEN unknown > 0 THEN 'unknown_property'
        WHEN coalesce(colour, 'NULL') = 'NULL' THEN 'null_value' WHEN colour <> 'VARCHAR' OR coalesce(markers, 'NULL') NOT IN ('NULL', 'VARCHAR')
            OR coalesce(temperature, 'NULL') NOT IN ('NULL', 'UBIGINT', 'BIGINT') OR coalesce(fragile, 'NULL') NOT IN ('NULL', 'BOOLEAN')
            OR coalesce(weight, 'NULL') NOT IN ('NULL', 'UBIGINT', 'BIGINT', 'DOUBLE') THEN 'wrong_type' END AS problem FROM u""")
def rel_validate_rows(spark, d):
    rows = adapters.table(spark, d, "kv_files").select("file_id", "row_key", "row_value")
    return relational.validate_rows(rows, _RULES)


# -- joins -------------------------------------------------------------------------------------


def _join_tables(spark, d) -> Tables:
    users = versions.latest_state(adapters.event_log(spark, d))
    cust = adapters.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("row_key"), F.col("c_name").alias("row_value"))
    return Tables({"users": users, "cust": cust, "ord": adapters.order_documents(spark, d), "ev": adapters.event_documents(spark, d)})


_CUST = "(SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer)"
_ORD = "(SELECT printf('order:%08d', o_orderkey) AS key, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status FROM orders)"


@query(f"SELECT u.row_key AS user_key, c.key AS customer_key FROM {STATE} u JOIN {_CUST} c ON u.row_key = c.key")
def join_key_key(spark, d):
    t = _join_tables(spark, d)
    return keyed_joins.join_states(t.state("users"), t.state("cust"), None, None).select(F.col("left_key").alias("user_key"), F.col("right_key").alias("customer_key"))


@query("""SELECT printf('order:%08d', o_orderkey) AS order_key, CAST(c_custkey AS VARCHAR) AS customer_key FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_json_json(spark, d):
    """Orders with their customer; both sides name it in JSON."""
    c = adapters.table(spark, d, "customer")
    customers = c.select(F.col("c_custkey").cast("string").alias("row_key"), F.to_json(F.struct(F.struct(F.col("c_custkey").alias("no")).alias("id"), "c_name")).alias("row_value"))
    found = keyed_joins.join_states(adapters.order_documents(spark, d), customers, "customerId", "id.no")
    return found.select(F.col("left_key").alias("order_key"), F.col("right_key").alias("customer_key"))


@query(f"SELECT c.key AS customer_key, o.key AS order_key FROM {_CUST} c JOIN {_ORD} o ON c.key = o.customer")
def join_key_json(spark, d):
    t = _join_tables(spark, d)
    return keyed_joins.join_states(t.state("cust"), t.state("ord"), None, "customerId").select(F.col("left_key").alias("customer_key"), F.col("right_key").alias("order_key"))


@query(f"""SELECT c.key AS "cust.key", o.key AS "ord.key" FROM {_CUST} c JOIN {_ORD} o ON c.key = o.customer ORDER BY c.key, o.key LIMIT 40""")
def join_fanout_limit(spark, d):
    return _join_tables(spark, d).sql("SELECT cust.key, ord.key FROM cust JOIN ord ON cust.key = ord.value.customerId LIMIT 40")


@query(f"""SELECT u.row_key AS "users.key", u.row_value AS "users.value", c.key AS "cust.key", c.value AS "cust.value"
           FROM {STATE} u JOIN {_CUST} c ON u.row_key = c.key""")
def join_star_projection(spark, d):
    return _join_tables(spark, d).whole("SELECT * FROM users JOIN cust ON users.key = cust.key")


@query(f"""SELECT c.key AS "cust.key", o.key AS "ord.key" FROM {_CUST} c JOIN {_ORD} o ON c.key = o.customer WHERE c.key BETWEEN '10' AND '12'""")
def join_where(spark, d):
    return _join_tables(spark, d).whole("SELECT cust.key, ord.key FROM cust JOIN ord ON cust.key = ord.value.customerId WHERE cust.key BETWEEN '10' AND '12'")


# -- indexes and views -------------------------------------------------------------------------


def _indexed(spark, d, storage: str = "BTREE"):
    """An engine with the events and a stored index on their k."""
    from lodestrata.engine import Engine

    e = Engine(spark, scratch_path(spark, "engine"), compat_caps=False)
    e.store.attach("ev", adapters.event_documents(spark, d))
    e.sql(f"CREATE INDEX by_k ON ev (value.k) USING {storage}")
    return e


@query(f"SELECT key, value FROM {EV} WHERE json_extract_string(value, '$.k') = '12'")
def index_eq_lookup(spark, d):
    return _indexed(spark, d).query("SELECT key, value FROM ev WHERE value.k = '12'")


@query(f"SELECT key FROM {EV} WHERE key <= 'event:00005000' AND json_extract_string(value, '$.k') = '12' ORDER BY key LIMIT 100")
def index_eq_lookup_in_range(spark, d):
    return _indexed(spark, d, "FASTWRITE").sql("SELECT key FROM ev WHERE key <= 'event:00005000' AND value.k = '12'").rows


@query(f"""SELECT unnest(['by_index', 'by_scan']) AS way, count(*) AS n FROM {EV} WHERE json_extract_string(value, '$.k') = '31'""")
def index_matches_scan(spark, d):
    text = "SELECT key FROM ev WHERE value.k = '31'"
    ways = {"by_index": _indexed(spark, d).query(text), "by_scan": _ev(spark, d).whole(text)}
    one, two = (rows.agg(F.count("*").alias("n")).select(F.lit(way).alias("way"), "n") for way, rows in ways.items())
    return one.unionByName(two)


@query(f"SELECT json_extract_string(value, '$.k') AS indexed_value, key AS row_key FROM {EV}")
def index_entries(spark, d):
    return _indexed(spark, d).index_entries("by_k")


@query(f"SELECT json_extract_string(value, '$.k') AS indexed_value, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM {EV} GROUP BY 1")
def index_entries_dump(spark, d):
    return indexes.index_summary(indexes.build_index(adapters.event_documents(spark, d), "k"))


_VIEWS = {
    "hot": "SELECT * FROM ev WHERE value.k = '7'", "hot_late": "SELECT key FROM hot WHERE key >= 'event:00002000'",
    "builders": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'building'",
}


def _viewed(spark, d) -> Tables:
    t = _customers(spark, d, views=_VIEWS)
    t.states["ev"] = adapters.event_documents(spark, d)
    return t


@query(f"SELECT key, value FROM {EV} WHERE json_extract_string(value, '$.k') = '7'")
def view_filter(spark, d):
    return _viewed(spark, d).whole("SELECT * FROM hot")


@query(f"SELECT key FROM {EV} WHERE json_extract_string(value, '$.k') = '7' AND key >= 'event:00002000'")
def view_over_view(spark, d):
    return _viewed(spark, d).whole("SELECT key FROM hot_late")


@query("SELECT c_name FROM customer WHERE lower(c_mktsegment) = 'building' AND c_custkey >= 100 ORDER BY CAST(c_custkey AS VARCHAR) LIMIT 20")
def view_over_relational(spark, d):
    return _viewed(spark, d).sql("SELECT c_name FROM builders WHERE c_custkey >= 100 LIMIT 20")


@query(f"SELECT key, value FROM {EV} WHERE json_extract_string(value, '$.k') = '7' ORDER BY key LIMIT 3")
def view_outer_limit(spark, d):
    return _viewed(spark, d).sql("SELECT * FROM hot LIMIT 3")


# -- full text ---------------------------------------------------------------------------------


def _bm25_sql(clauses: list[tuple], having: str = "", only: str = "", order: str = "LIMIT 20") -> str:
    """The ranking in SQL: (number, term, field or None) per clause."""
    wanted = ", ".join(f"({i}, '{t}', {repr(f) if f else 'NULL'})" for i, t, f in clauses)
    return f"""
        WITH hit AS (SELECT p.*, c.clause FROM {POSTINGS} p JOIN (VALUES {wanted}) AS c(clause, want, bound)
                     ON p.term = c.want AND (c.bound IS NULL OR p.field = c.bound)),
        f AS (SELECT clause, count(DISTINCT doc_key) AS df FROM hit GROUP BY clause),
        s AS (SELECT doc_key, clause, max(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
                     / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / 100.0::DOUBLE))) AS best
              FROM hit JOIN f USING (clause) GROUP BY doc_key, clause),
        r AS (SELECT doc_key, sum(best) AS score FROM s GROUP BY doc_key {having})
        SELECT doc_key, round(score, 6) AS score FROM r {only} ORDER BY r.score DESC, doc_key {order}"""


def _found(spark, d, text: str):
    clauses = search.parse_query(text)
    return search.postings(adapters.text_documents(spark, d), sorted({c.term for c in clauses}))


def _ranked(spark, d, text: str, operator: str = "or"):
    return search.rank(_found(spark, d, text), text, adapters.table(spark, d, "documents").count(), operator)


def _top(ranked: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return search.page(ranked, limit, offset).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_key, field, len(words) AS n, words[1] AS first, words[-1] AS last FROM {WORDS}")
def fts_tokens(spark, d):
    words = adapters.text_documents(spark, d).select("doc_key", "field", terms(F.col("text")).alias("w"))
    return words.select("doc_key", "field", F.size("w").cast("bigint").alias("n"), F.get("w", F.lit(0)).alias("first"), F.try_element_at("w", F.lit(-1)).alias("last"))


@query(f"SELECT field, term, doc_key, tf, len, positions[1] AS first_pos, CAST(list_sum(positions) AS BIGINT) AS pos_sum FROM {POSTINGS}")
def fts_postings(spark, d):
    found = search.postings(adapters.text_documents(spark, d))
    return found.select(
        "field", "term", "doc_key", F.col("tf").cast("bigint").alias("tf"), F.col("len").cast("bigint").alias("len"), F.col("positions")[0].cast("bigint").alias("first_pos"),
        F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("pos_sum"),
    )


@query(f"SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM {POSTINGS} GROUP BY field, term")
def fts_doc_freq(spark, d):
    return search.document_frequencies(search.postings(adapters.text_documents(spark, d)))


@query(f"SELECT field, avg(len(words)) AS avg_len, count(*) AS n_docs FROM {WORDS} GROUP BY field")
def fts_field_len(spark, d):
    return search.average_lengths(adapters.text_documents(spark, d))


@query(_bm25_sql([(0, "snapshot", None), (1, "parser", None)]))
def fts_or_bm25_topk(spark, d):
    return _top(_ranked(spark, d, "snapshot parser"))


@query(_bm25_sql([(0, "snapshot", None), (1, "parser", None), (2, "closest", None)], "HAVING count(*) = 3", order="LIMIT 1000"))
def fts_and_bm25(spark, d):
    return _top(_ranked(spark, d, "snapshot parser closest", "and"), 1000)


_PHRASE = f"WHERE doc_key IN (SELECT doc_key FROM {WORDS} WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' may be missing '))"


@query(_bm25_sql([(0, "may", None), (1, "be", None), (2, "missing", None), (3, "parser", None)], only=_PHRASE, order="LIMIT 1000"))
def fts_phrase(spark, d):
    return _top(_ranked(spark, d, '"may be missing" parser'), 1000)


@query(_bm25_sql([(0, "forge", None), (1, "index", None)]))
def fts_multi_field_max_sum(spark, d):
    return _top(_ranked(spark, d, "forge index"))


@query(_bm25_sql([(0, "index", "source"), (1, "parser", None)]))
def fts_field_qualified(spark, d):
    return _top(_ranked(spark, d, "source:index parser"))


@query(_bm25_sql([(0, "snapshot", None), (1, "parser", None)], order="LIMIT 10 OFFSET 15"))
def fts_offset_page(spark, d):
    return _top(_ranked(spark, d, "snapshot parser"), 10, 15)


@query(f"SELECT count(DISTINCT doc_key) AS total FROM {POSTINGS} WHERE term IN ('snapshot', 'parser')")
def fts_total_hits(spark, d):
    return _ranked(spark, d, "snapshot parser").agg(F.count("*").alias("total"))


@query(_bm25_sql([(0, "parser", None), (1, "parser", None)]))
def fts_repeated_term(spark, d):
    return _top(_ranked(spark, d, "parser parser"))


# -- transactions ------------------------------------------------------------------------------

_STAGED = [("12", "old", False, 1), ("12", '{"k": 1}', False, 2), ("13", None, True, 3), ("12x", '{"k": 2}', False, 4)]
_TX = f"(SELECT row_key, row_value FROM {STATE} WHERE row_key NOT IN ('12', '13', '12x') UNION ALL SELECT '12', '{{\"k\": 1}}' UNION ALL SELECT '12x', '{{\"k\": 2}}')"


def _overlaid(spark, d):
    staged = spark.createDataFrame(_STAGED, "row_key string, row_value string, is_deleted boolean, staged_at bigint")
    return overlay.overlay(versions.latest_state(adapters.event_log(spark, d)), staged)


@query(f"SELECT row_key, row_value FROM {_TX} WHERE row_key BETWEEN '11' AND '14' ORDER BY row_key LIMIT 5")
def tx_overlay_range(spark, d):
    return versions.key_range(_overlaid(spark, d), "11", "14", 5)


@query(f"SELECT count(*) AS n FROM {_TX} WHERE row_key = '13'")
def tx_overlay_delete(spark, d):
    return _overlaid(spark, d).where("row_key = '13'").agg(F.count("*").alias("n"))


@query(f"SELECT row_key, row_value FROM {_TX}")
def tx_commit_state(spark, d):
    """The staged writes appended to the log after its last sequence."""
    log = adapters.event_log(spark, d).drop("table_name")
    top = log.agg(F.max("seq")).first()[0]
    staged = overlay.last_writes(spark.createDataFrame(_STAGED, "row_key string, row_value string, is_deleted boolean, staged_at bigint"))
    committed = staged.select(F.lit(top + 1).alias("seq"), "row_key", "row_value", "is_deleted")
    return versions.latest_state(log.unionByName(committed)).select("row_key", "row_value")


@query("""SELECT coalesce(table_name, 'kv') AS table_name, row_key, arg_max(struct_pack(v := row_value), delivery_id).v AS row_value, arg_max(coalesce(is_deleted, false), delivery_id) AS is_deleted
          FROM change_log GROUP BY 1, 2""")
def tx_last_write_wins(spark, d):
    """The whole change log staged in order of arrival."""
    log = adapters.table(spark, d, "change_log")
    staged = log.select(F.coalesce("table_name", F.lit("kv")).alias("table_name"), "row_key", "row_value", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), F.col("delivery_id").alias("staged_at"))
    return overlay.last_writes(staged, ("table_name", "row_key"))


# -- changes and replicas ----------------------------------------------------------------------


@query(f"SELECT seq, row_key, row_value, is_deleted FROM {LOG} WHERE seq > 250 ORDER BY seq LIMIT 100")
def changes_after_sequence(spark, d):
    return versions.changes_after(adapters.event_log(spark, d), 250, 100).drop("table_name")


@query(f"SELECT seq, row_key, row_value FROM {LOG} WHERE seq > 250 AND table_name = 'click'")
def changes_for_table(spark, d):
    return versions.changes_after(adapters.event_log(spark, d), 250, table="click").select("seq", "row_key", "row_value")


def _event_feed(spark, d):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a glob, so that one file will do as well as a folder
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("row_key"), F.col("props").alias("row_value"), (F.col("event_type") == "error").alias("is_deleted")
    )


@query(f"SELECT row_key, seq, row_value FROM {STATE}")
def stream_latest_state(spark, d):
    path = scratch_path(spark, "stream")
    state = feed.Materializer(spark, f"{path}/state")
    state.start(_event_feed(spark, d), f"{path}/checkpoint").awaitTermination()
    return state.live().select("row_key", "seq", "row_value")


@query(f"SELECT count(*) AS entries, count(DISTINCT seq) AS sequences FROM {LOG}")
def stream_dedup_sequence(spark, d):
    """Every entry delivered twice, each sequence kept once."""
    path = scratch_path(spark, "stream")
    once = _event_feed(spark, d)
    twice = feed.deduplicated(once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))))
    feed.drain(twice, f"{path}/checkpoint", lambda batch, n: batch.select("seq").write.mode("overwrite").parquet(f"{path}/out/batch={n}"))
    return spark.read.parquet(f"{path}/out").agg(F.count("*").alias("entries"), F.count_distinct("seq").alias("sequences"))


@query(f"SELECT row_key, seq, row_value, is_deleted FROM {LOG}")
def stream_dedup_ranges(spark, d):
    """Every entry delivered twice, in one micro-batch and over a restart; the ranges of seen sequences keep one."""
    path = scratch_path(spark, "stream")
    twice = _event_feed(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = feed.SeenRanges(spark, f"{path}/seen", lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}"))
    once.start(twice, f"{path}/checkpoint").awaitTermination()
    once.merge(adapters.event_log(spark, d).select("seq", "row_key", "row_value", "is_deleted"), 1)
    return spark.read.parquet(f"{path}/out").select("row_key", "seq", "row_value", "is_deleted")


_REPORTS = """(SELECT s.table_name, node_id, reported_at, last_applied_seq AS applied, top AS leader
               FROM node_status s LEFT JOIN (SELECT table_name, max(seq) AS top FROM kv_leader GROUP BY 1) USING (table_name))"""


def _reports(spark, d):
    """Every report with the newest sequence of its table's leader copy; tables without a copy have none."""
    top = adapters.table(spark, d, "kv_leader").groupBy("table_name").agg(F.max("seq").alias("leader"))
    s = adapters.table(spark, d, "node_status").select("table_name", "node_id", "reported_at", F.col("last_applied_seq").alias("applied"))
    return s.join(top, "table_name", "left")


@query(f"""SELECT table_name, node_id, reported_at, CAST(CASE WHEN leader IS NOT NULL AND applied IS NOT NULL THEN greatest(0, leader - applied) END AS BIGINT) AS lag,
           CASE WHEN leader IS NULL OR applied IS NULL THEN 'unknown' WHEN leader <= applied THEN 'caught-up' ELSE 'behind' END AS status FROM {_REPORTS}""")
def replica_lag(spark, d):
    l, a = F.col("leader"), F.col("applied")
    return _reports(spark, d).select("table_name", "node_id", "reported_at", placement.lag(l, a).cast("bigint").alias("lag"), placement.lag_status(l, a).alias("status"))


@query("""SELECT table_name, node_id, CAST(greatest(0, top - last_applied_seq) AS BIGINT) AS lag FROM (
            SELECT table_name, node_id, arg_max(last_applied_seq, reported_at) AS last_applied_seq FROM node_status GROUP BY 1, 2)
          JOIN (SELECT table_name, max(seq) AS top FROM kv_leader GROUP BY 1) USING (table_name)""")
def replica_lag_of_reports(spark, d):
    from lodestrata.operators.copydiff import latest_reports

    top = adapters.table(spark, d, "kv_leader").groupBy("table_name").agg(F.max("seq").alias("top"))
    reports = latest_reports(adapters.table(spark, d, "node_status"))
    return reports.join(top, "table_name").select("table_name", "node_id", placement.lag(F.col("top"), F.col("last_applied_seq")).cast("bigint").alias("lag"))


@query("""
    WITH n AS (SELECT table_name, node_id, max(struct_pack(a := coalesce(reported_at, TIMESTAMP '0001-01-01'), b := coalesce(current_term, -1), c := coalesce(last_applied_seq, -1), d := coalesce(node_role, ''),
                      e := coalesce(enabled, false), t := current_term, s := last_applied_seq, o := node_role)) AS r FROM node_status GROUP BY 1, 2),
    l AS (SELECT table_name, max(seq) AS leader_seq FROM kv_leader GROUP BY 1)
    SELECT table_name, node_id, r.o AS node_role, r.t AS current_term, r.s AS last_applied_seq, leader_seq,
        CASE WHEN leader_seq IS NOT NULL AND r.s IS NOT NULL THEN CAST(greatest(0, leader_seq - r.s) AS BIGINT) END AS lag,
        CASE WHEN NOT r.e THEN 'disabled' WHEN leader_seq IS NULL OR r.s IS NULL THEN 'unknown' WHEN leader_seq <= r.s THEN 'caught-up' ELSE 'behind' END AS status
    FROM n LEFT JOIN l USING (table_name)""")
def cluster_monitoring(spark, d):
    top = adapters.table(spark, d, "kv_leader").groupBy("table_name").agg(F.max("seq").alias("leader_seq"))
    return placement.monitoring(adapters.table(spark, d, "node_status"), top).withColumn("lag", F.col("lag").cast("bigint"))


@query(f"SELECT table_name, node_id, reported_at, coalesce(applied >= greatest(0, leader - 25), false) AS eligible FROM {_REPORTS}")
def bounded_staleness_eligible(spark, d):
    may = placement.eligible(F.col("applied"), "bounded", F.col("leader"), F.lit(25))
    return _reports(spark, d).select("table_name", "node_id", "reported_at", may.alias("eligible"))


@query(f"SELECT table_name, node_id, reported_at, coalesce(applied >= 1500, false) AS eligible FROM {_REPORTS}")
def session_eligible(spark, d):
    return _reports(spark, d).select("table_name", "node_id", "reported_at", placement.eligible(F.col("applied"), "session", token=F.lit(1500)).alias("eligible"))


# -- catalog, placement, measures --------------------------------------------------------------


def _engine(spark, d):
    """An engine with one table per table of the change log, two attached tables and a view."""
    from lodestrata.engine import Engine

    e = Engine(spark, scratch_path(spark, "engine"))
    e.store.attach("ev", adapters.event_documents(spark, d))
    e.store.attach("customer", adapters.table(spark, d, "customer"), "relational", CUSTOMER)
    e.sql("CREATE VIEW hot AS SELECT * FROM ev WHERE value.k = '7'")
    for name in [r[0] for r in adapters.table(spark, d, "change_log").select(F.lower("table_name").alias("t")).where("t IS NOT NULL").distinct().orderBy("t").collect()]:
        e.sql(f"CREATE TABLE {name}")
    return e


_NAMED = """(SELECT DISTINCT lower(table_name) AS "table", CASE lower(table_name) WHEN 'kv' THEN 'kv' ELSE 'document' END AS kind FROM change_log WHERE table_name IS NOT NULL
             UNION SELECT 'kv', 'kv' UNION ALL SELECT 'customer', 'relational' UNION ALL SELECT 'ev', 'document' UNION ALL SELECT 'hot', 'view')"""


@query(f"""SELECT "table", kind, '' AS leader, '' AS leader_url FROM {_NAMED}""")
def show_tables(spark, d):
    return _engine(spark, d).sql("SHOW TABLES").rows


@query(f"SELECT kind, CAST(count(*) AS INTEGER) AS n FROM {_NAMED} GROUP BY kind")
def table_kinds(spark, d):
    return _engine(spark, d).tables().groupBy("kind").agg(F.count("*").cast("int").alias("n"))


@query("""
    WITH t AS (SELECT table_name, max(struct_pack(a := current_term, b := coalesce(leader_id, ''))) AS old FROM node_status GROUP BY 1),
    r AS (SELECT table_name, old, ['db-east', 'db-north', 'db-west'] AS ring, ('0x' || substr(sha256(table_name), 1, 2))::INTEGER + 256 * ('0x' || substr(sha256(table_name), 3, 2))::INTEGER AS h FROM t),
    m AS (SELECT table_name, old, [ring[h % 3 + 1], ring[(h + 1) % 3 + 1]] AS members FROM r)
    SELECT table_name, CAST(coalesce(old.a + CASE WHEN old.b <> '' AND NOT coalesce(list_contains(members, old.b), false) THEN 1 ELSE 0 END, 1) AS BIGINT) AS term,
        CASE WHEN coalesce(list_contains(members, old.b), false) THEN old.b ELSE members[1] END AS leader, array_to_string(members, ',') AS members FROM m""")
def ownership_planner(spark, d):
    tables = adapters.table(spark, d, "node_status").select("table_name", F.col("leader_id").alias("current_leader"), F.col("current_term"))
    planned = placement.plan_ownership(tables, ["db-west", "db-east", "db-north"], 2)
    return planned.withColumn("members", F.array_join("members", ","))


@query("""SELECT node_id, CAST(count(*) FILTER (WHERE node_role = 'leader') AS BIGINT) AS tables FROM (
            SELECT node_id, table_name, arg_max(node_role, reported_at) AS node_role FROM node_status GROUP BY 1, 2)
          GROUP BY 1 ORDER BY 2, 1 LIMIT 1""")
def least_loaded_node(spark, d):
    reports = adapters.table(spark, d, "node_status").groupBy("node_id", "table_name").agg(F.max_by("node_role", "reported_at").alias("node_role"))
    return placement.least_loaded(reports.where("node_role = 'leader'"), reports.select("node_id").distinct())


@query("""SELECT event_type, unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS fraction, unnest(quantile_disc(value, [0.5, 0.95, 0.99])) AS value FROM events GROUP BY event_type""")
def bench_percentiles(spark, d):
    return placement.nearest_rank(adapters.table(spark, d, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])
