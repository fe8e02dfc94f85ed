"""The queries of the general data problems over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import change_feed, copydiff, drift, exactly_once, incremental, nested, snapshots
from lodestrata.session import scratch_path

#: The arrays of each nested table.
NESTED = {
    "voyages": ["legs", "legs.calls", "legs.calls.fees", "legs.cargo.items", "crew", "crew.papers"],
    "dossiers": ["parties", "parties.contacts", "filings", "filings.exhibits", "filings.exhibits.pages"],
    "harvests": ["field.plots", "field.plots.samples", "field.plots.samples.readings", "alerts"],
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _registry(spark: SparkSession, sf_dir: str) -> tuple[drift.SchemaRegistry, DataFrame]:
    rows = _table(spark, sf_dir, "kv_files")
    registry = drift.SchemaRegistry(spark, scratch_path(spark, "registry"))
    registry.add(rows)
    return registry, rows


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir)[0].steps()


def p1_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _registry(spark, sf_dir)[0].versions()
    return versions.select("table_name", "version", "fingerprint", "files", "first_file_id", F.size("fields").alias("n_fields"))


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row and field, so that SQL can compare them."""
    registry, rows = _registry(spark, sf_dir)
    found = drift.consistent_rows(rows, registry)
    return found.select("table_name", "file_id", "row_key", F.inline("fields"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.all_nodes(_table(spark, sf_dir, "doc_rows"), NESTED)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "change_log")
    entries = log.where(F.col("seq").isNotNull()).groupBy("seq").agg(F.min_by("committed_at", "delivery_id").alias("committed_at"))
    return incremental.unprocessed_entries(entries, _table(spark, sf_dir, "run_log"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leader, follower, status = (_table(spark, sf_dir, n) for n in ("kv_leader", "kv_follower", "node_status"))
    return copydiff.compare_copies(leader, follower, status)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    inserts, removed = change_feed.split_changes(_table(spark, sf_dir, "change_log"))
    return change_feed.read_live(inserts, removed, values=False)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(_table(spark, sf_dir, "table_snapshots")).drop("changed_paths")


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from snapshots that are kept range by range, added in two commits."""
    rows = _table(spark, sf_dir, "table_snapshots")
    store = snapshots.SnapshotStore(spark, scratch_path(spark, "snapshots"), ranges=16)
    middle = rows.agg(F.percentile_approx("snapshot_seq", 0.5)).first()[0]
    for part in (rows.where(F.col("snapshot_seq") <= middle), rows.where(F.col("snapshot_seq") > middle)):
        store.add(part)
    return store.changes().drop("changed_paths")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "change_log")
    return exactly_once.screen_batches(log.select("delivery_id", "seq")).where("late").select("seq", "delivery_id")


def queries() -> dict:
    return {f.__name__: f for f in (
        p1_found, p1_versions, p1_consistent, p2_found, p3_found, p4_found, p5_found, p6_found, p6_kept, p7_found,
    )}


#: SQL over a relation ``{t}`` with a column ``v`` and identifying columns ``{k}``: its leaf fields,
#: one spelling per value. A value that is no JSON object has no rows.
_LEAVES = """
    SELECT {k}, substr(j.fullkey, 3) AS path, j.type AS kind, CASE
        WHEN j.type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN 'n' || CAST(CAST(j.atom AS DOUBLE) AS VARCHAR)
        WHEN j.type = 'VARCHAR' THEN 's' || CAST(j.atom ->> '$' AS VARCHAR) ELSE 'j' || CAST(j.value AS VARCHAR) END AS leaf
    FROM {t}, json_tree(CASE WHEN json_valid(v) THEN CASE WHEN json_type(v) = 'OBJECT' THEN v END END) AS j
    WHERE j.type <> 'OBJECT' AND NOT contains(j.path, '[') AND NOT ends_with(j.fullkey, ']')"""
_OBJECT = "(json_valid({v}) AND json_type(CASE WHEN json_valid({v}) THEN {v} END) = 'OBJECT')"



def _held(text: str) -> str:
    """SQL: the text of a JSON value, or what a string holds if that is JSON."""
    return f"CASE WHEN json_type({text}) = 'VARCHAR' AND json_valid({text} ->> '$') THEN {text} ->> '$' ELSE CAST({text} AS VARCHAR) END"


def _nested_sql() -> str:
    """The arrays of ``NESTED`` walked level by level."""
    spec = []
    for table, arrays in NESTED.items():
        for path in arrays:
            above = max((a for a in arrays if path.startswith(a + ".")), key=len, default="")
            steps = path[len(above) + 1 :].split(".") if above else path.split(".")
            through = steps[0] if len(steps) == 2 else ""
            spec.append(f"('{table}', '{path}', '{above}', '{'.'.join(steps)}', '{through}', '{steps[-1]}')")
    return f"""
        WITH RECURSIVE spec(table_name, arr, above, label, through, leaf) AS (VALUES {", ".join(spec)}),
        walk(table_name, row_key, arr, parent_path, node_path, obj) AS (
            SELECT table_name, row_key, '', '', '', {_held("row_value")} FROM doc_rows WHERE json_valid(row_value)
            UNION ALL
            SELECT table_name, row_key, arr, at_path, at_path || CASE WHEN at_path = '' THEN '' ELSE '.' END || label || '[' || i || ']', obj FROM (
                SELECT table_name, row_key, arr, at_path, label, i, {_held("e")} AS obj FROM (
                    SELECT table_name, row_key, arr, at_path, label, unnest(list) AS e, generate_subscripts(list, 1) - 1 AS i FROM (
                        SELECT *, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') WHEN 'OBJECT' THEN [json_extract(v, '$')] ELSE [] END AS list FROM (
                            SELECT table_name, row_key, arr, at_path, label, {_held("x")} AS v FROM (
                                SELECT table_name, row_key, arr, at_path, label, json_extract(inner_, '$.' || leaf) AS x FROM (
                                    SELECT w.table_name, w.row_key, s.arr, w.node_path AS at_path, s.label, s.leaf,
                                        CASE WHEN s.through = '' THEN w.obj ELSE {_held("json_extract(w.obj, '$.' || s.through)")} END AS inner_
                                    FROM walk w JOIN spec s ON s.table_name = w.table_name AND s.above = w.arr WHERE json_type(w.obj) = 'OBJECT')
                                WHERE json_type(inner_) = 'OBJECT'))))
                WHERE e IS NOT NULL)
            WHERE json_type(obj) = 'OBJECT')
        SELECT DISTINCT table_name, row_key, parent_path, node_path FROM walk WHERE node_path <> ''"""


#: Files in order, their leaves, fields and what started, ended and was renamed; for problem 1.
_DRIFT = f"""
    rows AS (SELECT DISTINCT table_name, file_id, row_key, row_value AS v FROM kv_files),
    every AS (SELECT table_name, file_id, row_key, row_value AS v FROM kv_files),
    leaves AS MATERIALIZED ({_LEAVES.format(k="table_name, file_id, row_key", t="every")}),
    files AS (SELECT *, lag(file_id) OVER w AS before, row_number() OVER w AS n
              FROM (SELECT table_name, file_id, min(written_at) AS written FROM kv_files GROUP BY ALL) WINDOW w AS (PARTITION BY table_name ORDER BY written, file_id)),
    counts AS (SELECT table_name, file_id, path, CASE kind WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array'
               WHEN 'DOUBLE' THEN 'double' WHEN 'NULL' THEN NULL ELSE 'integer' END AS kind, count(*) AS n FROM leaves GROUP BY ALL),
    fields AS MATERIALIZED (SELECT table_name, file_id, path, arg_max(kind, struct_pack(n := n, k := kind)) FILTER (WHERE kind IS NOT NULL) AS kind
               FROM counts GROUP BY ALL),
    started AS (SELECT f.table_name, f.file_id, f.path FROM fields f JOIN files USING (table_name, file_id) WHERE before IS NOT NULL
                AND NOT EXISTS (SELECT 1 FROM fields o WHERE o.table_name = f.table_name AND o.file_id = before AND o.path = f.path)),
    ended AS (SELECT files.table_name, files.file_id, o.path FROM files JOIN fields o ON o.table_name = files.table_name AND o.file_id = before
              WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.table_name = files.table_name AND f.file_id = files.file_id AND f.path = o.path)),
    held AS MATERIALIZED (SELECT table_name, file_id, row_key, path, min(leaf) AS leaf, any_value(kind) AS kind FROM leaves WHERE kind <> 'NULL' GROUP BY ALL),
    renamed AS MATERIALIZED (SELECT s.table_name, s.file_id, s.path, e.path AS old_path FROM started s JOIN ended e USING (table_name, file_id) JOIN files USING (table_name, file_id)
                JOIN held a ON a.table_name = s.table_name AND a.file_id = before AND a.path = e.path
                JOIN held b ON b.table_name = s.table_name AND b.file_id = s.file_id AND b.path = s.path AND b.row_key = a.row_key
                GROUP BY ALL HAVING count(*) FILTER (WHERE a.leaf = b.leaf) * 2 > count(*)),
    prints AS MATERIALIZED (SELECT f.table_name, f.file_id, f.written, f.n, count(path) AS n_fields, sha256('[' || coalesce(string_agg(
                '{{"path":"' || path || '"' || CASE WHEN kind IS NULL THEN '' ELSE ',"type":"' || kind || '"' END || '}}', ',' ORDER BY path), '') || ']') AS fingerprint
               FROM files f LEFT JOIN fields USING (table_name, file_id) GROUP BY ALL)"""
_CAST = """CASE field_type WHEN 'integer' THEN CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN CAST(TRY_CAST(raw AS BIGINT) AS VARCHAR) END
    WHEN 'double' THEN CASE WHEN regexp_full_match(trim(raw), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(TRY_CAST(raw AS DOUBLE) AS VARCHAR) END
    WHEN 'boolean' THEN CASE WHEN lower(trim(raw)) IN ('t', 'true', 'y', 'yes', '1') THEN 'true' WHEN lower(trim(raw)) IN ('f', 'false', 'n', 'no', '0') THEN 'false' END ELSE raw END"""

ORACLE = {
    "p2_found": _nested_sql(),
    "p1_versions": f"""
        WITH {_DRIFT},
        v AS (SELECT table_name, fingerprint, min(struct_pack(w := written, f := file_id)) AS first, count(*) AS files, any_value(n_fields) AS n_fields FROM prints GROUP BY 1, 2)
        SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY first) AS INTEGER) AS version, fingerprint, files, first.f AS first_file_id, CAST(n_fields AS INTEGER) AS n_fields FROM v""",
    "p1_consistent": f"""
        WITH RECURSIVE {_DRIFT},
        changes AS (SELECT *, CASE WHEN fingerprint IS DISTINCT FROM lag(fingerprint) OVER (PARTITION BY table_name ORDER BY n) THEN 1 ELSE 0 END AS starts FROM prints),
        segs AS MATERIALIZED (SELECT table_name, file_id, starts, sum(starts) OVER (PARTITION BY table_name ORDER BY n) AS seg FROM changes),
        here AS (SELECT s.table_name, s.seg, f.path, f.kind, s.seg - row_number() OVER (PARTITION BY s.table_name, f.path ORDER BY s.seg) AS island
                 FROM segs s JOIN fields f USING (table_name, file_id) WHERE starts = 1),
        islands AS MATERIALIZED (SELECT table_name, path, min(seg) AS first, max(seg) AS last FROM here GROUP BY table_name, path, island),
        links AS MATERIALIZED (SELECT o.table_name, o.path, o.first, w.path AS next, w.first AS next_first FROM renamed r JOIN segs s USING (table_name, file_id)
                  JOIN islands o ON o.table_name = r.table_name AND o.path = r.old_path AND o.last = s.seg - 1 JOIN islands w ON w.table_name = r.table_name AND w.path = r.path AND w.first = s.seg),
        chain(table_name, path, first, last, target, since) AS (
            SELECT table_name, path, first, last, path, first FROM islands
            UNION ALL SELECT c.table_name, c.path, c.first, c.last, l.next, l.next_first FROM chain c JOIN links l ON l.table_name = c.table_name AND l.path = c.target AND l.first = c.since),
        lineage AS MATERIALIZED (SELECT c.* FROM chain c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.table_name = c.table_name AND l.path = c.target AND l.first = c.since)),
        typed AS MATERIALIZED (SELECT l.table_name, l.target, l.since, arg_max(h.kind, h.seg) FILTER (WHERE h.kind IS NOT NULL) AS field_type
                  FROM lineage l JOIN here h ON h.table_name = l.table_name AND h.path = l.path AND h.seg BETWEEN l.first AND l.last GROUP BY ALL),
        numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS r FROM rows),
        plain AS MATERIALIZED (SELECT r, substr(j.fullkey, 3) AS path, CASE j.type WHEN 'VARCHAR' THEN j.atom ->> '$' WHEN 'NULL' THEN NULL ELSE CAST(j.value AS VARCHAR) END AS raw
                  FROM numbered, json_tree(CASE WHEN json_valid(v) THEN CASE WHEN json_type(v) = 'OBJECT' THEN v END END) AS j
                  WHERE j.type <> 'OBJECT' AND NOT contains(j.path, '[') AND NOT ends_with(j.fullkey, ']')),
        wide AS (SELECT n.r, n.table_name, n.file_id, n.row_key, t.target AS field_path, t.since, t.field_type, p.raw
                 FROM numbered n JOIN segs s USING (table_name, file_id) JOIN typed t ON t.table_name = n.table_name
                 LEFT JOIN lineage l ON l.table_name = n.table_name AND l.target = t.target AND l.since = t.since AND s.seg BETWEEN l.first AND l.last
                 LEFT JOIN plain p ON p.r = n.r AND p.path = l.path)
        SELECT table_name, file_id, row_key, field_path, CAST(since AS BIGINT) AS since, field_type, coalesce({_CAST}, raw) AS value, raw IS NOT NULL AND ({_CAST}) IS NULL AS cast_failed FROM wide""",
    "p1_found": f"""
        WITH {_DRIFT}
        SELECT table_name, file_id, 'renamed' AS change_kind, path AS field_path, old_path FROM renamed
        UNION ALL SELECT table_name, file_id, 'added', path, '' FROM started s
            WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.table_name = s.table_name AND r.file_id = s.file_id AND r.path = s.path)
        UNION ALL SELECT table_name, file_id, 'removed', path, '' FROM ended e
            WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.table_name = e.table_name AND r.file_id = e.file_id AND r.old_path = e.path)
        UNION ALL SELECT f.table_name, f.file_id, 'retyped', f.path, '' FROM fields f JOIN files USING (table_name, file_id)
            JOIN fields o ON o.table_name = f.table_name AND o.file_id = before AND o.path = f.path WHERE o.kind <> f.kind""",
    "p4_found": f"""
        WITH l AS (SELECT table_name, row_key, max(seq) AS seq, arg_max(row_value, seq) AS v, arg_max(coalesce(is_deleted, false), seq) AS gone FROM kv_leader GROUP BY 1, 2),
        f AS (SELECT table_name, row_key, arg_max(row_value, seq) AS v, arg_max(coalesce(is_deleted, false), seq) AS gone FROM kv_follower GROUP BY 1, 2),
        applied AS (SELECT n.table_name, arg_max(last_applied_seq, reported_at) AS upto FROM node_status n
                    JOIN (SELECT table_name, max(node_id) AS node_id FROM kv_follower GROUP BY 1) USING (table_name, node_id) GROUP BY 1),
        both_ AS MATERIALIZED (SELECT table_name, row_key, l.v AS lv, f.v AS fv, coalesce(NOT l.gone, false) AS here, coalesce(NOT f.gone, false) AS there
                  FROM l FULL JOIN f USING (table_name, row_key) LEFT JOIN applied USING (table_name) WHERE coalesce(l.seq <= upto, true)),
        live AS (SELECT *, {_OBJECT.format(v="lv")} AND {_OBJECT.format(v="fv")} AS objects FROM both_ WHERE here AND there AND lv IS DISTINCT FROM fv),
        lo AS (SELECT table_name, row_key, lv AS v FROM live WHERE objects), fo AS (SELECT table_name, row_key, fv AS v FROM live WHERE objects),
        a AS ({_LEAVES.format(k="table_name, row_key", t="lo")}), b AS ({_LEAVES.format(k="table_name, row_key", t="fo")})
        SELECT table_name, row_key, CASE WHEN here THEN 'leader_only' ELSE 'follower_only' END AS finding, '' AS field_path FROM both_ WHERE here <> there
        UNION ALL SELECT table_name, row_key, 'differs', '' FROM live WHERE NOT objects
        UNION ALL SELECT table_name, row_key, 'differs', path FROM (SELECT * FROM a WHERE kind <> 'NULL') a FULL JOIN (SELECT * FROM b WHERE kind <> 'NULL') b
            USING (table_name, row_key, path) WHERE a.leaf IS DISTINCT FROM b.leaf""",
    "p6_found": f"""
        WITH s AS (SELECT table_name, snapshot_seq, row_key, min(row_value) AS v FROM table_snapshots GROUP BY 1, 2, 3),
        o AS (SELECT table_name, snapshot_seq, lag(snapshot_seq) OVER (PARTITION BY table_name ORDER BY snapshot_seq) AS before
              FROM (SELECT DISTINCT table_name, snapshot_seq FROM table_snapshots)),
        n AS (SELECT s.*, before FROM s JOIN o USING (table_name, snapshot_seq) WHERE before IS NOT NULL),
        p AS (SELECT s.table_name, o.snapshot_seq, s.row_key, s.v FROM s JOIN o ON s.table_name = o.table_name AND s.snapshot_seq = o.before),
        both_ AS MATERIALIZED (SELECT table_name, snapshot_seq, row_key, p.v AS pv, n.v AS nv, p.table_name IS NOT NULL AS had, n.table_name IS NOT NULL AS has
                  FROM p FULL JOIN n USING (table_name, snapshot_seq, row_key)),
        live AS (SELECT *, {_OBJECT.format(v="pv")} AND {_OBJECT.format(v="nv")} AS objects FROM both_ WHERE had AND has AND pv IS DISTINCT FROM nv),
        po AS (SELECT table_name, snapshot_seq, row_key, pv AS v FROM live WHERE objects), no AS (SELECT table_name, snapshot_seq, row_key, nv AS v FROM live WHERE objects),
        a AS ({_LEAVES.format(k="table_name, snapshot_seq, row_key", t="po")}), b AS ({_LEAVES.format(k="table_name, snapshot_seq, row_key", t="no")})
        SELECT table_name, snapshot_seq, row_key, CASE WHEN has THEN 'added' ELSE 'removed' END AS change_kind FROM both_ WHERE had <> has
        UNION ALL SELECT table_name, snapshot_seq, row_key, 'changed' FROM live WHERE NOT objects
        UNION ALL SELECT DISTINCT table_name, snapshot_seq, row_key, 'changed' FROM (SELECT * FROM a WHERE kind <> 'NULL') a FULL JOIN (SELECT * FROM b WHERE kind <> 'NULL') b
            USING (table_name, snapshot_seq, row_key, path) WHERE a.leaf IS DISTINCT FROM b.leaf""",
    "p3_found": """
        WITH e AS (SELECT seq, arg_min(committed_at, delivery_id) AS committed_at FROM change_log GROUP BY seq),
        c AS (SELECT DISTINCT consumer FROM run_log)
        SELECT consumer, seq FROM e CROSS JOIN c WHERE NOT EXISTS (
            SELECT 1 FROM run_log r WHERE r.consumer = c.consumer AND r.outcome = 'succeeded'
            AND e.seq > r.from_seq AND e.seq <= r.to_seq AND e.committed_at <= r.read_at)""",
    "p5_found": """
        WITH newest AS (
            SELECT lower(coalesce(table_name, 'kv')) AS table_name, row_key, max(seq) AS seq,
                   arg_max(coalesce(is_deleted, lower(trim(operation)) = 'delete'), seq) AS gone
            FROM change_log GROUP BY 1, 2)
        SELECT table_name, row_key, seq FROM newest WHERE NOT gone""",
    "p7_found": """
        SELECT seq, delivery_id FROM (
            SELECT seq, delivery_id, min(delivery_id) OVER (PARTITION BY seq) AS first FROM change_log WHERE seq IS NOT NULL)
        WHERE delivery_id > first""",
}

ORACLE["p6_kept"] = ORACLE["p6_found"]
