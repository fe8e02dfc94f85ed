"""Files whose schema drifts: fingerprints, migration steps, and one consistent table.

Input rows: ``table_name, file_id, written_at, row_key, row_value`` (other columns are ignored).
Each (table, file) gets a profile of its leaf paths and their majority types and a fingerprint
over it. A registry keeps these on files, so that only files it does not know are profiled; files in
order of writing with equal fingerprints need no further work. Where fingerprints differ, migration
steps (added, removed, renamed, retyped) are derived once per pair of files and kept; a rename is
proved by values that stay with their row keys. Rows are then routed through the chained steps.

Every text is parsed once, in Arrow batches, to the hashes of its leaves; profiles and renames both
come from these.

Nulls and broken JSON count as rows without fields. A file without any parsable row is a file
without fields. Ties in ``written_at`` are ordered by ``file_id``, ties of types by name.
Duplicate rows of a key count once, by the smallest value hash.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.json_values import json_loader, leaf_hashes, parsed_object, plain_leaves
from lodestrata.session import cut_lineage, scratch_path, ship
from lodestrata.sources.files import Files

FILE = ["table_name", "file_id"]
FIELDS = "array<struct<path:string,type:string>>"


def _same(a: str, b: str, columns: list[str]) -> Column:
    """Null-safe equality of two aliased sides."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def row_leaves(rows: DataFrame) -> DataFrame:
    """table_name, file_id, row_key, leaves (path, type, hash of the value or NULL), parsed once and written to the shared folder."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*FILE, "row_key"])
    leaf = pa.struct([("path", pa.string()), ("type", pa.string()), ("hash", pa.int64())])

    def parse(batches):
        load = json_loader()
        for batch in batches:
            ends, flat = [0], []
            for text in batch.column(3).to_pylist():
                record = parsed_object(text, load)
                if record is not None:
                    flat += leaf_hashes(record)
                ends.append(len(flat))
            columns = list(zip(*flat)) or [(), (), ()]
            found = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, leaf)], fields=list(leaf))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], names=[*FILE, "row_key", "leaves"])

    path = scratch_path(rows.sparkSession, "leaves")
    found = rows.select(*FILE, "row_key", "row_value").mapInArrow(parse, f"{kinds}, leaves array<struct<path:string,type:string,hash:bigint>>")
    found.where(F.size("leaves") > 0).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def file_schemas(rows: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """One row per file: table_name, file_id, written_at, fields array<struct<path,type>>, fingerprint."""
    leaves = row_leaves(rows) if leaves is None else leaves
    counts = leaves.select(*FILE, F.inline(F.transform("leaves", lambda x: F.struct(x["path"].alias("path"), x["type"].alias("type"))))).groupBy(*FILE, "path", "type").agg(F.count("*").alias("n"))
    fields = (
        counts.groupBy(*FILE, "path")
        .agg(F.max(F.when(F.col("type").isNotNull(), F.struct("n", "type"))).alias("most"))
        .groupBy(*FILE)
        .agg(F.sort_array(F.collect_list(F.struct("path", F.col("most.type").alias("type")))).alias("fields"))
    )
    files = rows.groupBy(*FILE).agg(F.min("written_at").alias("written_at")).alias("a")
    return files.join(fields.alias("b"), _same("a", "b", FILE), "left").select(
        "a.table_name", "a.file_id", "written_at", F.coalesce("fields", F.array().cast(FIELDS)).alias("fields")
    ).withColumn("fingerprint", F.sha2(F.to_json("fields"), 256))


def schema_versions(schemas: DataFrame) -> DataFrame:
    """The versions: each distinct fingerprint of a table with its first file and number."""
    first = schemas.groupBy("table_name", "fingerprint").agg(
        F.min(F.struct("written_at", "file_id")).alias("first"), F.count("*").alias("files"),
        F.any_value("fields").alias("fields"),
    )
    order = Window.partitionBy("table_name").orderBy("first")
    return first.select(
        "table_name", F.row_number().over(order).alias("version"), "fingerprint", "files",
        F.col("first.file_id").alias("first_file_id"), "fields",
    )


def numbered_files(schemas: DataFrame) -> DataFrame:
    """``schemas`` with ``n``: the place of each file in its table, found day by day, so a table with very many files is spread."""
    placed = schemas.withColumn("day", F.to_date("written_at"))
    days = placed.groupBy("table_name", "day").agg(F.count("*").alias("files"))
    before = Window.partitionBy("table_name").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("table_name", "day", F.coalesce(F.sum("files").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("table_name", "day").orderBy("written_at", "file_id")
    placed = placed.withColumn("n", F.row_number().over(within)).alias("p")
    return placed.join(days.alias("d"), _same("p", "d", ["table_name", "day"])).select("p.*", (F.col("n") + F.col("offset")).alias("place")).drop("n", "day").withColumnRenamed("place", "n")


def changed_pairs(files: DataFrame) -> DataFrame:
    """Each file (numbered) whose fingerprint differs from that of the file before, with what ended, started and was retyped."""
    now, old = files.alias("now"), files.select(*[F.col(c).alias(c) for c in files.columns if c != "n"], (F.col("n") + 1).alias("n")).alias("old")
    both = now.join(old, _same("now", "old", ["table_name", "n"]) & (F.col("now.fingerprint") != F.col("old.fingerprint"))).select(
        "now.table_name", "now.file_id", F.col("old.file_id").alias("prev_file_id"), "now.fields", F.col("old.fields").alias("prev_fields")
    )
    return both.select(
        *FILE, "prev_file_id",
        F.array_except("prev_fields.path", "fields.path").alias("ended"),
        F.array_except("fields.path", "prev_fields.path").alias("started"),
        F.expr(
            "transform(filter(fields, x -> exists(prev_fields, y -> y.path = x.path AND y.type <> x.type)), x -> x.path)"
        ).alias("retyped"),
    )


def _renames(leaves: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each changed file, its renames as array<struct<old,new>>, matched one to one, best first."""
    both = pairs.where((F.size("ended") > 0) & (F.size("started") > 0))
    wanted = both.select(
        "table_name", F.col("prev_file_id").alias("file_id"), F.col("file_id").alias("later"),
        F.col("ended").alias("paths"), F.lit(False).alias("is_new"),
    ).unionAll(both.select(*FILE, F.col("file_id").alias("later"), F.col("started").alias("paths"), F.lit(True).alias("is_new")))
    routed = leaves.alias("r").join(wanted.alias("w"), _same("r", "w", FILE)).select(
        "r.table_name", "later", "is_new", "row_key", F.expr("filter(leaves, x -> x.hash IS NOT NULL AND array_contains(paths, x.path))").alias("leaves")
    )
    held = (
        routed.select("table_name", "later", "is_new", "row_key", F.explode("leaves").alias("f"))
        .groupBy("table_name", "later", "row_key", "is_new", "f.path").agg(F.min("f.hash").alias("h"))
    )
    leaf = F.struct("path", "h")
    by_key = held.groupBy("table_name", "later", "row_key").agg(
        F.collect_list(F.when(~F.col("is_new"), leaf)).alias("olds"), F.collect_list(F.when(F.col("is_new"), leaf)).alias("news")
    ).where((F.size("olds") > 0) & (F.size("news") > 0))
    scored = (
        by_key.select("table_name", "later", F.explode("olds").alias("o"), "news")
        .select("table_name", "later", "o", F.explode("news").alias("n"))
        .groupBy("table_name", "later", F.col("o.path").alias("old"), F.col("n.path").alias("new"))
        .agg(F.count("*").alias("keys"), F.count_if(F.col("o.h") == F.col("n.h")).alias("same"))
        .where(F.col("same") * 2 > F.col("keys"))
    )
    candidates = scored.groupBy("table_name", "later").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("same") / F.col("keys")).alias("a"), (-F.col("keys")).alias("b"), "old", "new"))).alias("c")
    )
    greedy = (
        "aggregate(c, cast(array() AS array<struct<old:string,new:string>>), (acc, x) -> "
        "if(exists(acc, y -> y.old = x.old OR y.new = x.new), acc, "
        "concat(acc, array(named_struct('old', x.old, 'new', x.new)))))"
    )
    return candidates.select("table_name", F.col("later").alias("file_id"), F.expr(greedy).alias("renames"))


def pair_steps(leaves: DataFrame, pairs: DataFrame) -> DataFrame:
    """The steps of changed pairs: table_name, file_id, prev_file_id, change_kind, field_path, old_path; a pair without any has one with NULL kind."""
    joined = pairs.alias("p").join(_renames(leaves, pairs).alias("n"), _same("p", "n", FILE), "left").select("p.*", "renames")

    def step(kind: str, paths: str) -> str:
        return f"transform({paths}, x -> named_struct('change_kind', '{kind}', 'field_path', x, 'old_path', ''))"

    steps = ", ".join([
        step("added", "array_except(started, coalesce(renames.new, array()))"),
        step("removed", "array_except(ended, coalesce(renames.old, array()))"),
        step("retyped", "retyped"),
        "transform(coalesce(renames, array()), r -> named_struct('change_kind', 'renamed', 'field_path', r.new, 'old_path', r.old))",
    ])
    return joined.select(*FILE, "prev_file_id", F.explode_outer(F.expr(f"concat({steps})")).alias("s")).select(*FILE, "prev_file_id", "s.*")


class SchemaRegistry:
    """The schemas of files and the steps between them, kept in a folder.

    Adding rows profiles only files that are not known, and derives steps only for pairs of files
    that have none: a file that arrives late gets steps from the file before it and to the one
    after it, the steps between those two are no longer read. Parts are named by numbered records
    that one writer only can create; a part without a record is not read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def _parts(self, kind: str) -> list[str]:
        names = self.files.names("records")
        records = [json.loads(self.files.read(f"records/{n}")) for n in names]
        return [r["part"] for r in records if r["kind"] == kind]

    def _append(self, kind: str, found: DataFrame) -> None:
        part, number = f"{kind}/{uuid.uuid4().hex}", len(self.files.names("records")) + 1
        found.write.parquet(self.files.at(part))
        try:
            self.files.create(f"records/{number:012d}.json", json.dumps({"kind": kind, "part": part}))
        except FileExistsError:
            self.files.delete(part)
            raise RuntimeError("the registry was changed meanwhile; add the rows again") from None

    def _read(self, kind: str) -> DataFrame | None:
        parts = [self.files.at(p) for p in self._parts(kind)]
        return self.spark.read.parquet(*parts) if parts else None

    def add(self, rows: DataFrame) -> None:
        """Registers the files of ``rows`` that are not known, and the steps to and from them."""
        known = self._read("schemas")
        new = rows
        if known is not None:
            known = known.select(*FILE)
            new = rows.alias("r").join(known.alias("k"), _same("r", "k", FILE), "left_anti")
        leaves = row_leaves(new)
        self._append("schemas", file_schemas(new, leaves))
        pairs = changed_pairs(self.numbered())
        done = self._read("steps")
        if done is not None:
            key = [*FILE, "prev_file_id"]
            pairs = pairs.alias("p").join(done.select(*key).distinct().alias("d"), _same("p", "d", key), "left_anti")
        pairs = cut_lineage(pairs)
        if known is not None:
            # Known files that a new one stands beside are read once more for their values.
            beside = pairs.select(*FILE).union(pairs.select("table_name", "prev_file_id")).distinct().alias("b").join(known.alias("k"), _same("b", "k", FILE), "left_semi")
            leaves = leaves.unionByName(row_leaves(rows.alias("r").join(beside.alias("b"), _same("r", "b", FILE), "left_semi")))
        self._append("steps", pair_steps(leaves, pairs))

    def numbered(self) -> DataFrame:
        """The schemas of all files with their place ``n`` in their table."""
        return numbered_files(self._read("schemas"))

    def versions(self) -> DataFrame:
        return schema_versions(self._read("schemas"))

    def steps(self) -> DataFrame:
        """Every change between a file and the file before it.

        Columns: table_name, file_id (the later file), change_kind (added, removed, renamed,
        retyped), field_path, old_path ('' unless renamed).
        """
        files = self.numbered().select(*FILE, "n")
        now, old = files.alias("now"), files.select(*FILE, (F.col("n") + 1).alias("n")).alias("old")
        pairs = now.join(old, _same("now", "old", ["table_name", "n"])).select("now.*", F.col("old.file_id").alias("prev_file_id")).alias("p")
        key = [*FILE, "prev_file_id"]
        found = self._read("steps").where(F.col("change_kind").isNotNull()).alias("s").join(pairs, _same("s", "p", key), "left_semi")
        return found.select(*FILE, "change_kind", "field_path", "old_path")


def migration_steps(rows: DataFrame) -> DataFrame:
    """The steps of :class:`SchemaRegistry` for rows that no registry knows, without keeping them."""
    leaves = row_leaves(rows)
    files = numbered_files(cut_lineage(file_schemas(rows, leaves)))
    return pair_steps(leaves, cut_lineage(changed_pairs(files))).where(F.col("change_kind").isNotNull()).select(*FILE, "change_kind", "field_path", "old_path")


def segments(files: DataFrame) -> DataFrame:
    """table_name, file_id, seg of numbered files: runs of files with one fingerprint, in order."""
    order = Window.partitionBy("table_name").orderBy("n")
    starts = F.when(F.lag("fingerprint").over(order).eqNullSafe(F.col("fingerprint")), 0).otherwise(1)
    return files.withColumn("starts", starts).select(*FILE, "fields", "starts", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("seg"))


def field_lineage(placed: DataFrame, steps: DataFrame) -> DataFrame:
    """For each path that is present in a segment of files, the field it was carried to by renames.

    ``placed``: as from :func:`segments`. Columns: table_name, seg, path, target (the newest name),
    since (the segment in which that name began): a name that ends and comes back is another field.
    Chains of renames are followed by pointer doubling, so a chain of length n takes log2(n) joins.
    """
    here = placed.where("starts = 1").select("table_name", "seg", F.explode("fields.path").alias("path"))
    # Islands of consecutive segments that have the path.
    seen = Window.partitionBy("table_name", "path").orderBy("seg")
    here = here.withColumn("island", F.col("seg") - F.row_number().over(seen))
    islands = cut_lineage(here.groupBy("table_name", "path", "island").agg(F.min("seg").alias("first"), F.max("seg").alias("last")))
    renamed = steps.where("change_kind = 'renamed'").alias("s").join(placed.alias("p"), _same("s", "p", FILE)).select("s.table_name", "s.field_path", "s.old_path", "p.seg")

    def at(side: str, path: str, edge: str, seg: Column) -> Column:
        return _same("s", side, ["table_name"]) & (F.col(f"{side}.path") == F.col(f"s.{path}")) & (F.col(f"{side}.{edge}") == seg)

    links = (
        renamed.alias("s")
        .join(islands.alias("o"), at("o", "old_path", "last", F.col("s.seg") - 1))
        .join(islands.alias("w"), at("w", "field_path", "first", F.col("s.seg")))
        .select("s.table_name", F.struct("o.path", "o.first").alias("node"), F.struct("w.path", "w.first").alias("next"))
    )
    links = cut_lineage(links)
    while True:
        a, b = links.alias("a"), links.alias("b")
        hop = a.join(b, _same("a", "b", ["table_name"]) & (F.col("a.next") == F.col("b.node")), "left").select(
            "a.table_name", "a.node", F.coalesce("b.next", "a.next").alias("next"), F.col("b.next").isNotNull().alias("moved")
        )
        hop = cut_lineage(hop)
        links = hop.drop("moved")
        if hop.where("moved").isEmpty():
            break
    ended = islands.select("table_name", "first", "last", "path", F.struct("path", "first").alias("node")).alias("f").join(
        links.alias("k"), _same("f", "k", ["table_name"]) & (F.col("f.node") == F.col("k.node")), "left"
    ).select("f.table_name", "f.path", "f.first", "f.last", F.coalesce("k.next", "f.node").alias("end"))
    h, e = here.alias("h"), ended.alias("e")
    inside = _same("h", "e", ["table_name"]) & (F.col("h.path") == F.col("e.path")) & F.col("h.seg").between(F.col("e.first"), F.col("e.last"))
    return h.join(e, inside).select("h.table_name", "h.seg", "h.path", F.col("end.path").alias("target"), F.col("end.first").alias("since"))


#: Cast rules by target type; text stays as it is.
CASTS = {"integer": "bigint", "double": "double", "boolean": "boolean"}


def _field_key(target: str | Column, since: Column) -> Column:
    return F.concat_ws("\x1f", target, since.cast("string"))


def consistent_rows(rows: DataFrame, registry: SchemaRegistry, defaults: dict[str, str] | None = None) -> DataFrame:
    """All rows of all files in the newest naming and typing, one row per input row.

    Columns: table_name, file_id, row_key, fields: array of field_path (newest name), since (number
    of the segment of files in which that name began, as a name may come back for another field),
    field_type (majority type of the newest files that have it; NULL if all values are null), value
    (text after rename, default and cast rule) and cast_failed (the text did not fit and was kept as
    it is). A field that the row's file or the row lacks, or holds null for, gets the default of its
    newest name or NULL. Rows that are no JSON object have only defaults. Equal rows of a file are one.
    """
    files = cut_lineage(registry.numbered())
    placed = cut_lineage(segments(files))
    lineage = cut_lineage(field_lineage(placed, registry.steps()))
    typed = placed.where("starts = 1").select("table_name", "seg", F.explode("fields").alias("f")).select("table_name", "seg", "f.*")
    named = typed.alias("f").join(lineage.alias("l"), _same("f", "l", ["table_name", "seg", "path"])).select("f.table_name", "f.seg", "type", "target", "since")
    newest = named.groupBy("table_name", "target", "since").agg(F.max_by("type", F.when(F.col("type").isNotNull(), F.col("seg"))).alias("field_type"))
    wide = newest.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("target", "since", "field_type"))).alias("targets"))
    routes = lineage.groupBy("table_name", "seg").agg(F.map_from_entries(F.collect_list(F.struct(_field_key("target", F.col("since")), "path"))).alias("route"))
    # Tables meet their fields file by file, so that a table or file with many rows can be split.
    per_file = placed.select(*FILE, "seg").alias("p").join(routes.alias("o"), _same("p", "o", ["table_name", "seg"]), "left").join(wide.alias("w"), _same("p", "w", ["table_name"]), "left").select(
        "p.table_name", "p.file_id", "route", F.coalesce("targets", F.array().cast("array<struct<target:string,since:bigint,field_type:string>>")).alias("targets")
    )
    once = rows.select(*FILE, "row_key", "row_value").distinct().alias("r")
    routed = once.join(per_file.alias("p"), _same("r", "p", FILE)).select("r.*", "route", "targets")
    flat = routed.select(*FILE, "row_key", "route", "targets", plain_leaves("row_value").alias("leaves"))
    given = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]) if defaults else F.create_map().cast("map<string,string>")

    def field(t: Column) -> Column:
        key = _field_key(t["target"], t["since"])
        return F.struct(
            t["target"].alias("field_path"), t["since"].alias("since"), t["field_type"].alias("field_type"),
            F.coalesce(F.try_element_at("leaves", F.try_element_at("route", key)), F.try_element_at(given, t["target"])).alias("raw"),
        )

    def typed_value(x: Column) -> Column:
        fits = F.when(F.coalesce(~x["field_type"].isin(*CASTS), F.lit(True)), x["raw"])
        for kind, sql_type in CASTS.items():
            fits = fits.when(x["field_type"] == kind, x["raw"].try_cast(sql_type).cast("string"))
        return F.struct(x["field_path"].alias("field_path"), x["since"].alias("since"), x["field_type"].alias("field_type"),
                        F.coalesce(fits, x["raw"]).alias("value"), (x["raw"].isNotNull() & fits.isNull()).alias("cast_failed"))

    return flat.select(*FILE, "row_key", F.transform(F.transform("targets", field), typed_value).alias("fields"))


def consistent_table(rows: DataFrame, registry: SchemaRegistry, table: str | None, defaults: dict[str, str] | None = None) -> DataFrame:
    """One table in wide form: file_id, row_key and a typed column per field; names that came back get ``@since`` but for the newest.

    Texts that do not fit the type of their column are NULL there and listed in ``misfits`` as a map.
    """
    mine = rows.where(F.col("table_name").eqNullSafe(F.lit(table)))
    found = consistent_rows(mine, registry, defaults)
    head = found.select("fields").first()
    fields = [(f.field_path, f.since, f.field_type) for f in head.fields] if head else []
    newest = {path: max(s for p, s, _ in fields if p == path) for path, _, _ in fields}
    columns = []
    for i, (path, since, kind) in enumerate(fields):
        f = F.get("fields", F.lit(i))
        name = path if since == newest[path] else f"{path}@{since}"
        columns.append(F.when(~f["cast_failed"], f["value"]).cast(CASTS.get(kind, "string")).alias(name))
    failed = F.filter("fields", lambda f: f["cast_failed"])
    misfits = F.map_from_entries(F.transform(failed, lambda f: F.struct(F.concat_ws("@", f["field_path"], f["since"].cast("string")), f["value"])))
    return found.select("file_id", "row_key", *columns, misfits.alias("misfits"))


ship(__name__)
