"""Deeply nested records turned into related flat tables by higher-order projections.

A spec lists, per table, the array paths below a record (dots lead through objects and through
the elements of arrays that are listed themselves). Every text is parsed once, to a variant; nested
``transform`` calls attach the path of the enclosing element and the position, ``flatten`` joins the
levels of each target array. The arrays of all targets are routed in one pass to columns of their own
in the shared folder, and one ``inline`` per target table, reading its column alone, emits the rows.
All of it runs inside the JVM; nothing is shuffled before the final distinct.

Defined cases: broken JSON and records that are no object give no rows; absent, null, scalar or
unreadable arrays are empty; a lone object is element 0; a string holding the JSON text of a
record, array or object counts as what it holds; elements that are no objects keep their position
and give no row; of members of one name the last counts; repeated rows give one row. Texts beyond
the size of a variant (128 MB) raise an error, so no record is left out silently.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.json_values import valid_json_sql
from lodestrata.session import scratch_path

#: Texts from this length on are parsed so that a size beyond a variant's is an error.
LONG = 1 << 24
_MAP, _LIST = "'map<string,variant>'", "'array<variant>'"


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once for all its uses in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _sole(text: str) -> str:
    """SQL for the one JSON value that a text holds, as a variant; NULL if it is broken or more than one."""
    wrapped = f"concat('[', {text}, ',null]')"
    parsed = f"CASE WHEN length({text}) < {LONG} THEN try_parse_json({wrapped}) WHEN {valid_json_sql(text)} THEN parse_json({wrapped}) END"
    return _let(f"try_variant_get({parsed}, '$', {_LIST})", "w", "CASE WHEN size(w) = 2 THEN w[0] END")


def _opened(value: str) -> str:
    """SQL for what a variant string holds, if that opens like an array or an object."""
    return _let(f"try_variant_get({value}, '$', 'string')", "s", f"CASE WHEN ltrim(s) RLIKE '^[\\\\[{{]' THEN {_sole('s')} END")


def _members(value: str) -> str:
    """SQL for the members of an object, or of the object that a string holds; NULL for anything else."""
    direct, held = f"try_variant_get({value}, '$', {_MAP})", f"try_variant_get(h, '$', {_MAP})"
    scalar = f"try_variant_get({value}, '$', {_LIST}) IS NULL"
    return _let(direct, "d", f"CASE WHEN d IS NOT NULL THEN d WHEN {scalar} THEN {_let(_opened(value), 'h', held)} END")


def _elements(value: str) -> str:
    """SQL for the elements of an array, a lone object or a string that holds either; NULL for anything else."""

    def of(x: str, otherwise: str) -> str:
        return _let(f"try_variant_get({x}, '$', {_LIST})", "a", f"CASE WHEN a IS NOT NULL THEN a WHEN try_variant_get({x}, '$', {_MAP}) IS NOT NULL THEN array({x}) ELSE {otherwise} END")

    return of(value, _let(_opened(value), "h", of("h", "NULL")))


class _Tree:
    """Arrays below an object: members lead to arrays or through plain objects to more members."""

    def __init__(self, arrays: list[str]):
        self.members: dict[str, _Tree] = {}
        self.target: str | None = None
        self.label: str | None = None
        for path in arrays:
            at, since = self, []
            parts = path.split(".")
            for k, name in enumerate(parts):
                since.append(name)
                at = at.members.setdefault(name, _Tree([]))
                if ".".join(parts[: k + 1]) in arrays:
                    at.target, at.label, since = ".".join(parts[: k + 1]), ".".join(since), []

    def levels(self, objects: str, places: list[str], out: dict[str, str], depth: int = 0) -> None:
        """Adds to ``out`` the SQL of each target's array of nodes (parent_path, node_path, position, members).

        ``objects`` is SQL for an array of (path, members) that the members of this tree are looked up in.
        """
        for name, tree in self.members.items():
            m, quoted = f"m{depth}", name.replace("'", "\\'")
            if tree.target is None:
                inner = f"transform({objects}, {m} -> named_struct('path', {m}.path, 'members', {_members(f'{m}.members[{chr(39)}{quoted}{chr(39)}]')}))"
                tree.levels(inner, places, out, depth + 1)
                continue
            e, i = f"e{depth}", f"i{depth}"
            node = f"concat(if({m}.path = '', '', concat({m}.path, '.')), '{tree.label}[', {i}, ']')"
            one = f"named_struct('parent_path', {m}.path, 'node_path', {node}, 'position', {i}, 'path', {node}, 'members', {_members(e)})"
            below = _elements(f"{m}.members['{quoted}']")
            nodes = f"transform(coalesce({below}, array()), ({e}, {i}) -> {one})"
            out[tree.target] = f"filter(flatten(transform({objects}, {m} -> {nodes})), n -> n.members IS NOT NULL)"
            places.append(tree.target)
            # The next level starts from the column of this one, which is computed once.
            tree.levels(f"`{_column(tree.target)}`", places, out, depth + 1)


def _column(target: str) -> str:
    return target.replace(".", "__")


def routed(rows: DataFrame, arrays: list[str], keys: list[str], value: str = "row_value", elements: bool = True) -> DataFrame:
    """The keys and one column per target array (dots as ``__``): its nodes of each record; lazy, needs duplicate names allowed."""
    tree, order, sql = _Tree(arrays), [], {}
    tree.levels("`root`", order, sql)
    # The target's columns take the place of the value; key columns of the same name would clash and are set aside.
    aside = {k: f"key{n}__" for n, k in enumerate(keys)}
    held = rows.select(*[F.col(k).alias(a) for k, a in aside.items()], F.expr(f"array(named_struct('path', '', 'members', {_let(_sole(value), 'v', _members('v'))}))").alias("root"))
    for target in order:
        held = held.withColumn(_column(target), F.expr(sql[target]))
    element = ", 'element', to_json(n.members)" if elements else ""
    kept = [
        F.expr(f"transform(`{_column(t)}`, n -> named_struct('parent_path', n.parent_path, 'node_path', n.node_path, 'position', n.position{element}))").alias(_column(t))
        for t in order
    ]
    return held.select(*[F.col(a) for a in aside.values()], *kept)


def flatten_records(rows: DataFrame, arrays: list[str], keys: list[str], value: str = "row_value", elements: bool = True) -> dict[str, DataFrame]:
    """{array path: flat table}: the keys, parent_path, node_path, position (and element, as JSON text).

    The one pass over the records is made here; the tables read its result.
    """
    spark = rows.sparkSession
    path, allow = scratch_path(spark, "nested"), "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(allow, "false")
    spark.conf.set(allow, "true")
    try:
        routed(rows, arrays, keys, value, elements).write.parquet(path)
    finally:
        spark.conf.set(allow, before)
    stored = spark.read.parquet(path)
    back = [F.col(f"key{n}__").alias(k) for n, k in enumerate(keys)]
    return {a: stored.select(*back, F.inline(F.col(f"`{_column(a)}`"))) for a in arrays}


def typed_columns(flat: DataFrame, schema: str) -> DataFrame:
    """The scalar members of ``element`` as typed columns of a DDL schema; misfits are NULL."""
    parsed = F.from_json("element", schema, {"allowSingleQuotes": "false"})
    return flat.withColumn("f", parsed).select(*[c for c in flat.columns if c != "element"], "f.*")


def all_nodes(rows: DataFrame, spec: dict[str, list[str]]) -> DataFrame:
    """Every object in every listed array: table_name, row_key, parent_path, node_path."""
    found = []
    for table, arrays in spec.items():
        flat = flatten_records(rows.where(F.col("table_name") == table), arrays, ["table_name", "row_key"], elements=False)
        found += [x.select("table_name", "row_key", "parent_path", "node_path") for x in flat.values()]
    return reduce(DataFrame.unionAll, found).distinct()
