"""Relational tables: declared schemas, row checks, updates and text rendering."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.json_values import STRICT, is_valid_json, load_json, type_name
from lodestrata.functions.names import EngineError

#: DDL type words and the types they mean.
TYPES = {
    **dict.fromkeys(("TEXT", "CHAR", "VARCHAR", "VARCHAR2"), "text"),
    **dict.fromkeys(("INT", "INTEGER"), "int"),
    "BIGINT": "bigint",
    **dict.fromkeys(("BOOL", "BOOLEAN"), "boolean"),
    **dict.fromkeys(("DOUBLE", "FLOAT", "REAL", "DECIMAL", "NUMERIC"), "double"),
}
SPARK = {"text": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType()}
_RANGE = {"int": 31, "bigint": 63}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    primary_key: bool = False
    not_null: bool = False


class RelationalSchema:
    """Columns of a relational table: exactly one primary key, names unique without case."""

    def __init__(self, columns: list[ColumnSpec]):
        names = [c.name.lower() for c in columns]
        if len(set(names)) != len(names):
            raise EngineError("column names must be unique")
        keys = [c for c in columns if c.primary_key]
        if len(keys) != 1:
            raise EngineError("a relational table needs exactly one primary key")
        self.columns, self.key = columns, keys[0]

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise EngineError(f"unknown column '{name}'")

    def to_json(self) -> list:
        return [[c.name, c.kind, c.primary_key, c.not_null] for c in self.columns]

    @classmethod
    def from_json(cls, columns: list) -> RelationalSchema:
        return cls([ColumnSpec(*c) for c in columns])

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, SPARK[c.kind], not c.primary_key) for c in self.columns])

    def typed(self, state: DataFrame) -> DataFrame:
        """Typed columns of a state whose keys are the primary key and whose values are JSON objects."""
        rest = T.StructType([T.StructField(c.name, SPARK[c.kind]) for c in self.columns if c is not self.key])
        parsed = state.select("row_key", F.from_json("row_value", rest).alias("r")) if len(rest) else state.select("row_key")
        return parsed.select(*[
            F.expr(f"try_cast(row_key AS {SPARK[c.kind].simpleString()})").alias(c.name) if c is self.key else F.col("r").getField(c.name).alias(c.name)
            for c in self.columns
        ])

    def check_key(self, text: str) -> None:
        if not key_fits(self.key.kind, text):
            raise EngineError(f"primary key '{self.key.name}' must be {self.key.kind}")

    def check_row(self, key: str, value: str) -> None:
        """Raises for the first rule that a single row breaks."""
        problem = row_problem(self, key, value)
        if problem:
            raise EngineError(problem)


def key_fits(kind: str, text: str) -> bool:
    if not text.strip():
        return False
    try:
        if kind in _RANGE:
            return -(1 << _RANGE[kind]) <= int(text) < 1 << _RANGE[kind]
        if kind == "double":
            float(text)
    except ValueError:
        return False
    return kind != "boolean" or text.lower() in ("true", "false")


def value_fits(kind: str, value) -> bool:
    name = type_name(value)
    if kind == "text":
        return name == "string"
    if kind == "boolean":
        return name == "boolean"
    if kind == "double":
        return name in ("integer", "double")
    return name == "integer" and -(1 << _RANGE[kind]) <= int(value) < 1 << _RANGE[kind]


def row_problem(schema: RelationalSchema, key: str, value: str) -> str | None:
    """The first broken rule of a row, or None."""
    if not key_fits(schema.key.kind, key):
        return f"primary key '{schema.key.name}' must be {schema.key.kind}"
    try:
        record = load_json(value)
    except (ValueError, TypeError):
        return "value must be valid JSON"
    if not isinstance(record, dict):
        return "value must be a JSON object"
    given = {}
    for name, item in record.items():
        if name.lower() == schema.key.name.lower():
            return f"primary key '{schema.key.name}' must not repeat in the value"
        if all(c.name.lower() != name.lower() for c in schema.columns):
            return f"unknown property '{name}'"
        given[name.lower()] = item
    for c in schema.columns:
        if c is schema.key:
            continue
        item = given.get(c.name.lower())
        if item is None:
            if c.not_null:
                return f"column '{c.name}' must not be null"
        elif not value_fits(c.kind, item):
            return f"column '{c.name}' must be {c.kind}"
    return None


def canonical_value(schema: RelationalSchema, record: dict) -> str:
    """The JSON value with property names as declared, so that reads find them."""
    names = {c.name.lower(): c.name for c in schema.columns}
    return json.dumps({names[k.lower()]: v for k, v in record.items()}, ensure_ascii=False)


def declared_value(schema: RelationalSchema, value: str) -> str:
    """A valid row's text, rewritten only if a property is spelled otherwise than declared."""
    record = json.loads(value)
    names = {c.name for c in schema.columns}
    return value if names >= set(record) else canonical_value(schema, record)


def _properties(schema: RelationalSchema) -> Column:
    """array<struct<key,value>> of the members of ``row_value``, named in lower case, values as variants; NULL if it is no object."""
    parsed = F.from_json(F.concat(F.lit("["), F.col("row_value"), F.lit(",null]")), "array<map<string,variant>>", STRICT)
    entries = F.map_entries(F.when(F.size(parsed) == 2, F.get(parsed, F.lit(0))))
    return F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), e["key"].alias("spelled")))


def validate_rows(rows: DataFrame, schema: RelationalSchema) -> DataFrame:
    """``rows`` (row_key, row_value) with ``problem``: the class of the first broken rule, or NULL.

    The rules of :func:`row_problem` in built-in expressions over variants: bad_key, bad_json,
    not_an_object, repeated_key, unknown_property, null_value, wrong_type. Names ignore case, of
    members that repeat the last counts.
    """
    known = F.array(*[F.lit(c.name.lower()) for c in schema.columns if c is not schema.key]) if len(schema.columns) > 1 else F.array().cast("array<string>")
    key = F.col("row_key")
    kind = SPARK[schema.key.kind].simpleString()
    key_ok = F.length(F.trim(key)) > 0 if schema.key.kind == "text" else F.expr(f"try_cast(row_key AS {kind})").isNotNull()
    held = rows.withColumn("__held", _properties(schema))
    names = F.transform("__held", lambda e: e["key"])

    def last_of(name: str) -> Column:
        return F.try_element_at(F.filter("__held", lambda e: e["key"] == name), F.lit(-1))["value"]

    checks: list[tuple[str, Column]] = [
        ("bad_key", ~F.coalesce(key_ok, F.lit(False))),
        ("bad_json", ~is_valid_json(F.col("row_value"))),
        ("not_an_object", F.col("__held").isNull()),
        ("repeated_key", F.array_contains(names, schema.key.name.lower())),
        ("unknown_property", F.size(F.array_except(names, known)) > 0),
    ]
    types = {"text": ["STRING"], "boolean": ["BOOLEAN"], "int": ["BIGINT"], "bigint": ["BIGINT"], "double": ["BIGINT", "DOUBLE", "DECIMAL"]}
    for c in schema.columns:
        if c is schema.key:
            continue
        item = last_of(c.name.lower())
        missing = item.isNull() | F.is_variant_null(item)
        if c.not_null:
            checks.append(("null_value", missing))
        fits = reduce(lambda a, b: a | b, [F.schema_of_variant(item).startswith(t) for t in types[c.kind]])
        if c.kind == "int":
            fits = fits & F.try_variant_get(item, "$", "int").isNotNull()
        checks.append(("wrong_type", ~missing & ~F.coalesce(fits, F.lit(False))))
    problem = F.when(checks[0][1], checks[0][0])
    for name, broken in checks[1:]:
        problem = problem.when(broken, name)
    return held.withColumn("problem", problem).drop("__held")


def declared_names(rows: DataFrame, schema: RelationalSchema) -> DataFrame:
    """Valid ``rows`` with the members of ``row_value`` spelled as declared, so that typed reads find them; other texts stay as they are."""
    names = {c.name.lower(): c.name for c in schema.columns if c is not schema.key}
    if not names:
        return rows
    declared = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    last = F.filter("__held", lambda e, i: ~F.exists(F.slice("__held", i + 2, F.size("__held")), lambda later: later["key"] == e["key"]))
    spelled = F.to_json(F.map_from_entries(F.transform(last, lambda e: F.struct(F.coalesce(declared[e["key"]], e["spelled"]), e["value"]))))
    differs = F.exists("__held", lambda e: e["spelled"] != F.coalesce(declared[e["key"]], e["spelled"]))
    held = rows.withColumn("__held", _properties(schema))
    return held.withColumn("row_value", F.when(differs, spelled).otherwise(F.col("row_value"))).drop("__held")


def equals(column: str, kind: T.DataType, literal) -> Column:
    """``column = literal``: numbers and booleans by type (so the scan can prune), text without case.

    A null or empty literal matches NULL as well, as on the wire.
    """
    if isinstance(literal, (bool, int, float)) and not isinstance(kind, T.StringType):
        typed = T.DoubleType() if isinstance(literal, float) else kind
        return F.col(column) == F.lit(literal).cast(typed)
    text = str(literal).lower() if literal is not None else ""
    shown = F.lower(F.col(column).cast("string"))
    return F.coalesce(shown, F.lit("")) == "" if text == "" else shown == text


def render_text(rows: DataFrame) -> DataFrame:
    """Every column as wire text: empty for NULL, True/False for booleans."""
    def text(name: str, kind: T.DataType) -> Column:
        c = F.col(f"`{name}`")
        shown = F.when(c, "True").otherwise("False") if isinstance(kind, T.BooleanType) else c.cast("string")
        return F.when(c.isNull(), "").otherwise(shown).alias(name)

    return rows.select(*[text(f.name, f.dataType) for f in rows.schema.fields])

