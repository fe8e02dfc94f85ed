"""From statement records to one DataFrame each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.json_values import equals_text
from lodestrata.functions.names import EngineError, ParseError, clamp
from lodestrata.operators import relational
from lodestrata.operators.keyed_joins import join_states
from lodestrata.operators.relational import RelationalSchema
from lodestrata.plans import sqlfront as ast

#: Limits of a SELECT and the depth of views.
DEFAULT_LIMIT, MOST_ROWS, VIEW_DEPTH = 100, 1000, 16


class Tables:
    """A source over given DataFrames: states (or typed rows of a schema), views, indexes by (table, path)."""

    def __init__(self, states: dict, schemas: dict | None = None, views: dict | None = None, indexed: dict | None = None):
        self.states, self.schemas, self.views, self.indexed = states, schemas or {}, views or {}, indexed or {}

    def state(self, table: str) -> DataFrame:
        if table not in self.states:
            raise EngineError(f"table '{table}' was not found", 404)
        return self.states[table]

    def schema(self, table: str) -> RelationalSchema | None:
        return self.schemas.get(table)

    def index_for(self, table: str, path: str):
        return self.indexed.get((table, path))

    def sql(self, text: str, most_rows: int | None = MOST_ROWS) -> DataFrame:
        return Planner(self, most_rows).select(ast.parse(text))

    def whole(self, text: str) -> DataFrame:
        """All rows of a SELECT, in no order; a LIMIT counts only if the text has one."""
        return Planner(self, None).select(ast.parse(text), limited=False)


class Planner:
    """Plans SELECTs over a source of states.

    ``source`` gives ``state(table)``, ``schema(table)``, ``views`` and ``index_for(table, path)``, whose
    ``rows_with(value)`` are the rows of a value equality; transactions pass a source whose states
    carry the overlay and whose indexes are off.
    """

    def __init__(self, source, most_rows: int | None = MOST_ROWS):
        self.source, self.most_rows = source, most_rows

    def select(self, s: ast.Select, depth: int = 0, limited: bool = True) -> DataFrame:
        if s.limit is not None and s.limit <= 0 and not self.source.schema(s.table):
            raise ParseError("LIMIT takes a positive number")
        if s.join:
            rows, order = self._join(s, depth)
        else:
            rows, order = self._single(s, depth)
        if not limited and s.limit is None:
            return rows.drop(*[c for c in order if c.startswith("__")])
        limit = clamp(s.limit, DEFAULT_LIMIT, self.most_rows or 2**31 - 1)
        return rows.orderBy(*order).limit(limit).drop(*[c for c in order if c.startswith("__")])

    # -- one table -------------------------------------------------------------------------------

    def _rows(self, table: str, depth: int) -> tuple[DataFrame, RelationalSchema | None, bool]:
        """(rows, schema, whether it is a view) of a table or view."""
        if table in self.source.views:
            if depth >= VIEW_DEPTH:
                raise EngineError(f"views are nested deeper than {VIEW_DEPTH}")
            inner = ast.parse(self.source.views[table])
            return self.select(inner, depth + 1, limited=False), None, True
        return self.source.state(table), self.source.schema(table), False

    def _single(self, s: ast.Select, depth: int) -> tuple[DataFrame, list[str]]:
        rows, schema, view = self._rows(s.table, depth)
        if view and "key" not in rows.columns:
            return self._typed(s, rows, None)
        if view:
            rows = rows.select(F.col("key").alias("row_key"), F.col("value").alias("row_value") if "value" in rows.columns else F.lit(None).cast("string").alias("row_value"))
        if schema and not self._physical(s, schema):
            return self._typed(s, schema.typed(rows) if "row_key" in rows.columns else rows, schema)
        rows = self._filter(s, rows, "row_key", "row_value", s.table)
        columns = [p[-1].lower() for p in s.columns] if s.columns else ["key", "value"]
        for path in s.columns or []:
            if len(path) > 2 or path[-1].lower() not in ("key", "value") or (len(path) == 2 and path[0].lower() != s.table):
                raise ParseError(f"unknown column '{'.'.join(path)}'")
        known = {"key": F.col("row_key").alias("key"), "value": F.col("row_value").alias("value")}
        return rows.select(F.col("row_key").alias("__key"), *[known[c] for c in dict.fromkeys(columns)]), ["__key"]

    def _physical(self, s: ast.Select, schema: RelationalSchema) -> bool:
        """Whether a relational table is addressed by key and value instead of its columns."""
        names = {c.name.lower() for c in schema.columns}
        used = [p[0].lower() for p in s.columns or []] + [p.path[0].lower() for p in s.where]
        return any(u in ("key", "value") and u not in names for u in used)

    def _typed(self, s: ast.Select, rows: DataFrame, schema: RelationalSchema | None) -> tuple[DataFrame, list[str]]:
        by_name = {c.lower(): c for c in rows.columns}

        def resolve(path: list[str]) -> str:
            name = path[-1].lower()
            if len(path) > 2 or name not in by_name or (len(path) == 2 and path[0].lower() != s.table):
                raise EngineError(f"unknown column '{'.'.join(path)}'")
            return by_name[name]

        for p in s.where:
            column = resolve(p.path)
            kind = rows.schema[column].dataType
            if p.operator == "=":
                rows = rows.where(relational.equals(column, kind, p.value.value))
            else:
                bound = F.lit(p.value.value).cast(kind)
                rows = rows.where(F.col(column) >= bound if p.operator == ">=" else F.col(column) <= bound)
        chosen = list(dict.fromkeys(map(resolve, s.columns))) if s.columns else rows.columns
        key = schema.key.name if schema else rows.columns[0]
        return rows.select(F.col(f"`{key}`").cast("string").alias("__key"), *[F.col(f"`{c}`") for c in chosen]), ["__key"]

    def _filter(self, s: ast.Select, rows: DataFrame, key: str, value: str, table: str, qualified: bool = False) -> DataFrame:
        """WHERE over key and value: at most one key equality, bound each way and value predicate.

        An index on the path gives the rows instead of the table; key predicates then filter these.
        """
        seen: set[str] = set()

        def by_value(p) -> bool:
            return p.path[p.path[0].lower() == table and len(p.path) > 1].lower() == "value"

        for p in sorted(s.where, key=by_value, reverse=True):
            path = p.path[1:] if p.path[0].lower() == table and len(p.path) > 1 else p.path
            if not isinstance(p.value.value, str):
                raise ParseError("keys and values are compared with quoted texts")
            text = p.value.value
            if path[0].lower() == "key" and len(path) == 1:
                kind = {"=": "key", ">=": "low", "<=": "high"}[p.operator]
                clash = {"key", "low", "high"} if kind == "key" else {"key", kind}
                if seen & clash:
                    raise ParseError("key predicates contradict each other")
                column = F.col(key)
                rows = rows.where({"key": column == text, "low": column >= text, "high": column <= text}[kind])
            elif path[0].lower() == "value" and p.operator == "=":
                kind = "value"
                if kind in seen:
                    raise ParseError("duplicate value predicate")
                where = ".".join(path[1:])
                index = None if qualified else self.source.index_for(table, where)
                if index is not None and value == "row_value":
                    rows = index.rows_with(text)
                else:
                    rows = rows.where(equals_text(F.col(value), where, text))
            else:
                raise ParseError("WHERE takes key predicates and value equalities")
            seen.add(kind)
        return rows

    # -- two tables ------------------------------------------------------------------------------

    def _join(self, s: ast.Select, depth: int) -> tuple[DataFrame, list[str]]:
        if s.table == s.join.table:
            raise EngineError("a table cannot be joined with itself by name")

        def side(path: list[str], table: str) -> str | None:
            if path[0].lower() != table or len(path) < 2:
                raise EngineError("the left operand names the FROM table, the right one the JOIN table")
            if path[1].lower() == "key" and len(path) == 2:
                return None
            if path[1].lower() != "value" or len(path) < 3:
                raise ParseError("JOIN takes table.key or table.value.path")
            return ".".join(path[2:])

        left, right = side(s.join.left, s.table), side(s.join.right, s.join.table)
        states = [self._keyed(t, depth) for t in (s.table, s.join.table)]
        rows = join_states(*states, left, right)
        rows = self._filter(s, rows, "left_key", "left_value", s.table, qualified=True)
        known: dict[str, Column] = {
            f"{t}.{c}": F.col(f"{w}_{c}") for t, w in ((s.table, "left"), (s.join.table, "right")) for c in ("key", "value")
        }
        chosen = []
        for path in s.columns or [name.split(".") for name in known]:
            name = ".".join(path).lower()
            name = name if "." in name else f"{s.table}.{name}"
            if name not in known:
                raise ParseError(f"unknown column '{name}'")
            chosen.append(known[name].alias(".".join(path).lower()))
        return rows.select(F.col("left_key").alias("__left"), F.col("right_key").alias("__right"), *chosen), ["__left", "__right"]

    def _keyed(self, table: str, depth: int) -> DataFrame:
        rows, _, view = self._rows(table, depth)
        if view:
            if not {"key", "value"} <= set(rows.columns):
                raise EngineError(f"view '{table}' has no key and value to join on")
            return rows.select(F.col("key").alias("row_key"), F.col("value").alias("row_value"))
        return rows
