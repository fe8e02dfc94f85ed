"""JSON scalar semantics: validity, comparable text, flattened fields and value equality.

Built-in expressions are used where they give the exact rule. Flattening objects of unknown
shape and comparing numbers by value need a real parser, so those run as Arrow-batched
pandas UDFs over whole columns.
"""

from __future__ import annotations

import json

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.session import ship

#: Options that make ``from_json`` accept JSON only.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_STRICT_SQL = "map('allowSingleQuotes','false','allowNonNumericNumbers','false')"


def valid_json_sql(text: str) -> str:
    """SQL: whether ``text`` holds exactly one JSON value.

    In brackets and with a null behind it, so that a second value, trailing garbage and an early end
    of the brackets all show; a bare parse accepts what follows the first value.
    """
    return f"coalesce(size(from_json(concat('[', {text}, ',null]'), 'array<string>', {_STRICT_SQL})) = 2, false)"


def is_valid_json(text: Column) -> Column:
    """True for text that holds exactly one JSON value, NULL in gives False."""
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit(",null]")), T.ArrayType(T.StringType()), STRICT)
    return F.coalesce(F.size(parsed) == 2, F.lit(False))


#: A JSON number outside of strings, with all that stands between it and the number before.
_NUMBER_AT = (
    r'\G((?:[^"0-9-]|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+)(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)(?=\s*+(?:[,}\]]|$))'
)


def _member(name: str, kind: str) -> str:
    return f"struct<`{name.replace('`', '``')}`:{kind}>"


def comparable(text: Column, path: str) -> Column:
    """Comparable text at a dotted path: JSON null reads as ``null``, a missing path as NULL.

    Strings are decoded, numbers keep the spelling they are written in (they are read as texts), the
    last of duplicate members counts. Objects and arrays read in compact spelling here; where their
    own spelling matters, :func:`equals_text` and :func:`exact_comparable` read it. NULL for
    broken JSON. An empty path compares the whole value text unparsed.
    """
    if not path:
        return text
    *above, last = path.split(".")
    leaf, members = _member(last, "string"), "map<string,string>"
    for name in reversed(above):
        leaf, members = _member(name, leaf), _member(name, members)
    spelled = F.concat(F.lit("["), F.regexp_replace(text, _NUMBER_AT, '$1"$2"'), F.lit(",null]"))

    def inside(rows: Column, names: list[str]) -> Column:
        found = F.when(F.size(rows) == 2, F.get(rows, F.lit(0)))
        for name in names:
            found = found.getField(name)
        return found

    value = F.transform(F.array(F.from_json(spelled, f"array<{leaf}>", STRICT)), lambda w: inside(w, [*above, last]))[0]
    # A member that is null and one that is absent look alike above; only texts with a null are looked at again.
    parents = F.when(text.contains("null"), F.from_json(spelled, f"array<{members}>", STRICT))

    def named_null(w: Column) -> Column:
        held = F.filter(F.map_entries(inside(w, above)), lambda e: e["key"] == last)
        return F.when(F.try_element_at(held, F.lit(-1))["value"].isNull() & (F.size(held) > 0), "null")

    return F.coalesce(value, F.transform(F.array(parents), named_null)[0])


def equals_text(text: Column, path: str, literal: str) -> Column:
    """Whether the comparable text at a path is a literal; objects and arrays by their own spelling."""
    if path and literal[:1] in ("{", "["):
        return strict_comparable(text, F.lit(path)) == literal
    return comparable(text, path) == literal


def exact_comparable(text: Column, path: str) -> Column:
    """:func:`comparable` with objects and arrays in their own spelling, for what is written once and read often."""
    found = comparable(text, path)
    if not path:
        return found
    nested = found.startswith("{") | found.startswith("[")
    return F.when(nested, strict_comparable(F.when(nested, text), F.lit(path))).otherwise(found)


class _Number(str):
    """The raw text of a JSON number."""


class _Fraction(_Number):
    """A JSON number written with a fraction or an exponent."""


def _refuse(name):
    raise ValueError(name)


def json_loader():
    """A function from text to the parsed value with numbers as raw text; ValueError for anything but JSON.

    Made once per batch: the decoder is what costs, and it cannot be sent to executors.
    """
    decode = json.JSONDecoder(parse_int=_Number, parse_float=_Fraction, parse_constant=_refuse).decode

    def load(text):
        try:
            return decode(text)
        except RecursionError:
            raise ValueError("nested too deeply") from None

    return load


def load_json(text):
    """One text parsed (see :func:`json_loader`)."""
    if not isinstance(text, str):
        raise TypeError("not a text")
    return json_loader()(text)


def number_text(raw: str) -> str:
    """One spelling for each numeric value: significant digits and a decimal exponent."""
    sign = "-" if raw[0] == "-" else ""
    mantissa, _, exponent = raw.lstrip("-").lower().partition("e")
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    shift = int(exponent or 0) - len(fraction)
    short = digits.rstrip("0")
    if not short:
        return "0"
    shift += len(digits) - len(short)
    return f"{sign}{short}e{shift}"


def canonical(value) -> str:
    """One text for each JSON value: members sorted and null members left out, numbers by value."""
    if isinstance(value, _Number):
        return "n" + number_text(value)
    if isinstance(value, str):
        return json.dumps(value)
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    members = (json.dumps(k) + ":" + canonical(v) for k, v in sorted(value.items()) if v is not None)
    return "{" + ",".join(members) + "}"


def leaves(record: dict, prefix: str = ""):
    """(dotted path, value) of every member that is no object; arrays are not entered."""
    for name, value in record.items():
        if isinstance(value, dict):
            yield from leaves(value, prefix + name + ".")
        else:
            yield prefix + name, value


def type_name(value) -> str | None:
    """string, boolean, array, integer or double; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, _Fraction):
        return "double"
    if isinstance(value, _Number):
        return "integer"
    return "array" if isinstance(value, list) else "string"


def printable(text: str) -> str:
    """Lone surrogates cannot be stored as UTF-8; they become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def object_leaves(text, load):
    """{path: canonical text} of a JSON object without null members; None for any other text."""
    if text is None or "{" not in text:
        return None
    record = parsed_object(text, load)
    return None if record is None else {path: canonical(value) for path, value in leaves(record) if value is not None}


def parsed_object(text, load):
    """The parsed JSON object of a text, or None."""
    if text is None:
        return None
    try:
        record = load(text)
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


_TEXT = T.StringType()


def signed_hash(text: str) -> int:
    """64-bit xxHash of a text as a signed integer."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def leaf_hashes(record: dict):
    """(path, type, hash of the value or None) of every leaf of an object; equal values have equal hashes."""
    for path, value in dict(leaves(record)).items():
        text = "s" + value if type(value) is str else canonical(value)
        yield printable(path), type_name(value), None if value is None else signed_hash(text)


def text_hash(text: Column) -> Column:
    """A hash in built-in expressions that differs wherever values differ by fields or, if no objects, by text.

    The spelling of most objects does not matter: they are hashed as variants, which sort members and
    reduce decimals. Texts with exponents or very long numbers, which a variant may round, repeated
    members or a null are hashed so that equal values may get different hashes, never the reverse.
    """
    exact = text.rlike(r"^\s*\{") & ~text.rlike(r"[0-9][eE][-+0-9]|[0-9.]{17,}")
    spelled = F.to_json(F.try_parse_json(F.when(exact, F.concat(F.lit("["), text, F.lit(",null]")))))
    return F.xxhash64(F.coalesce(F.concat(F.lit("v"), spelled), F.concat(F.lit("t"), text)))


def unequal_paths(left, right, load):
    """Paths on which two values differ; [''] if they differ and are not both objects."""
    if left == right:
        return []
    a, b = object_leaves(left, load), object_leaves(right, load)
    if a is None or b is None:
        return [""]
    return sorted(printable(path) for path in a.keys() | b.keys() if a.get(path) != b.get(path))


@F.pandas_udf(T.ArrayType(_TEXT))
def differing_paths(left: pd.Series, right: pd.Series) -> pd.Series:
    """Arrow-batched :func:`unequal_paths`."""
    load = json_loader()
    return pd.Series([unequal_paths(a, b, load) for a, b in zip(left, right)], dtype=object)


def spelled(value) -> str:
    """Compact JSON of a value with numbers as they were written."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, list):
        return "[" + ",".join(map(spelled, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{spelled(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def _plain_leaves(text, load):
    """{path: raw text} of one JSON object, for rewriting it into a consistent record."""
    record = parsed_object(text, load)
    if record is None:
        return None
    return {
        printable(path): None if value is None
        else printable(value) if isinstance(value, str)
        else printable(spelled(value))
        for path, value in leaves(record)
    }


@F.pandas_udf(T.MapType(_TEXT, _TEXT))
def plain_leaves(texts: pd.Series) -> pd.Series:
    """Leaf paths to raw text; NULL for text that is no JSON object."""
    load = json_loader()
    return pd.Series([_plain_leaves(t, load) for t in texts], dtype=object)


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\n\r":
        at += 1
    return at


def raw_member(text: str, name: str) -> str | None:
    """The raw text of the last member of a name in the text of a (valid) JSON object."""
    decode, at, found = json.JSONDecoder(parse_constant=_refuse).raw_decode, _skip(text, 0) + 1, None
    while text[at := _skip(text, at)] != "}":
        key, at = decode(text, at)
        start = _skip(text, _skip(text, at) + 1)
        _, end = decode(text, start)
        found = text[start:end] if key == name else found
        at = _skip(text, end)
        at += text[at] == ","
    return found


def raw_comparable(text: str | None, path: str, load) -> str | None:
    """What :func:`strict_comparable` gives for one text."""
    if text is None or not path:
        return text
    try:
        value = load(text)
    except ValueError:
        return None
    raw = text
    for name in path.split("."):
        if not isinstance(value, dict) or name not in value:
            return None
        value = value[name]
        raw = raw_member(raw, name)
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    return printable(str(value) if isinstance(value, str) else raw)


@F.pandas_udf(_TEXT)
def strict_comparable(texts: pd.Series, paths: pd.Series) -> pd.Series:
    """Comparable text with objects and arrays as they are written. NULL for a missing path or broken JSON."""
    load = json_loader()
    return pd.Series([raw_comparable(t, p, load) for t, p in zip(texts, paths)], dtype=object)


ship(__name__)
