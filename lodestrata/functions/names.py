"""Names of tables, indexes and columns."""

from __future__ import annotations

import re

DEFAULT_TABLE = "kv"
INTERNAL = "__"


class EngineError(Exception):
    """An error with the status class of the wire surface: 400, 404, 409 or 503."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


class ParseError(EngineError):
    """The statement text is not in the grammar."""


def normal_name(name: str | None, what: str = "table") -> str:
    """Lower-case name of letters, digits and underscores, at most 64 long; blank means the default table."""
    if not name or not name.strip():
        if what == "table":
            return DEFAULT_TABLE
        raise EngineError(f"{what} name is required")
    lowered = name.strip().lower()
    if len(lowered) > 64 or not re.fullmatch(r"[a-z_][a-z0-9_]*", lowered):
        raise EngineError(f"invalid {what} name '{name}'")
    return lowered


def is_internal(name: str) -> bool:
    return name.startswith(INTERNAL)


def require_key(key: str | None) -> str:
    if key is None or not str(key).strip():
        raise EngineError("key is required")
    return str(key)


def clamp(limit: int | None, default: int, most: int, least: int = 1) -> int:
    """A user-visible limit: the default if omitted, else within its bounds."""
    return default if limit is None else max(least, min(int(limit), most))
