"""A client of an engine in the same process: calls that are tried again, and transactions as objects.

Calls that fail because another writer was first (409) or a replica is not fresh enough (503) are
tried again with growing pauses; any other error is raised at once. A statement that writes either
has its commit record or has left nothing, so trying again never writes twice.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

from lodestrata.engine import Engine, Result
from lodestrata.functions.names import EngineError

RETRIED = (409, 503)


class Client:
    """``retries`` further tries after the first, the n-th after about ``delay * 2**n`` seconds (up to a half more, at random)."""

    def __init__(self, engine: Engine, retries: int = 3, delay: float = 0.25, pause: Callable[[float], None] = time.sleep):
        self.engine, self.retries, self.delay, self.pause = engine, retries, delay, pause

    def call(self, run: Callable):
        for attempt in range(self.retries + 1):
            try:
                return run()
            except EngineError as e:
                if e.status not in RETRIED or attempt == self.retries:
                    raise
            self.pause(self.delay * 2**attempt * (1 + random.random() / 2))

    def execute(self, text: str, parameters=None, tx: str | None = None) -> Result:
        prepared = self.engine.prepare(text)
        return self.call(lambda: prepared.execute(parameters, tx) if parameters is not None else self.engine.sql(text, tx))

    def get(self, key: str, table: str = "kv") -> str | None:
        return self.call(lambda: self.engine.get(table, key))

    def put(self, key: str, value: str, table: str = "kv") -> None:
        self.call(lambda: self.engine.put(table, key, value))

    def delete(self, key: str, table: str = "kv") -> None:
        self.call(lambda: self.engine.delete(table, key))

    def range(self, table: str = "kv", start: str | None = None, end: str | None = None, limit: int = 100) -> list[tuple[str, str]]:
        return [tuple(r) for r in self.call(lambda: self.engine.range(table, start, end, limit)).collect()]

    def changes(self, after: int = 0, limit: int = 100) -> list:
        return self.call(lambda: self.engine.changes(after, limit)).collect()

    def follow(self, after: int = 0, limit: int = 1000, polls: int | None = None) -> Iterator:
        """Entries of the feed one by one as they come; resumes after the last one that was handed out."""
        while polls is None or polls > 0:
            found = self.changes(after, limit)
            for entry in found:
                yield entry
                after = entry.seq
            if not found:
                polls = None if polls is None else polls - 1
                self.pause(self.delay)

    def begin(self, level: str = "READ COMMITTED") -> ClientTransaction:
        return ClientTransaction(self, self.call(lambda: self.engine.begin(level)))


class ClientTransaction:
    """Used with ``with``: commits at the end, rolls back on an error."""

    def __init__(self, client: Client, tx: str):
        self.client, self.id = client, tx

    def put(self, key: str, value: str, table: str = "kv") -> None:
        self.client.engine.put(table, key, value, self.id)

    def delete(self, key: str, table: str = "kv") -> None:
        self.client.engine.delete(table, key, self.id)

    def get(self, key: str, table: str = "kv") -> str | None:
        return self.client.engine.get(table, key, self.id)

    def commit(self) -> int:
        return self.client.engine.commit(self.id)

    def rollback(self) -> None:
        self.client.engine.rollback(self.id)

    def prepare(self) -> None:
        """First phase of two; then :meth:`commit_prepared`, which may be called again after any failure."""
        self.client.engine.prepare_commit(self.id)

    def commit_prepared(self) -> int:
        return self.client.call(lambda: self.client.engine.commit_prepared(self.id))

    def state(self) -> str:
        return self.client.engine.prepared_state(self.id)

    def __enter__(self) -> ClientTransaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.id in self.client.engine.transactions:
            self.rollback() if kind else self.commit()
