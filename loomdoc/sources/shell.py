"""One-line commands over a store: ``use shop``, ``find things {"n": {"$gt": 3}}``, ``query vector things [1, 0] --k 5``."""

from __future__ import annotations

import json
import shlex
from typing import Any

from pyspark.sql import DataFrame

from loomdoc.sources.store import Collection, Database, Store, StoreError


class CommandError(ValueError):
    """A line that is no command."""


def split_json(text: str) -> tuple[list[Any], str]:
    """The JSON values that a text starts with, and what follows them."""
    found, rest = [], text.strip()
    while rest[:1] in ("{", "["):
        try:
            value, end = json.JSONDecoder().raw_decode(rest)
        except ValueError as e:
            raise CommandError(f"bad JSON: {e}") from e
        found.append(value)
        rest = rest[end:].strip()
    return found, rest


class Shell:
    """Runs commands; remembers the database in use."""

    def __init__(self, store: Store):
        self.store, self.using = store, None

    def _database(self) -> Database:
        if self.using is None:
            raise StoreError("no database in use")
        return self.store.database(self.using)

    def run(self, line: str) -> Any:
        """What a command gives: a DataFrame, a plain value, or None."""
        words = line.split()
        for n in (2, 1):
            handler = getattr(self, "do_" + "_".join(words[:n]).replace("-", "_"), None)
            if len(words) >= n and handler is not None:
                return handler(line.split(None, n)[n] if len(words) > n else "")
        raise CommandError("unknown command")

    def _on(self, text: str, most: int, least: int = 0) -> tuple[Collection, list[Any], str]:
        name, _, rest = text.strip().partition(" ")
        values, rest = split_json(rest)
        if not name or not least <= len(values) <= most:
            raise CommandError(f"give a collection and {least} to {most} JSON values")
        return self._database()[name], values, rest

    def _plain(self, text: str, most: int, least: int = 0) -> tuple[Collection, list[Any]]:
        at, values, rest = self._on(text, most, least)
        if rest:
            raise CommandError(f"unexpected text: {rest}")
        return at, values

    def do_create_database(self, text: str) -> None:
        self.store.create_database(text.strip())

    def do_drop_database(self, text: str) -> None:
        self.store.drop_database(text.strip())
        self.using = None if self.using == text.strip() else self.using

    def do_list_databases(self, text: str) -> list[str]:
        return sorted(self.store.databases())

    def do_use(self, text: str) -> None:
        self.using = self.store.database(text.strip()).name

    def do_show_database(self, text: str) -> str:
        return self._database().name

    def do_list_collections(self, text: str) -> list[str]:
        return self._database().collections()

    def do_find(self, text: str) -> DataFrame:
        at, values = self._plain(text, 1)
        return at.find(*values)

    def do_findOne(self, text: str) -> DataFrame:  # noqa: N802
        at, values = self._plain(text, 1)
        return at.find_one(*values)

    def do_count(self, text: str) -> DataFrame:
        at, values = self._plain(text, 1)
        return at.count(*values)

    def do_explain(self, text: str) -> dict:
        at, values = self._plain(text, 1)
        return at.explain(*values)

    def do_aggregate(self, text: str) -> DataFrame:
        at, values = self._plain(text, 1, 1)
        return at.aggregate(values[0])

    def do_insert(self, text: str) -> int:
        at, values = self._plain(text, 1, 1)
        return at.insert(values[0])

    def do_update(self, text: str) -> int:
        at, values = self._plain(text, 2, 2)
        return at.update_one(*values)

    def do_delete(self, text: str) -> int:
        at, values = self._plain(text, 1, 1)
        return at.delete_one(values[0])

    def do_put_vector(self, text: str) -> int:
        name, key, vector = text.split(None, 2)
        values, rest = split_json(vector)
        if len(values) != 1 or rest:
            raise CommandError("give a collection, an id and a vector")
        at = self._database()[name]
        return at.update_one({at.key: key}, {"$set": {"vector": values[0]}})

    def do_query_vector(self, text: str) -> DataFrame:
        at, values, rest = self._on(text, 1, 1)
        flags = shlex.split(rest)
        given = dict(zip(flags[::2], flags[1::2], strict=True))
        if set(given) - {"--k", "--metric"}:
            raise CommandError(f"unknown flags: {sorted(given)}")
        return at.query_vector(values[0], int(given.get("--k", 10)), metric=given.get("--metric", "cosine"))[0]

    def do_ask(self, text: str) -> DataFrame:
        name, _, question = text.strip().partition(" ")
        return self._database()[name].ask(question)
