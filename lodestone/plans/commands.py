"""Text commands over a store: one line in, a DataFrame (or a word) out."""

from __future__ import annotations

import shlex

from pyspark.sql import DataFrame

from ..functions.predicates import OPERATORS, Condition
from ..operators import versions
from ..operators.query import QueryEngine


class Interpreter:
    """Values with blanks stand in quotes; commands are not case-sensitive."""

    def __init__(self, store: versions.Store):
        self.store, self.snapshots = store, {}

    @property
    def engine(self) -> QueryEngine:
        return QueryEngine(versions.latest(self.store.log))

    def execute(self, line: str) -> DataFrame | str | int:
        words = shlex.split(line, posix=True)
        if not words:
            return "OK"
        method = getattr(self, f"do_{words[0].lower()}", None)
        if method is None:
            raise ValueError(f"unknown command {words[0]!r}")
        return method(*words[1:])

    def script(self, text: str) -> list:
        """Lines in order; empty ones and those that begin with # or // are passed over."""
        lines = (x.strip() for x in text.splitlines())
        return [self.execute(x) for x in lines if x and not x.startswith(("#", "//"))]

    def do_put(self, key, value):
        self.store.put(key, value)
        return "OK"

    def do_get(self, key):
        return versions.get(self.store.log, key)

    def do_del(self, key):
        self.store.delete(key)
        return "OK"

    def do_scan(self, start, end):
        return versions.range_scan(self.store.log, start, end)

    def do_prefix_scan(self, prefix, limit="0"):
        return versions.prefix_scan(self.store.log, prefix, int(limit))

    def do_snapshot(self):
        number = len(self.snapshots) + 1
        self.snapshots[number] = self.store.snapshot()
        return number

    def do_release(self, number):
        self.store.release(self.snapshots.pop(int(number)))
        return "OK"

    def do_get_at(self, key, number):
        return versions.get(self.store.log, key, self.snapshots[int(number)])

    def do_batch(self, kind, *words):
        if kind.upper() == "PUT":
            self.store.batch_put(zip(words[::2], words[1::2]))
        elif kind.upper() == "GET":
            return versions.multi_get(self.store.log, list(words))
        else:
            self.store.batch_delete(words)
        return "OK"

    def do_get_where(self, field, operator, literal, *rest):
        return self.engine.where(self._condition(field, operator, literal), int(rest[1]) if rest and rest[0].upper() == "LIMIT" else 0)

    def do_count(self, *words):
        """COUNT, or COUNT [WHERE] field operator literal."""
        words = words[1:] if words and words[0].upper() == "WHERE" else words
        return self.engine.count(self._condition(*words) if words else None)

    def do_sum(self, pattern=""):
        return self.engine.sum_values(pattern)

    def do_avg(self, pattern=""):
        return self.engine.avg_values(pattern)

    def do_min_max(self, pattern=""):
        return self.engine.min_max_values(pattern)

    def do_scan_order(self, order, start="", end="", *rest):
        return self.engine.scan_ordered(start, end, order.upper() == "DESC", int(rest[1]) if rest and rest[0].upper() == "LIMIT" else 0)

    def do_exists(self, *keys):
        return versions.multi_get(self.store.log, list(keys)).select("key")

    def do_keys(self, pattern=""):
        return self.engine.keys(pattern)

    def do_flush(self):
        return "OK"  # appends are durable as they are

    def do_compact(self):
        self.store.compact()
        return "OK"

    def do_stats(self):
        return versions.version_stats(self.store.log)

    def do_echo(self, *words):
        return " ".join(words)

    @staticmethod
    def _condition(field, operator, literal) -> Condition:
        if operator.upper() not in OPERATORS:
            raise ValueError(f"unknown operator {operator!r}")
        return Condition(field, operator.upper(), literal)
