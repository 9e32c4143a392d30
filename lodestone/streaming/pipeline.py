"""Change events and the pipelines over them, for batch and streaming tables alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import matches_any
from . import windows

EVENT = "id string, type string, key string, old_value string, new_value string, timestamp timestamp, transaction_id string, metadata map<string,string>"


def event_filter(types: list[str] | None = None, keys: list[str] | None = None, predicate: Column | None = None) -> Column:
    """type is one of ``types``, the whole key matches one of the expressions ``keys``, and the predicate holds."""
    out = F.col("type").isin(*types) if types else F.lit(True)
    out = out & matches_any(F.col("key"), keys or [])
    return out & predicate if predicate is not None else out


class Pipeline:
    """Steps in the order they were added; each is a function of a DataFrame."""

    def __init__(self, name: str = ""):
        self.name, self.steps, self.sinks = name, [], []

    def step(self, fn: Callable[[DataFrame], DataFrame]) -> Pipeline:
        self.steps.append(fn)
        return self

    def filter(self, condition: Column) -> Pipeline:
        return self.step(lambda df: df.where(condition))

    def map(self, **columns: Column) -> Pipeline:
        return self.step(lambda df: df.withColumns(columns))

    def group_by(self, key: Column, name: str = "key") -> Pipeline:
        """One row a group: key, group_size."""
        return self.step(lambda df: df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("group_size")))

    def reduce(self, *aggregates: Column) -> Pipeline:
        return self.step(lambda df: df.agg(*aggregates))

    def fold(self, order: str, column: str, start: Column, fn, key: str | None = None) -> Pipeline:
        """A left fold over the values of ``column`` in the order of ``order``, for functions that are not associative.

        With a key one row a key, each key's values in one place.  Without, the
        whole table is one group in one task; use :meth:`reduce` where an
        aggregate will do.
        """
        items = F.sort_array(F.collect_list(F.struct(order, column)))
        folded = F.aggregate(F.transform(items, lambda e: e[column]), start, fn).alias(column)
        return self.step(lambda df: (df.groupBy(key) if key else df).agg(folded))

    def join(self, other: DataFrame, key: str, window_us: int, time: str = "timestamp") -> Pipeline:
        return self.step(lambda df: windows.interval_join(df, other, key, window_us, time, time))

    def tumbling(self, size_us: int, key: str | None = None, time: str = "timestamp") -> Pipeline:
        return self.step(lambda df: windows.tumbling(df, size_us, key, time))

    def sliding(self, size_us: int, slide_us: int = 0, time: str = "timestamp") -> Pipeline:
        return self.step(lambda df: windows.sliding(df, size_us, slide_us, time))

    def sessions(self, gap_us: int, key: str | None = None, time: str = "timestamp") -> Pipeline:
        return self.step(lambda df: windows.sessions(df, gap_us, key, time))

    def to(self, sink: Callable[[DataFrame], None]) -> Pipeline:
        self.sinks.append(sink)
        return self

    def apply(self, events: DataFrame) -> DataFrame:
        for fn in self.steps:
            events = fn(events)
        return events

    def execute(self, events: DataFrame) -> DataFrame:
        out = self.apply(events)
        for sink in self.sinks:
            sink(out)
        return out


def routed(events: DataFrame, routes: list[tuple[str, str, str, int]]) -> DataFrame:
    """One row per event and handler: routes are (event type or '*', key expression, handler, priority)."""
    fits = [F.when(F.lit(t == "*") | (F.col("type") == t), True).otherwise(False) & F.col("key").rlike(rf"\A(?:{k})\z") for t, k, _, _ in routes]
    hits = F.filter(F.array(*[F.when(f, F.struct(F.lit(-p).alias("order"), F.lit(h).alias("handler"))) for f, (_, _, h, p) in zip(fits, routes)]), lambda x: x.isNotNull())
    return events.withColumn("_hit", F.explode(F.sort_array(hits))).withColumn("handler", F.col("_hit.handler")).withColumn("priority", -F.col("_hit.order")).drop("_hit")


def window_rule(events: DataFrame, width: str, key: str, *aggregates: Column, time: str = "ts") -> DataFrame:
    """Aggregates per key and epoch-aligned window."""
    return events.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w"), key).agg(*aggregates).select(F.unix_micros(F.col("w.start")).alias("start"), key, *[c for c in _names(aggregates)])


def _names(aggregates) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggregates]


def stream_sql(events: DataFrame, query: str, view: str = "stream") -> DataFrame:
    """SQL over a (streaming or batch) table under the name ``view``."""
    events.createOrReplaceTempView(view)
    return events.sparkSession.sql(query)
