"""Named pipelines over batches of events: registering, counting, handlers, replay, subscriptions, two-way sync."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import glob
from ..session import scratch
from .pipeline import Pipeline


class Engine:
    """Pipelines by name.  Batches go through all of them while the engine runs, and through none otherwise."""

    def __init__(self):
        self.pipelines: dict[str, Pipeline] = {}
        self.running = False
        self.counts: dict[str, dict[str, int]] = {}

    def register(self, pipeline: Pipeline) -> None:
        if pipeline.name in self.pipelines:
            raise ValueError(f"pipeline {pipeline.name!r} exists")
        self.pipelines[pipeline.name] = pipeline
        self.counts[pipeline.name] = {"batches": 0, "events": 0, "rows": 0, "failed": 0}

    def unregister(self, name: str) -> None:
        del self.pipelines[name], self.counts[name]

    def start(self) -> None:
        self.running = True

    def stop(self) -> None:
        self.running = False

    def process(self, events: DataFrame) -> dict[str, DataFrame]:
        """Each pipeline's result; one that fails is counted and does not stop the others."""
        out = {}
        if not self.running:
            return out
        n = events.count()
        for name, pipeline in self.pipelines.items():
            own = self.counts[name]
            own["batches"] += 1
            own["events"] += n
            try:
                found = pipeline.execute(events)
                own["rows"] += found.count()
                out[name] = found
            except Exception:
                own["failed"] += 1
        return out

    def stats(self) -> dict[str, dict[str, int]]:
        return {name: dict(c) for name, c in self.counts.items()}


def counted(events: DataFrame, condition: Column) -> DataFrame:
    """One row: events processed, and those that a filter lets through or not."""
    return events.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.coalesce(condition, F.lit(False))).alias("passed"), F.count_if(~F.coalesce(condition, F.lit(False))).alias("filtered"))


def handle(events: DataFrame, handler: Callable[[DataFrame], None], condition: Column | None = None, size: int = 0, order: str = "timestamp") -> int:
    """Give a handler the events that fulfil a condition, in batches of ``size`` in time order (0: all at once); the number of batches.

    A batch is a bounded slice of a table that is numbered once.
    """
    rows = events.where(condition) if condition is not None else events
    if not size:
        handler(rows)
        return 1
    numbered = batches(rows, size, order)
    last = numbered.agg(F.max("batch")).first()[0]
    for k in range(0 if last is None else last + 1):
        handler(numbered.where(F.col("batch") == k).drop("batch"))
    return 0 if last is None else last + 1


def batches(events: DataFrame, size: int, order: str = "timestamp") -> DataFrame:
    """Adds ``batch``: events in order, ``size`` to a batch.

    Ranges are sorted apart, written once with their places, and counted, so no
    task sees all rows and both readers see the same places.
    """
    spark, path = events.sparkSession, f"{scratch(events.sparkSession)}/ordered-{uuid.uuid4().hex}"
    events.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    sorted_rows = spark.read.parquet(path)
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = sorted_rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row a partition
    base, before = {}, 0
    for r in sizes:
        base[r["part"]], before = before, before + r["n"]
    offset = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])[part] if base else F.lit(0)
    return sorted_rows.withColumn("batch", F.floor((offset + place) / size).cast("bigint")).drop("_id")


def replayed(events: DataFrame, start: str | None = None, end: str | None = None, types: list[str] | None = None, speed: float = 1.0, time: str = "timestamp", kind: str = "type") -> DataFrame:
    """Events of a time range and of some types, in order, with ``delay_us``: when each is due after the first, at ``speed`` times the pace."""
    at = F.col(time).cast("timestamp")
    rows = events.where(at >= F.lit(start).cast("timestamp")) if start else events
    rows = rows.where(at <= F.lit(end).cast("timestamp")) if end else rows
    rows = rows.where(F.col(kind).isin(*types)) if types else rows
    first = rows.agg(F.min(F.unix_micros(at))).scalar()
    return rows.withColumn("delay_us", F.floor((F.unix_micros(at) - first) / speed).cast("bigint")).orderBy(time)


def subscribed(events: DataFrame, patterns: dict[str, str], key: str = "key") -> DataFrame:
    """subscriber and event, for every subscription whose glob fits the key; ``*`` fits every key."""
    fits = F.array(*[F.when(glob(F.col(key), p) if p != "*" else F.lit(True), F.lit(name)) for name, p in patterns.items()])
    return events.withColumn("subscriber", F.explode(F.array_compact(fits)))


def reconciled(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Two-way sync of tables (key, value, timestamp): the later write of a key wins, the local one where they are equal; origin tells whose it is."""
    both = local.withColumn("origin", F.lit("local")).unionByName(remote.withColumn("origin", F.lit("remote")))
    won = both.groupBy("key").agg(F.max_by(F.struct("value", "timestamp", "origin"), F.struct("timestamp", F.col("origin") == "local")).alias("w"))
    return won.select("key", "w.value", "w.timestamp", "w.origin")
