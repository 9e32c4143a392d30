"""Structured Streaming forms of the event operators: watermarks bound their state.

The input needs a ``timestamp`` column of type TIMESTAMP.  Results are final
once the watermark has passed, and then equal those of the batch forms, but for
windows anchored at the data, which late events cannot reopen.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch
from .pipeline import EVENT


def read(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int = 100) -> DataFrame:
    """Events from a growing Parquet folder; ``files_per_trigger`` holds back instead of dropping."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def sessions(events: DataFrame, gap_us: int, lateness: str, key: str = "key") -> DataFrame:
    window = F.session_window("timestamp", f"{gap_us} microseconds")
    grouped = events.withWatermark("timestamp", lateness).groupBy(key, window)
    return grouped.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("n")).select(key, "first", "last", "n")


def windowed(events: DataFrame, size: str, lateness: str, slide: str | None = None, key: str = "key") -> DataFrame:
    window = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    return events.withWatermark("timestamp", lateness).groupBy(window, key).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", key, "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, width: str, lateness: str) -> DataFrame:
    """Inner join with the right event at most ``width`` before the left one."""
    l = left.withWatermark("timestamp", lateness).alias("l")
    r = right.withWatermark("timestamp", lateness).alias("r")
    return l.join(r, F.expr(f"l.`{key}` = r.`{key}` AND r.timestamp BETWEEN l.timestamp - INTERVAL {width} AND l.timestamp"))


def tumbling(events: DataFrame, size_us: int, lateness: str, key: str = "key") -> DataFrame:
    """Windows anchored at each key's data: state is the times that the watermark has not passed and the open window."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, count, waiting = state.get if state.exists else (None, 0, [])
        waiting = [*waiting, *[int(t.value // 1000) for b in batches for t in b["timestamp"]]]
        mark = state.getCurrentWatermarkMs() * 1000
        ready, rows = sorted(t for t in waiting if t < mark), []
        for t in ready:
            if start is not None and t >= start + size_us:
                rows.append((name[0], start, start + size_us, count))
                start = None
            if start is None:
                start, count = t, 0
            count += 1
        if start is not None and start + size_us <= mark:
            rows.append((name[0], start, start + size_us, count))
            start, count = None, 0
        waiting = [t for t in waiting if t >= mark]
        if start is None and not waiting:
            state.remove()
        else:
            state.update((start, count, waiting))
            state.setTimeoutTimestamp(max(mark // 1000 + 1, min([*waiting, *([start + size_us] if start is not None else [])]) // 1000 + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["key", "start", "end", "n"])

    timed = events.withWatermark("timestamp", lateness).select(F.col(key).alias("key"), "timestamp")
    return timed.groupBy("key").applyInPandasWithState(
        run, "key string, start bigint, `end` bigint, n bigint", "start bigint, count bigint, waiting array<bigint>", "append", "EventTimeTimeout"
    )


def latest_changes(batch: DataFrame) -> DataFrame:
    """The last change of each key in a micro-batch, as rows of a version log."""
    last = batch.groupBy("key").agg(F.max(F.struct("timestamp", "id", "type", "new_value")).alias("e"))
    return last.select("key", F.when(F.col("e.type") == "DELETE", None).otherwise(F.col("e.new_value")).alias("value"), (F.col("e.type") == "DELETE").alias("deleted"), F.lit(0).alias("ordinal"))


def sync(events: DataFrame, targets: list[Callable[[DataFrame], None]], checkpoint: str, attempts: int = 3) -> StreamingQuery:
    """Send each micro-batch's changes to every target, ``attempts`` times before it fails."""

    def send(batch: DataFrame, number: int) -> None:
        changes = latest_changes(batch)
        for target in targets:
            for left in range(attempts - 1, -1, -1):
                try:
                    target(changes)
                    break
                except Exception:
                    if not left:
                        raise

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming table to the end of what is there, into Parquet files below :func:`lodestone.session.scratch`; ``name`` is a view of them.

    Executors write each micro-batch into a folder of its number, over what a failed attempt left
    there; a batch in complete mode holds the whole result and takes the place of the one before.
    """
    spark, path, folders = stream.sparkSession, f"{scratch(stream.sparkSession)}/drained-{uuid.uuid4().hex}", []

    def put(batch: DataFrame, number: int) -> None:
        folder = f"{path}/rows/{0 if mode == 'complete' else number}"
        batch.write.mode("overwrite").parquet(folder)
        if folder not in folders:
            folders.append(folder)

    query = stream.writeStream.foreachBatch(put).queryName(name).option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(*folders) if folders else spark.createDataFrame([], stream.schema)
    out.createOrReplaceTempView(name)
    return out
