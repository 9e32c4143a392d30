"""Windows and interval joins over events, anchored at the data, for batch tables.

``key`` names the grouping column; without one all events are one group, as
where a whole pipeline shares its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def micros(time: str = "ts"):
    return F.unix_micros(F.col(time).cast("timestamp"))


def _keyed(events: DataFrame, key: str | None, time: str) -> DataFrame:
    """key, us, n: equal times of a key are one row, combined on the map side."""
    name = F.col(key).cast("string") if key else F.lit("default")
    return events.select(name.alias("key"), micros(time).alias("us")).where("us is not null").groupBy("key", "us").agg(F.count(F.lit(1)).alias("n"))


def tumbling(events: DataFrame, size_us: int, key: str | None = None, time: str = "ts") -> DataFrame:
    """key, start, end, n: a window opens at the first event at or after the end of the last one.

    Each window depends on the one before, so a key's sorted times are streamed
    through one task; the task holds a batch and the open window, and jumps from
    window to window by binary search.
    """

    def run(batches):
        key = start = None
        count = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            us, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            total = np.concatenate([[0], np.cumsum(n)])
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if start is not None and names[a] != key:
                    out.append((key, start, count))
                    start = None
                key, at = names[a], a
                while at < b:
                    if start is None:
                        start, count = int(us[at]), 0
                    to = a + int(np.searchsorted(us[a:b], start + size_us))
                    count += int(total[to] - total[at])
                    at = to
                    if to < b:
                        out.append((key, start, count))
                        start = None
            yield _windows(out, size_us)
        if start is not None:
            yield _windows([(key, start, count)], size_us)

    spread = _keyed(events, key, time).repartition("key").sortWithinPartitions("key", "us")
    return spread.select("key", "us", "n").mapInArrow(run, "key string, start bigint, `end` bigint, n bigint")


def _windows(rows, size_us):
    keys, starts, counts = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(starts, pa.int64()), pa.array([s + size_us for s in starts], pa.int64()), pa.array(counts, pa.int64())], ["key", "start", "end", "n"])


def sliding(events: DataFrame, size_us: int, slide_us: int = 0, time: str = "ts") -> DataFrame:
    """start, end, n: windows from the first event on, ``slide_us`` apart (0: their size); empty ones are left out."""
    slide = slide_us or size_us
    rows = _keyed(events, None, time)
    rows = rows.withColumn("first", rows.agg(F.min("us")).scalar())
    away = F.col("us") - F.col("first")
    # windows k with k * slide <= away < k * slide + size
    least = F.greatest(F.lit(0), F.floor((away - size_us) / slide) + 1).cast("bigint")
    most = F.floor(away / slide).cast("bigint")
    each = rows.where(least <= most)
    each = each.select("first", "n", F.explode(F.sequence(least, most)).alias("k"))
    start = F.col("first") + F.col("k") * slide
    return each.groupBy(start.alias("start")).agg(F.sum("n").alias("n")).select("start", (F.col("start") + size_us).alias("end"), "n")


def sessions(events: DataFrame, gap_us: int, key: str | None = None, time: str = "ts") -> DataFrame:
    """key, start, end, n: a new session where the gap is more than ``gap_us``; it ends with its last event."""
    rows = _keyed(events, key, time).withColumn("t", F.timestamp_micros("us"))
    if gap_us <= 0:  # equal times are one row already
        return rows.select("key", F.col("us").alias("start"), F.col("us").alias("end"), "n")
    window = F.session_window("t", f"{gap_us} microseconds")  # sessions that touch are merged
    return rows.groupBy("key", window).agg(F.min("us").alias("start"), F.max("us").alias("end"), F.sum("n").alias("n")).select("key", "start", "end", "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, window_us: int, left_time: str = "ts", right_time: str = "ts") -> DataFrame:
    """Inner join on the key with the right event at most ``window_us`` before the left one.

    Times are cut into cells of the window, so a key's events meet only those of
    the same or the next cell.  Columns come back with l_ and r_ in front.
    """
    cell = F.lit(max(1, window_us))
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], micros(left_time).alias("_l"))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], micros(right_time).alias("_r"))
    l = l.withColumn("_own", F.floor(F.col("_l") / cell)).withColumn("_cell", F.explode(F.array(F.col("_own") - 1, F.col("_own"))))
    r = r.withColumn("_rcell", F.floor(F.col("_r") / cell))
    inside = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col("_cell") == F.col("_rcell")) & F.col("_r").between(F.col("_l") - window_us, F.col("_l"))
    return l.join(r, inside).drop("_l", "_r", "_own", "_cell", "_rcell")
