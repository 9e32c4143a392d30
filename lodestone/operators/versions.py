"""A version log (key, seq, value, deleted) and its reads: latest, as of a snapshot, ranges, history.

A tombstone hides older versions; the empty string is a value.  Writes append
rows; nothing is changed in place, so an older snapshot always reads the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import glob

SCHEMA = "key string, seq bigint, value string, deleted boolean"


def latest(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """key, seq, value of the newest visible version: one aggregation, combined on the map side."""
    if snapshot is not None:
        log = log.where(F.col("seq") <= snapshot)
    newest = log.groupBy("key").agg(F.max(F.struct("seq", "deleted", "value")).alias("v"))
    return newest.where(~F.col("v.deleted")).select("key", "v.seq", "v.value")


def get(log: DataFrame, key: str, snapshot: int | None = None) -> DataFrame:
    return latest(log.where(F.col("key") == key), snapshot).select("key", "value")


def exists(log: DataFrame, key: str, snapshot: int | None = None) -> DataFrame:
    """One row: found."""
    return get(log, key, snapshot).agg((F.count(F.lit(1)) > 0).alias("found"))


def multi_get(log: DataFrame, keys: DataFrame | list[str], snapshot: int | None = None) -> DataFrame:
    """ordinal, key, value; keys keep their order and repeats, misses are left out."""
    if not isinstance(keys, DataFrame):
        keys = log.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], "ordinal bigint, key string")
    wanted = keys.select("key").distinct()
    return keys.join(latest(log.join(wanted, "key", "left_semi"), snapshot).select("key", "value"), "key").select("ordinal", "key", "value")


def in_range(log: DataFrame, start: str = "", end: str = "", open_end: bool = True, snapshot: int | None = None) -> DataFrame:
    """Keys from start to end, both included.  An empty end is no bound if ``open_end``, else fits nothing."""
    rows = log.where(F.col("key") >= start) if start else log
    if end or not open_end:
        rows = rows.where(F.col("key") <= end)
    return latest(rows, snapshot).select("key", "value")


def range_scan(log: DataFrame, start: str, end: str, limit: int = 0, snapshot: int | None = None) -> DataFrame:
    rows = in_range(log, start, end, False, snapshot).orderBy("key")
    return rows.limit(limit) if limit else rows


def prefix_scan(log: DataFrame, prefix: str, limit: int = 0, snapshot: int | None = None) -> DataFrame:
    rows = latest(log.where(F.col("key").startswith(prefix)), snapshot).select("key", "value").orderBy("key")
    return rows.limit(limit) if limit else rows


def seek(log: DataFrame, target: str = "", snapshot: int | None = None):
    """A cursor of (key, value) from the first key not below ``target``; rows arrive partition by partition."""
    return ((r["key"], r["value"]) for r in in_range(log, target, "", True, snapshot).orderBy("key").toLocalIterator())


def history(log: DataFrame, key: str) -> DataFrame:
    return log.where(F.col("key") == key).orderBy("seq")


def merge(*runs: DataFrame) -> DataFrame:
    """Several sorted runs as one log; the newest version of a key wins on reading."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def compacted(log: DataFrame, min_snapshot: int | None = None) -> DataFrame:
    """What a rewrite keeps: each key's newest version, and all that a live snapshot may read.

    With the least live snapshot s, versions above s stay and so does the newest
    one at or below s; a tombstone that is the newest at or below s goes.
    """
    bound = F.lit(min_snapshot).cast("bigint") if min_snapshot is not None else F.lit(None).cast("bigint")
    old = F.coalesce(F.col("seq") <= bound, F.lit(min_snapshot is None))
    newest = log.where(old).groupBy("key").agg(F.max(F.struct("seq", "deleted", "value")).alias("v")).where(~F.col("v.deleted"))
    kept = newest.select("key", "v.seq", "v.value", "v.deleted")
    return kept.unionByName(log.where(~old).select("key", "seq", "value", "deleted"))


def visible(versions: DataFrame, at: int) -> DataFrame:
    """MVCC: committed versions created at or before ``at`` and not deleted by then, newest per key."""
    seen = versions.where(F.col("committed") & (F.col("create_ts") <= at) & ((F.col("delete_ts") == 0) | (F.col("delete_ts") > at)))
    newest = seen.groupBy("key").agg(F.max(F.struct("create_ts", "value")).alias("v"))
    return newest.select("key", "v.create_ts", "v.value")


def collected(versions: DataFrame, min_active: int) -> DataFrame:
    """MVCC clean-up: all but superseded versions that no transaction from ``min_active`` on can read."""
    newest = Window.partitionBy("key").orderBy(F.desc("create_ts"))
    ranked = versions.withColumn("_place", F.row_number().over(newest))
    stale = (F.col("_place") > 1) & (F.col("create_ts") < min_active) & ((F.col("delete_ts") == 0) | (F.col("delete_ts") < min_active))
    return ranked.where(~stale).drop("_place")


def version_stats(versions: DataFrame) -> DataFrame:
    """keys and versions; with a transaction column also the open transactions and the oldest one's first version."""
    counts = [F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("versions")]
    if "txn" in versions.columns:
        counts += [F.count_distinct(F.when(~F.col("committed"), F.col("txn"))).alias("active"), F.min(F.when(~F.col("committed"), F.col("create_ts"))).alias("oldest")]
    return versions.agg(*counts)


# Writes of MVCC transactions: each gives the versions (key, create_ts, value, delete_ts, committed, txn) after it.


def written(versions: DataFrame, rows: DataFrame, txn: int, at: int) -> DataFrame:
    """New versions of ``rows`` (key, value), not committed yet."""
    fresh = rows.select("key", F.lit(at).cast("bigint").alias("create_ts"), "value", F.lit(0).cast("bigint").alias("delete_ts"), F.lit(False).alias("committed"), F.lit(txn).cast("bigint").alias("txn"))
    return versions.select(*fresh.columns).unionByName(fresh)


def removed(versions: DataFrame, keys: DataFrame, at: int) -> DataFrame:
    """The newest version of each of the keys is marked as deleted at that time."""
    newest = versions.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max("create_ts").alias("_newest"))
    marked = versions.join(newest, "key", "left").withColumn("delete_ts", F.when(F.col("create_ts") == F.col("_newest"), F.lit(at).cast("bigint")).otherwise(F.col("delete_ts")))
    return marked.select(*versions.columns)


def committed(versions: DataFrame, txn: int) -> DataFrame:
    return versions.withColumn("committed", F.col("committed") | (F.col("txn") == txn))


def aborted(versions: DataFrame, txn: int) -> DataFrame:
    """Without the transaction's versions that are not committed."""
    return versions.where(F.col("committed") | (F.col("txn") != txn))


class Store:
    """A version log in a Parquet folder: appends, snapshots, transactions and rewrites (one writer)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.snapshots, self._last = spark, path.rstrip("/"), [], None
        self.current = f"{self.path}/log-0"
        if logs := sorted((n for n in self._names() if n.startswith("log-")), key=lambda n: int(n[4:])):
            self.current = f"{self.path}/{logs[-1]}"
        else:
            spark.createDataFrame([], SCHEMA).write.parquet(self.current)

    def _folder(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        folder, fs = self._folder(self.path)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _delete(self, path: str) -> None:
        folder, fs = self._folder(path)
        fs.delete(folder, True)

    @property
    def log(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.current)

    def last(self) -> int:
        """The last sequence number: the log is asked once, then this one writer counts on."""
        if self._last is None:
            self._last = self.log.agg(F.max("seq")).first()[0] or 0
        return self._last

    def append(self, rows: DataFrame, size: int | None = None) -> None:
        """key, value, deleted, ordinal: one atomic append; seq follows the last one in ordinal order.

        ``size`` is one more than the largest ordinal, where the caller knows it.
        """
        base = self.last()
        rows.select("key", (F.col("ordinal") + F.lit(base + 1)).cast("bigint").alias("seq"), "value", "deleted").write.mode("append").parquet(self.current)
        self._last = base + size if size is not None else None

    def _rows(self, ops: list[tuple[str, str | None, bool]]) -> None:
        rows = [(k, v, d, i) for i, (k, v, d) in enumerate(ops)]
        if rows:
            self.append(self.spark.createDataFrame(rows, "key string, value string, deleted boolean, ordinal bigint"), len(rows))

    def put(self, key: str, value: str) -> None:
        self._rows([(key, value, False)])

    def delete(self, key: str) -> None:
        self._rows([(key, None, True)])

    def batch_put(self, pairs) -> None:
        self._rows([(k, v, False) for k, v in pairs])

    def batch_delete(self, keys) -> None:
        self._rows([(k, None, True) for k in keys])

    def batch_execute(self, ops) -> None:
        """('PUT', key, value) and ('DELETE', key) in order."""
        self._rows([(op[1], op[2], False) if op[0].upper() == "PUT" else (op[1], None, True) for op in ops])

    def load(self, rows: DataFrame) -> None:
        """Bulk put of a table (key, value) with distinct keys: one sequence number for all."""
        self.append(rows.select("key", "value", F.lit(False).alias("deleted"), F.lit(0).alias("ordinal")), 1)

    def snapshot(self) -> int:
        self.snapshots.append(self.last())
        return self.snapshots[-1]

    def release(self, snapshot: int) -> None:
        self.snapshots.remove(snapshot)

    def compact(self) -> None:
        """Rewrite into key-ranged, sorted files; the old log stays until the new one is whole."""
        number = int(self.current.rsplit("-", 1)[1]) + 1
        kept = compacted(self.log, min(self.snapshots) if self.snapshots else None)
        target = f"{self.path}/log-{number}"
        kept.repartitionByRange("key").sortWithinPartitions("key", "seq").write.parquet(target)
        old, self.current = self.current, target
        self._delete(old)

    def min_snapshot(self) -> int | None:
        return min(self.snapshots, default=None)

    def flush(self) -> int:
        """Appends are durable when they return, so there is nothing to write; gives the number of files of the log."""
        return len(self.log.inputFiles())

    def stats(self) -> dict[str, int]:
        row = self.log.agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("key").alias("keys"), F.max("seq").alias("last")).first()
        return {"versions": row["versions"], "keys": row["keys"], "last": row["last"] or 0, "snapshots": len(self.snapshots)}

    def subscribe(self, pattern: str = "*", after: int = 0) -> DataFrame:
        """Changes of the keys that a glob matches, behind a sequence number, in order."""
        return self.log.where((F.col("seq") > after) & glob(F.col("key"), pattern)).orderBy("seq")

    # Checkpoints: whole tables beside the log, each in a folder of its own with its number and description.

    def checkpoint(self, description: str = "", keep: int = 0) -> int:
        """Write the newest versions as a checkpoint and give its number; with ``keep`` only so many of the last stay."""
        number = max(self.checkpoints(), default=0) + 1
        latest(self.log).withColumn("description", F.lit(description)).write.parquet(f"{self.path}/checkpoint-{number}")
        for old in sorted(self.checkpoints())[:-keep] if keep else []:
            self._delete(f"{self.path}/checkpoint-{old}")
        return number

    def checkpoints(self) -> list[int]:
        return sorted(int(n.rsplit("-", 1)[1]) for n in self._names() if n.startswith("checkpoint-"))

    def restore(self, number: int) -> None:
        """Append what brings the store back to a checkpoint: its rows, and tombstones for keys that it lacks."""
        then = self.spark.read.parquet(f"{self.path}/checkpoint-{number}").select("key", "value")
        gone = latest(self.log).join(then, "key", "left_anti").select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted"))
        back = then.withColumn("deleted", F.lit(False)).unionByName(gone)
        self.append(back.withColumn("ordinal", F.lit(0)), 1)

    def transaction(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Writes wait for commit; reads see the store, not the waiting writes."""

    def __init__(self, store: Store):
        self.store, self.ops = store, []

    def put(self, key, value):
        self.ops.append(("PUT", key, value))

    def delete(self, key):
        self.ops.append(("DELETE", key))

    def get(self, key):
        row = get(self.store.log, key).first()
        return row and row["value"]

    def commit(self):
        if self.ops:
            self.store.batch_execute(self.ops)
        self.ops = []

    def rollback(self):
        self.ops = []
