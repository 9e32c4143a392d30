"""Plumbing that the operators share: durable tables, row keys, worker caches."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests in one
    process) a temporary folder is made; executors elsewhere could not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lodestone_dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
        spark._lodestone_dir = path
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone at exit; a left table is harmless
        pass


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage so that a lost executor costs only the tasks after the table,
    and fixes the rows that a non-deterministic input would otherwise redraw.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    atexit.register(_delete, spark, path)
    return out


def forget(df: DataFrame) -> None:
    """Delete a table that :func:`durable` wrote and that no plan reads any more."""
    if path := getattr(df, "_lodestone_path", None):
        _delete(df.sparkSession, path)


def worker_cache(key, make):
    """A value kept for the life of a Python worker, made on first use."""
    kept = sys.__dict__.setdefault("_lodestone_cache", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def worker(run, rows: int = 1024):
    """``run`` over slices of ``rows`` rows, so that a large batch is not worked on (or sent back) whole.

    When a task ends, its worker gives freed memory back to the system: workers
    are kept for later tasks, beside which it would count.
    """

    def wrapped(batches):
        try:
            yield from run(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))
        finally:
            import ctypes

            import pyarrow

            pyarrow.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


#: Bytes of an Arrow batch at about most, where the session has Spark's default of 64 MiB.
BATCH_BYTES = 4 << 20


def arrow(df: DataFrame, run, schema, rows: int = 1024) -> DataFrame:
    """``df.mapInArrow`` of :func:`worker`'s ``run`` over batches that are bounded in bytes, not only in rows."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name).rstrip("b") == str(64 << 20):
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(worker(run, rows), schema)


def small(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than limit + 1."""
    return df.limit(limit + 1).count() <= limit


#: Rows of a class from which on it is looked up apart, and such classes up to which they are broadcast.
HEAVY, BROADCAST_CLASSES, SALT = 1000, 10_000, 32


def looked_up(rows: DataFrame, told: DataFrame, members: str) -> DataFrame:
    """``rows`` with what ``told`` (k and others) says of their ``key``; nulls where it says nothing.

    Rows without a key, and those of a class with many ``members``, are not
    gathered in one task: the few heavy classes are broadcast, else salted.
    """
    some, heavy = rows.where("key is not null"), F.col(members) > HEAVY
    hot, cold = told.where(heavy), told.where(~heavy)
    if small(hot, BROADCAST_CLASSES):
        held = some.join(F.broadcast(hot), F.col("key") == F.col("k"))
        rest = some.join(F.broadcast(hot.select("k")), F.col("key") == F.col("k"), "left_anti").join(cold, F.col("key") == F.col("k"), "left")
        out = held.unionByName(rest)
    else:
        salted = told.withColumn("salt", F.explode(F.when(heavy, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))))
        listed = hot.select(F.col("k").alias("hot_key")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        dealt = some.withColumn("deal", F.floor(F.rand(7) * SALT).cast("int"))
        marked = dealt.join(listed, (F.col("key") == F.col("hot_key")) & (F.col("deal") == F.col("salt")), "left").drop("salt")
        marked = marked.withColumn("own", F.when(F.col("hot_key").isNotNull(), F.col("deal")).otherwise(F.lit(0)))
        out = marked.join(salted, (F.col("key") == F.col("k")) & (F.col("own") == F.col("salt")), "left").drop("salt", "own", "deal", "hot_key")
    return out.unionByName(rows.where("key is null"), allowMissingColumns=True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
