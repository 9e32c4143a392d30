"""SparkSession with the settings that the operators assume."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share, for tables that the engine writes: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local a temporary folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lodestone_scratch", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark._lodestone_scratch = path = "file://" + own
    return path.rstrip("/")


def session(master: str | None = None, name: str = "lodestone", **conf: str) -> SparkSession:
    """UTC times and adaptive execution; ``conf`` keys have underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
