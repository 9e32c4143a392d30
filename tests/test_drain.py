"""Drained streams lie in files that executors write, whatever the output mode."""

import pytest
from pyspark.sql import functions as F

from lodestone.plans import catalog
from lodestone.streaming import live

SCHEMA = "key string, timestamp timestamp"


def arrived(spark, path, files=3):
    """Files of 40 events of 4 keys, an hour apart."""
    for i in range(files):
        spark.range(40).select(F.concat(F.lit("k"), F.col("id") % 4).alias("key"), F.timestamp_seconds(F.lit(i * 3600) + F.col("id")).alias("timestamp")).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("mode, per_trigger", [("complete", 1), ("complete", 100), ("append", 1), ("append", 100)])
def test_drained_rows_are_read_from_files(spark, tmp_path, mode, per_trigger):
    path = str(tmp_path / "in")
    arrived(spark, path)
    events = live.read(spark, path, SCHEMA, per_trigger)
    out = live.drain(live.windowed(events, "1 minute", "1 second"), f"drained_{mode}_{per_trigger}", mode)
    assert out.inputFiles()
    hours = 3 if mode == "complete" else 2  # no event comes that closes the last windows
    want = sorted((h * 3600, f"k{k}", 10) for h in range(hours) for k in range(4))
    assert sorted((int(r["start"]), r["key"], r["n"]) for r in out.withColumn("start", F.unix_seconds("start")).collect()) == want
    assert spark.table(f"drained_{mode}_{per_trigger}").count() == len(want)


def test_nothing_to_drain(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = live.drain(live.windowed(live.read(spark, str(tmp_path / "in"), SCHEMA), "1 minute", "1 second"), "drained_nothing")
    assert out.columns == ["start", "end", "key", "n"] and out.count() == 0


def test_watermark_windows_are_not_collected(spark, sf_dir):
    assert catalog.QUERIES["stream_watermark_windows"](spark, sf_dir).inputFiles()
