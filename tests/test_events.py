"""Event pipelines and windows in batch and streaming form."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import versions
from lodestone.streaming import live, pipeline, windows

EVENTS = [("1", "INSERT", "user_001", "", "Alice"), ("2", "INSERT", "user_002", "", "Bob"), ("3", "INSERT", "product_001", "", "Product A"), ("4", "UPDATE", "user_001", "Alice", "Alice Smith"), ("5", "INSERT", "user_003", "", "Charlie")]


@pytest.fixture(scope="module")
def events(spark):
    df = spark.createDataFrame(EVENTS, "id string, type string, key string, old_value string, new_value string")
    return df.select("*", F.timestamp_seconds(F.col("id").cast("bigint")).alias("timestamp"), F.lit(None).cast("string").alias("transaction_id"), F.lit(None).cast("map<string,string>").alias("metadata"))


@pytest.fixture(scope="module")
def ticks(spark):
    return spark.range(10).select(F.timestamp_millis(F.col("id") * 500).alias("ts"))


def test_pipeline(events):
    seen = []
    p = pipeline.Pipeline("p").filter(F.col("key").contains("user")).map(new_value=F.concat(F.lit("processed_"), "new_value"))
    assert p.apply(events).count() == 4
    p.group_by(F.substring("key", 1, 4)).to(lambda df: seen.append(df.count()))
    assert [tuple(r) for r in p.execute(events).collect()] == [("user", 4)] and seen == [1]
    joined = pipeline.Pipeline().fold("id", "new_value", F.lit(""), lambda acc, x: F.concat(acc, F.substring(x, 1, 1))).execute(events)
    assert joined.first()["new_value"] == "ABPAC"


def test_filter_needs_whole_keys(events):
    assert events.where(pipeline.event_filter(["INSERT"], ["user_.*"])).count() == 3
    assert events.where(pipeline.event_filter(None, ["user"])).count() == 0


def test_windows(ticks):
    assert sorted(r["n"] for r in windows.tumbling(ticks, 1_000_000).collect()) == [2] * 5
    assert [r["n"] for r in windows.sliding(ticks, 2_000_000, 500_000).orderBy("start").collect()] == [4, 4, 4, 4, 4, 4, 4, 3, 2, 1]
    one = windows.sessions(ticks, 500_000).collect()  # a gap that equals the limit does not split
    assert len(one) == 1 and one[0]["n"] == 10 and one[0]["end"] == 4_500_000
    assert windows.sessions(ticks, 499_999).count() == 10 and windows.sessions(ticks, 0).count() == 10


def test_tumbling_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(400).select((F.col("id") % 3).alias("k"), F.timestamp_micros(F.col("id") * F.col("id") % 1009 * 1000).alias("ts"))
        got = sorted(tuple(r) for r in windows.tumbling(df, 50_000, "k").collect())
        want = []
        for k in range(3):
            start, n = None, 0
            for t in sorted(i * i % 1009 * 1000 for i in range(400) if i % 3 == k):
                if start is not None and t >= start + 50_000:
                    want.append((str(k), start, start + 50_000, n))
                    start = None
                if start is None:
                    start, n = t, 0
                n += 1
            want.append((str(k), start, start + 50_000, n))
        assert got == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_interval_join(spark):
    left = spark.createDataFrame([("a", 10), ("a", 100), ("b", 10)], "key string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    right = spark.createDataFrame([("a", 5), ("a", 10), ("a", 11), ("a", 4), ("c", 9)], "key string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["l_s"], r["r_s"]) for r in windows.interval_join(left, right, "key", 5_000_000).collect()}
    assert got == {(10, 5), (10, 10)}


def test_routing(events):
    got = pipeline.routed(events, [("UPDATE", ".*", "audit", 1), ("*", "user_00[12]", "mirror", 5)]).orderBy("id", F.desc("priority")).select("id", "handler").collect()
    assert [tuple(r) for r in got] == [("1", "mirror"), ("2", "mirror"), ("4", "mirror"), ("4", "audit")]


def timed(spark, path):
    rows = [(str(i), k, t) for i, (k, t) in enumerate([("a", 0), ("a", 4), ("a", 11), ("b", 3), ("a", 30), ("b", 9), ("z", 1000)])]
    rows = [(i, k, t + 960) for i, k, t in rows]
    df = spark.createDataFrame(rows, "id string, key string, t bigint").select(
        "id", F.lit("INSERT").alias("type"), "key", F.lit("").alias("old_value"), F.col("id").alias("new_value"), F.timestamp_seconds("t").alias("timestamp"),
        F.lit("").alias("transaction_id"), F.create_map().cast("map<string,string>").alias("metadata"),
    )
    df.write.mode("append").parquet(path)
    return df


def test_streaming_forms_equal_batch_forms(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = timed(spark, path).where("key <> 'z'")  # z only drives the watermark on
    late = "1 second"
    got = live.drain(live.sessions(live.read(spark, path), 5_000_000, late), "sessions").where("key <> 'z'")
    want = windows.sessions(batch, 5_000_000, "key", "timestamp")
    assert {(r["key"], r["n"]) for r in got.collect()} == {(r["key"], r["n"]) for r in want.collect()} and got.count() == want.count()
    got = live.drain(live.tumbling(live.read(spark, path), 10_000_000, late), "tumbling").where("key <> 'z'")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in windows.tumbling(batch, 10_000_000, "key", "timestamp").collect()}
    got = live.drain(live.windowed(live.read(spark, path), "10 seconds", late), "windowed").where("key <> 'z'")
    assert {(r["key"], r["start"].second, r["n"]) for r in got.collect()} == {("a", 0, 2), ("a", 10, 1), ("a", 30, 1), ("b", 0, 2)}


def test_sync_upserts_and_retries(spark, tmp_path):
    path, tries = str(tmp_path / "in"), []
    timed(spark, path)
    store = versions.Store(spark, str(tmp_path / "store"))

    def flaky(changes):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("away")
        store.append(changes)

    live.sync(live.read(spark, path), [flaky], str(tmp_path / "cp")).awaitTermination()
    assert {r["key"]: r["value"] for r in versions.latest(store.log).collect()} == {"a": "4", "b": "5", "z": "6"} and len(tries) == 3
