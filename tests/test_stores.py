"""Typed stores, catalogs, checkpoints, engines and hashes on small fixtures with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import values as V
from lodestone.functions.predicates import glob, matches_any
from lodestone.operators import indexes, metrics, shards, typed_store, versions
from lodestone.sources import files
from lodestone.streaming import engine, pipeline


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_whole_matches_end_at_the_end(spark):
    rows = spark.createDataFrame([("key",), ("key\n",), ("a key",)], "key string")
    assert [r["key"] for r in rows.where(matches_any(F.col("key"), ["key"])).collect()] == ["key"]
    assert [r["key"] for r in rows.where(glob(F.col("key"), "k?y")).collect()] == ["key"]
    assert pipeline.routed(rows.withColumn("type", F.lit("x")), [("*", "key", "h", 1)]).count() == 1


def test_hash31_wraps_and_takes_signed_bytes(spark):
    for text in ("", "a", "user:1", "x" * 40, "é日", "\x7f\x00z"):
        want = 0
        for b in text.encode():
            want = (want * 31 + (b - 256 if b > 127 else b)) % (1 << 64)
        assert int(one(spark, V.hash31(F.lit(text)))) == want, text


def test_json_both_ways(spark):
    hard = 'quote " slash \\ feed \n tab \t bell \x07 é'
    text = one(spark, V.json_value("STRING", F.lit(hard)))
    assert text == '{"type":"STRING","value":"quote \\" slash \\\\ feed \\n tab \\t bell \\u0007 é"}'
    assert one(spark, V.json_parsed(F.lit(text))["STRING"]) == hard
    assert one(spark, V.json_value("DOUBLE", F.lit(123.45))) == '{"type":"DOUBLE","value":123.450000000000003}'
    assert one(spark, V.json_value("DOUBLE", F.lit(-0.999999999999999999))) == '{"type":"DOUBLE","value":-1.000000000000000}'
    assert one(spark, V.json_value("MAP", F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == '{"type":"MAP","value":{"a":{"type":"STRING","value":"2"},"b":{"type":"STRING","value":"1"}}}'
    assert one(spark, V.json_parsed(F.lit('{"type":"int","value":7.9}'))["INT"]) == 7
    assert one(spark, V.json_parsed(F.lit("no json"))["type"]) is None


def test_typed_store(spark, tmp_path):
    store = typed_store.TypedStore(spark, str(tmp_path / "typed"))
    store.put("a", "INT", 5)
    store.put("a", "STRING", "five")
    assert store.get("a") == ("STRING", "five") and store.get("none") is None
    t = store.transaction()
    t.put("a", "INT", 6)
    assert t.get("a") == ("STRING", "five")  # not its own writes
    t.put("a", "INT", 7)
    t.commit()
    assert store.get("a") == ("INT", 7)
    (tmp_path / "in.bin").write_bytes(b"\x00\x01\xff")
    store.put_file("file", str(tmp_path / "in.bin"))
    store.get_file("file", str(tmp_path / "out.bin"))
    assert (tmp_path / "out.bin").read_bytes() == b"\x00\x01\xff"
    store.delete("file")
    with pytest.raises(ValueError):
        store.get_file("file", str(tmp_path / "none.bin"))


def test_store_checkpoints_and_changes(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path / "store"))
    store.batch_put([("a", "1"), ("b", "2")])
    first = store.checkpoint("first")
    store.put("a", "3")
    second = store.checkpoint("second", keep=1)
    assert (first, second) == (1, 2) and store.checkpoints() == [2]
    store.delete("a")
    store.restore(second)
    assert {r["key"]: r["value"] for r in versions.latest(store.log).collect()} == {"a": "3", "b": "2"}
    assert [r["key"] for r in store.subscribe("a*", 2).collect()][:2] == ["a", "a"]
    assert store.stats()["keys"] == 2 and store.flush() > 0 and store.min_snapshot() is None
    assert versions.Store(spark, store.path).last() == store.last()


def test_catalog_follows_writes(spark):
    rows = spark.createDataFrame([("u1", "red fox"), ("u2", "blue fox"), ("u3", "red hen")], "key string, value string")
    catalog = indexes.Catalog(rows)
    catalog.create_secondary("value")
    catalog.create_fulltext("words")
    catalog.write(spark.createDataFrame([("u1", "green hen"), ("u2", None), ("u4", "red fox")], "key string, value string"))
    found = lambda name, kind, *terms: sorted(r[0] for r in catalog.lookup(name, kind, *terms).collect())
    assert found("value", "exact", "red fox") == ["u4"] and found("words", "search", "hen") == ["u1", "u3"] and found("words", "search", "blue") == []
    catalog.rebuild("words")
    assert found("words", "search", "hen") == ["u1", "u3"]
    assert {r["name"]: r["entries"] for r in catalog.stats().collect()} == {"value": 3, "words": 6}
    with pytest.raises(ValueError):
        catalog.create_secondary("value")


def test_bounds_change(spark):
    bounds = [(0, "", "m"), (1, "m", "~")]
    assert shards.split(bounds, 1, "t") == [(0, "", "m"), (1, "m", "t"), (2, "t", "~")]
    assert shards.merged(shards.split(bounds, 1, "t"), 1, 2) == bounds
    for bad in (lambda: shards.split(bounds, 0, "z"), lambda: shards.merged([*bounds[:1], (1, "n", "~")], 0, 1)):
        with pytest.raises(ValueError):
            bad()
    rows = spark.createDataFrame([(f"a{i:03d}",) for i in range(100)] + [("z",)], "key string")
    after = shards.rebalanced(rows, bounds, 60)
    assert len(after) == 3 and all(r["n"] <= 80 for r in shards.counts(rows, after).collect())
    assert shards.migrated({0: "n1", 1: "n2"}, 1, "n2", "n3") == {0: "n1", 1: "n3"} and shards.migrated({0: "n1"}, 0, "n9", "n3") == {0: "n1"}


def test_engine_counts_and_handlers(spark):
    events = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(7)], "timestamp bigint, type string")
    ours = engine.Engine()
    ours.register(pipeline.Pipeline("good").filter(F.col("type") == "a"))
    ours.register(pipeline.Pipeline("bad").filter(F.expr("raise_error('x') is null")))
    assert ours.process(events) == {}
    ours.start()
    assert ours.process(events)["good"].count() == 3
    assert ours.stats() == {"good": {"batches": 1, "events": 7, "rows": 3, "failed": 0}, "bad": {"batches": 1, "events": 7, "rows": 0, "failed": 1}}
    with pytest.raises(ValueError):
        ours.register(pipeline.Pipeline("good"))
    ours.unregister("good")
    got = []
    assert engine.handle(events, lambda b: got.append(sorted(r["timestamp"] for r in b.collect())), F.col("type") == "a", 2) == 2
    assert got == [[1, 3], [5]]


def test_alert_handlers_and_metric_texts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 5.0), ("a", 10, 9.0), ("a", 100, 9.0), (None, 5, 9.0)], "g string, at bigint, v double").withColumn("ts", F.timestamp_seconds("at"))
    found = metrics.alerts(rows, ["g"], "ts", F.col("v") > 6, 60)
    assert sorted((r["g"] or "", r["us"]) for r in found.collect()) == [("", 5_000_000), ("a", 10_000_000), ("a", 100_000_000)]
    seen = []
    assert metrics.notify(found, [seen.append, metrics.log_handler(str(tmp_path / "alerts.log"))]) == 3
    assert len(seen) == 3 and len((tmp_path / "alerts.log").read_text().splitlines()) == 3
    assert metrics.as_json({"a": {"b": 1}}) == '{\n  "a": {\n    "b": 1\n  }\n}' and "<td>x&lt;</td><td>2</td>" in metrics.as_html({"x<": 2.0})


def test_replay_numbers_lines_over_file_ranges(spark, tmp_path):
    (tmp_path / "wal").mkdir()
    lines = [f"PUT k{i % 50} value {i}" if i % 7 else f"DEL k{i % 50}" for i in range(3000)]
    (tmp_path / "wal" / "a.log").write_text("\n".join(lines[:2000]) + "\n")
    (tmp_path / "wal" / "b.log").write_text("\n".join(lines[2000:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r["seq"]: (r["key"], r["value"], r["deleted"]) for r in files.replay(spark, str(tmp_path / "wal"), 10).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {10 + i: (f"k{i % 50}", f"value {i}" if i % 7 else None, not i % 7) for i in range(3000)}


def test_ranks_in_large_groups(spark):
    rng = random.Random(3)
    values = {"many": [rng.random() for _ in range(5000)], "few": [1.0] * 700 + [2.0] * 300 + [3.0], "one": [4.5]}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("many", None)], "g string, v double")
    points = [0, 1, 50, 95, 99, 100]
    out = {r["g"]: r for r in metrics.percentiles(rows, ["g"], "v", points).collect()}
    for g, vs in values.items():
        assert out[g]["n"] == len(vs) and [out[g][f"p{p}"] for p in points] == [sorted(vs)[int(p / 100 * (len(vs) - 1))] for p in points]
