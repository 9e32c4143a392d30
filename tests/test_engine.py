"""Key-value engine on small fixtures with known answers."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import values as V
from lodestone.functions.predicates import Condition, glob, number
from lodestone.operators import indexes, metrics, schemas, shards, text_index, typed, versions
from lodestone.operators.query import QueryEngine
from lodestone.plans.commands import Interpreter
from lodestone.sources import files


def kv(spark, pairs):
    return spark.createDataFrame(list(pairs.items()), "key string, value string")


def keys(df):
    return [r["key"] for r in df.collect()]


@pytest.fixture
def store(spark, tmp_path):
    return versions.Store(spark, str(tmp_path / "store"))


def one(df):
    row = df.first()
    return row and row["value"]


# Versions


def test_batches_and_deletes(store):
    store.batch_put([("user:1", "Alice"), ("user:2", "Bob"), ("score:2", "87")])
    assert [(r["ordinal"], r["value"]) for r in versions.multi_get(store.log, ["user:2", "none", "user:1", "user:2"]).orderBy("ordinal").collect()] == [(0, "Bob"), (2, "Alice"), (3, "Bob")]
    store.batch_delete(["user:2", "score:2"])
    assert versions.multi_get(store.log, ["user:2", "score:2"]).count() == 0
    store.put("user:2", "")  # the empty string is a value
    assert one(versions.get(store.log, "user:2")) == ""
    assert versions.exists(store.log, "user:2").first()["found"] and not versions.exists(store.log, "x").first()["found"]


def test_snapshots_see_the_past(store):
    store.batch_put([("a", "1"), ("b", "2")])
    at = store.snapshot()
    store.batch_execute([("PUT", "a", "3"), ("DELETE", "b"), ("PUT", "c", "5")])
    assert {r["key"]: r["value"] for r in versions.latest(store.log, at).collect()} == {"a": "1", "b": "2"}
    assert {r["key"]: r["value"] for r in versions.latest(store.log).collect()} == {"a": "3", "c": "5"}
    assert keys(versions.range_scan(store.log, "a", "c")) == ["a", "c"] and keys(versions.range_scan(store.log, "a", "")) == []
    store.compact()  # the snapshot still reads its versions
    assert one(versions.get(store.log, "b", at)) == "2" and one(versions.get(store.log, "a", at)) == "1"
    store.release(at)
    store.compact()
    assert store.log.count() == 2
    again = versions.Store(store.spark, store.path)
    assert one(versions.get(again.log, "a")) == "3"


def test_transactions_wait_for_commit(store):
    store.put("k", "old")
    t = store.transaction()
    t.put("k", "new")
    t.delete("gone")
    assert t.get("k") == "old"
    t.commit()
    assert t.get("k") == "new"
    t.put("k", "never")
    t.rollback()
    t.commit()
    assert t.get("k") == "new"


def test_cursor_and_prefix(store):
    store.load(store.spark.createDataFrame([("a:1", "x"), ("a:2", "y"), ("b:1", "z")], "key string, value string"))
    assert list(versions.seek(store.log, "a:2")) == [("a:2", "y"), ("b:1", "z")]
    assert keys(versions.prefix_scan(store.log, "a:", 1)) == ["a:1"]


def test_mvcc(spark):
    rows = [("k", 1, "a", 0, True), ("k", 5, "b", 9, True), ("k", 7, "c", 0, False)]
    v = spark.createDataFrame(rows, "key string, create_ts bigint, value string, delete_ts bigint, committed boolean")
    assert one(versions.visible(v, 6)) == "b" and one(versions.visible(v, 9)) == "a" and one(versions.visible(v, 0)) is None
    assert {r["create_ts"] for r in versions.collected(v, 6).collect()} == {7, 5}


# Predicates and aggregates


@pytest.mark.parametrize(
    ("pattern", "fits", "not_fits"),
    [("a.b*", "a.bc", "axbc"), ("user:(1)?", "user:(1)9", "user:(1)"), ("user:", "user:1", "xuser:1"), ("*x", "\tx", "x\nx"), ("a\\*", "a\\b", "ab"), ("", "any", None), ("[a-c]*", "[a-c]d", "b"), ("é?", "éa", "éab"), ("a?", "ab", "ab\n")],
)
def test_globs(spark, pattern, fits, not_fits):
    df = spark.createDataFrame([(fits, True), (not_fits, False)], "s string, want boolean").where("s is not null")
    assert all(r["got"] == r["want"] for r in df.select("want", glob(F.col("s"), pattern).alias("got")).collect())


def test_leading_numbers(spark):
    given = {"12abc": 12.0, '"7.5"': 7.5, "1e3": 1000.0, " -2": -2.0, "inf": None, "": None, "x1": None, ".5": 0.5, '"': None, "3.": 3.0}
    df = spark.createDataFrame([(k,) for k in given], "s string")
    assert {r["s"]: r["n"] for r in df.select("s", number(F.col("s")).alias("n")).collect()} == given


def test_conditions(spark):
    e = QueryEngine(kv(spark, {"product:1": "laptop", "product:2": "mouse", "product:3": "keyboard", "price:1": "1200", "price:2": "25", "price:3": "80", "category:electronics": "active"}))
    assert e.where(Condition("key", "LIKE", "product:*")).count() == 3
    assert e.where(Condition("value", "=", "active")).count() == 1
    assert e.where(Condition("value", ">", "50")).count() == 6  # two numbers, and words that sort behind "50"
    assert keys(e.where(Condition("value", "<", "100"), 1)) == ["price:2"]
    assert e.where_multiple([], False).count() == 7
    with pytest.raises(ValueError):
        Condition("value", "~", "x").column()


def test_aggregates(spark):
    e = QueryEngine(kv(spark, {"score:math:1": "95", "score:math:2": "87", "score:math:3": "92", "score:english:1": "88", "score:english:2": "91", "temperature:1": "23.5", "temperature:2": "25.0", "temperature:3": "22.8"}))
    assert e.count().first()["count"] == 8
    s = e.sum_values("score:math:*").first()
    assert (s["count"], s["sum"], round(s["avg"], 3)) == (3, 274.0, 91.333)
    m = e.min_max_values("temperature:*").first()
    assert (m["min"], m["max"], m["count"], round(m["sum"], 6)) == (22.8, 25.0, 3, 71.3)
    assert tuple(e.aggregate("none*").first()) == (0, 0.0, 0.0, 0.0, 0.0)


def test_ordered_scans(spark):
    e = QueryEngine(kv(spark, {"item:c": "third", "item:a": "first", "item:b": "second", "item:d": "fourth"}))
    assert keys(e.scan_ordered("item:", "item:z")) == ["item:a", "item:b", "item:c", "item:d"]
    assert keys(e.scan_ordered("item:", "item:z", True)) == ["item:d", "item:c", "item:b", "item:a"]
    assert keys(e.scan_ordered("item:", "item:z", True, 2)) == ["item:b", "item:a"]
    assert keys(e.scan_ordered("item:", "item:z", True, 2, top_k=True)) == ["item:d", "item:c"]
    assert keys(e.prefix_scan_ordered("item:", True, 3)) == ["item:c", "item:b", "item:a"]


# Typed values


def test_typed_values(spark):
    src = spark.createDataFrame([(1,)], "x int")
    parts = [("num1", "INT", F.lit(100)), ("num2", "INT", F.lit(200)), ("str1", "STRING", F.lit("hello")), ("float1", "FLOAT", F.lit(1.5)), ("s1", "SET", F.array(F.lit("red"), F.lit("blue"), F.lit("red"))), ("s2", "SET", F.array(F.lit("blue"), F.lit("green"))), ("m", "MAP", F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))), ("b", "BLOB", F.lit(b"12345"))]
    rows = typed.rows(src, F.lit("l"), "LIST", F.array(F.lit("x"), F.lit("y")))
    for k, kind, v in parts:
        rows = rows.unionByName(typed.rows(src, F.lit(k), kind, v))
    assert keys(typed.type_scan(rows, "int")) == ["num1", "num2"]
    assert keys(typed.numeric_range(rows, 1, 150)) == ["num1", "float1"]
    shown = {r["key"]: r["text"] for r in typed.text(rows).collect()}
    assert shown == {"num1": "100", "num2": "200", "str1": "hello", "float1": "1.500000", "s1": "{blue, red}", "s2": "{blue, green}", "m": "{a: 1, b: 2}", "b": "BLOB(5 bytes)", "l": "[x, y]"}
    pick = lambda op, b="s2": [r["set"] for r in typed.set_operation(rows, "s1", b, "out", op).collect()]
    assert pick("union") == [["blue", "green", "red"]] and pick("intersection") == [["blue"]] and pick("difference") == [["red"]]
    assert pick("union", "num1") == [] and pick("union", "none") == []
    asked = spark.createDataFrame([("m",), ("none",)], "key string")
    assert {r["key"]: r["type"] for r in typed.key_type(rows, asked).collect()} == {"m": "MAP", "none": "NULL"}


def test_value_functions(spark):
    a = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    m = F.create_map(F.lit("k"), F.lit("1"))
    row = spark.range(1).select(
        V.list_remove(a, 1).alias("removed"), V.list_remove(a, 9).alias("same"), V.list_set(a, 0, F.lit("z")).alias("set"), V.set_add(a, F.lit("a")).alias("added"),
        V.map_put(m, F.lit("k"), F.lit("2")).alias("put"), V.map_remove(m, F.lit("k")).alias("none"), V.convert(F.lit("42x"), "STRING", "INT").alias("i"),
        V.convert(F.lit(-1.9), "DOUBLE", "INT").alias("t"), V.parse_date(F.lit("2024/1/5")).cast("string").alias("d"), V.parse_timestamp(F.lit("bad")).alias("bad"), V.key_pattern(F.lit("u_1_x22")).alias("p"),
    ).first()
    assert (row["removed"], row["same"], row["set"], row["added"]) == (["a", "c"], ["a", "b", "c"], ["z", "b", "c"], ["a", "b", "c"])
    assert (row["put"], row["none"], row["i"], row["t"], row["d"], row["bad"], row["p"]) == ({"k": "2"}, {}, 42, -1, "2024-01-05", None, "u_*_x*")
    with pytest.raises(ValueError):
        V.convert(F.lit(1), "INT", "DATE")


# Indexes and text


def test_secondary_index(spark):
    people = spark.createDataFrame([(f"user_{i}", f"age_{20 + i % 50}") for i in range(100)], "key string, value string")
    index = indexes.Secondary(people, F.col("key"), F.col("value"))
    assert index.exact("age_25").count() == 2 and index.between("age_25", "age_30").count() == 12
    stats = index.stats().first()
    assert (stats["distinct_values"], stats["selectivity"]) == (50, 0.5)
    with pytest.raises(ValueError):
        indexes.Secondary(people, F.col("key"), F.col("value"), unique=True)


def test_composite_index(spark):
    items = spark.createDataFrame([(f"product_{i}", f"category_{i % 5}", f"price_{100 + i % 100}") for i in range(50)], "key string, c string, p string")
    index = indexes.Composite(items, F.col("key"), [F.col("c"), F.col("p")])
    assert index.exact_fields("category_1", "price_150").count() == 0
    assert index.prefix_fields("category_1").count() == 10 and index.prefix_fields("cat", strict=True).count() == 0


FOX = ["The quick brown fox jumps over the lazy dog", "A fast brown fox leaps over a sleeping dog", "The lazy dog sleeps under the tree", "Quick brown animals are very fast", "Dogs and foxes are common animals."]
ML = ["machine learning algorithms are powerful", "deep learning neural networks", "artificial intelligence and machine learning", "natural language processing with neural networks", "computer vision using deep learning"]


def found(df):
    return sorted(r["doc"] for r in df.collect())


def test_full_text(spark):
    index = text_index.postings(spark.createDataFrame([(f"doc_{i}", t) for i, t in enumerate(FOX)], "doc_id string, text string"))
    stats = text_index.document_stats(index).first()
    assert (stats["terms"], stats["tokens"], stats["average_length"]) == (18, 28, 5.6)
    assert found(text_index.search(index, "brown fox")) == ["doc_0", "doc_1"] and found(text_index.search_all(index, ["quick", "brown"])) == ["doc_0", "doc_3"]
    assert found(text_index.search(index, "the")) == [] and found(text_index.search_wildcard(index, "fox*")) == ["doc_0", "doc_1", "doc_4"]
    assert found(text_index.search_boolean(index, "fox AND NOT lazy OR tree")) == ["doc_1", "doc_2"]
    ranked = {r["doc"]: round(r["score"], 6) for r in text_index.rank_tfidf(index, 5, "brown fox").collect()}
    assert ranked == {"doc_0": 0.203874, "doc_1": 0.203874, "doc_3": 0.102165}


def test_positional_index(spark):
    index = text_index.postings(spark.createDataFrame([(f"article_{i}", t) for i, t in enumerate(ML)], "doc_id string, text string"))
    stats = text_index.document_stats(index).first()
    assert (stats["terms"], stats["postings"], stats["average_length"]) == (15, 22, 4.4)
    assert found(text_index.search_any(index, ["learning"])) == ["article_0", "article_1", "article_2", "article_4"]
    assert found(text_index.search_all(index, ["machine", "learning"])) == ["article_0", "article_2"]
    scores = {r["doc"]: round(r["score"], 6) for r in text_index.rank_bm25(index, 5, 4.4, ["neural", "networks"]).collect()}
    assert scores == {"article_1": 0.698938, "article_3": 0.637388}
    assert text_index.rank_bm25(index, 5, 4.4, ["machine", "learning"]).count() == 0  # in more than half of the documents
    assert found(text_index.search_phrase(index, ["deep", "learning"])) == ["article_1", "article_4"]
    assert found(text_index.search_phrase(index, ["learning", "deep"])) == []
    assert found(text_index.search_phrase(index, ["natural", "neural", "networks"], 5)) == ["article_3"]
    assert text_index.search_phrase(index, []).count() == 0


def test_tokens(spark):
    text = "Don't  panic, the ANSWER is 42 - or 4.2! éCOLE x"
    got = spark.range(1).select(T.tokens(F.lit(text)).alias("t"), T.tokens(F.lit(text), True).alias("n")).first()
    assert got["t"] == ["dont", "panic", "answer", "42", "or", "42", "écOLE".replace("OLE", "ole")] and got["n"] == ["dont", "panic", "answer", "or", "école"]
    assert T.query_tokens(text) == got["t"] and len(set(T.STOP_WORDS)) == 77


def test_catalog(spark):
    rows = kv(spark, {"a": "quick fox", "b": "slow fox", "c": "1"})
    c = indexes.Catalog(rows)
    c.create_secondary("by_value")
    c.create_fulltext("words")
    assert c.names() == ["by_value", "words"] and keys(c.lookup("by_value", "exact", "1")) == ["c"]
    assert sorted(keys(c.fetch("words", "search", "fox"))) == ["a", "b"]
    with pytest.raises(ValueError):
        c.create_fulltext("words")
    log = indexes.condition_log([Condition("key", "=", "x")] * 5 + [Condition("value", "LIKE", "x*")], spark)
    assert {(r["name"], r["gain"]) for r in indexes.recommend(log).collect()} == {("key_idx", 4.0), ("value_fulltext_idx", 10.0)}


# Schemas, metrics, shards


def test_inference(spark):
    given = {"1": "BOOL", "no": "BOOL", "7": "VARINT", "128": "UINT32", "4294967296": "UINT64", "-1": "INT32", "-2147483649": "INT64", "3.5": "DOUBLE", "1e5": "DOUBLE", "": "STRING", "a1": "STRING", "+5": "VARINT"}
    df = spark.createDataFrame([(k,) for k in given], "s string")
    assert {r["s"]: r["t"] for r in df.select("s", V.inferred_type(F.col("s")).alias("t")).collect()} == given
    records = spark.createDataFrame([("1", "x", None), ("200", "y", "2.5"), ("300", "z", "3.5")], "id string, name string, score string")
    assert {(r["field"], r["type"], r["optional"]) for r in schemas.infer(records).collect()} == {("id", "UINT32", False), ("name", "STRING", False), ("score", "DOUBLE", True)}
    assert schemas.spark_schema(records) == "`id` bigint, `name` string, `score` double"


def test_percentile_formulas(spark):
    rows = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    assert metrics.percentiles(rows, ["g"], "v", [99]).first()["p99"] == 98.0
    assert metrics.op_summary(rows, ["g"], "v").first()["p99"] == 99.0
    assert "lodestone_x 1" in metrics.prometheus({"x": 1.0})


def test_alert_cooldown(spark):
    rows = spark.createDataFrame([("a", s, 9.0) for s in (0, 5, 10, 19, 20)], "g string, s bigint, v double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r["us"] // 1_000_000 for r in metrics.alerts(rows, ["g"], "ts", F.col("v") > 1, 10).collect()) == [0, 10, 20]


def test_shards(spark):
    bounds = [(0, "", "m"), (1, "m", "~")]
    rows = kv(spark, {"a": "1", "m": "2", "z": "3"})
    assert {r["key"]: r["shard"] for r in shards.route(rows, bounds).collect()} == {"a": 0, "m": 1, "z": 1}
    assert shards.overlapping(bounds, "a", "l") == [0] and shards.overlapping(bounds, "a", "m") == [0, 1]
    even = shards.balanced(spark.range(1000).select(F.format_string("%04d", "id").alias("key")), 4)
    assert len(even) == 4 and even[0][1] == "" and even[-1][2] == "~"
    keyed = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    three = {r["key"]: r["node"] for r in shards.ring(keyed, ["n1", "n2", "n3"]).collect()}
    four = {r["key"]: r["node"] for r in shards.ring(keyed, ["n1", "n2", "n3", "n4"]).collect()}
    moved = [k for k in three if three[k] != four[k]]
    assert set(three.values()) == {"n1", "n2", "n3"} and all(four[k] == "n4" for k in moved) and len(moved) < 2000


# Files and commands


@pytest.mark.parametrize("ending", ["json", "csv", "parquet"])
def test_files_round_trip(spark, tmp_path, ending):
    rows = kv(spark, {"k1": 'a "quoted", value', "k2": "two\nlines", "k3": "", "other": "x"})
    path = str(tmp_path / f"out.{ending}")
    files.export(rows, path, key_contains="k")
    assert {r["key"]: r["value"] for r in files.load(spark, path).collect()} == {"k1": 'a "quoted", value', "k2": "two\nlines", "k3": ""}


def test_log_replay_and_backup(spark, tmp_path):
    (tmp_path / "wal").mkdir()
    (tmp_path / "wal" / "1.log").write_text("PUT a hello world\nDEL b\nnoise\n")
    (tmp_path / "wal" / "2.log").write_text("PUT b 2\nPUT a \n")
    log = files.replay(spark, str(tmp_path / "wal"))
    assert {r["key"]: r["value"] for r in versions.latest(log).collect()} == {"a": "", "b": "2"}
    files.backup(log, str(tmp_path / "full"))
    first = min(r["seq"] for r in log.collect())
    assert one(versions.get(files.restore(spark, [str(tmp_path / "full")], first), "a")) == "hello world"
    (tmp_path / "x.bin").write_bytes(b"\0\1")
    assert bytes(files.blobs(spark, str(tmp_path / "x.bin")).first()["b"]) == b"\0\1"


def test_commands(store):
    run = Interpreter(store)
    out = run.script('# demo\nPUT score:1 95\nput score:2 87\nPUT price:1 1200\nPUT price:2 25\nPUT note "two words"\nBATCH PUT score:3 92 score:4 88\n// done\nSUM score:*\nMIN_MAX price:*')
    assert out[-2].first()["sum"] == 362.0 and (out[-1].first()["min"], out[-1].first()["max"]) == (25.0, 1200.0)
    assert one(run.execute("GET note")) == "two words" and run.execute("COUNT").first()["count"] == 7
    number = run.execute("SNAPSHOT")
    run.execute("DEL score:1")
    assert run.execute("GET score:1").count() == 0 and one(run.execute(f"GET_AT score:1 {number}")) == "95"
    assert keys(run.execute("GET_WHERE value > 90 LIMIT 1")) == ["note"] and keys(run.execute("SCAN_ORDER DESC score:2 score:9 LIMIT 2")) == ["score:3", "score:2"]
    assert keys(run.execute("KEYS 'score:*'")) == ["score:2", "score:3", "score:4"] and run.execute("EXISTS score:2 none").count() == 1
    run.execute(f"RELEASE {number}")
    run.execute("COMPACT")
    assert run.execute("COUNT WHERE key LIKE score:*").first()["count"] == 3
    with pytest.raises(ValueError):
        run.execute("NONSENSE")
