"""More registered queries: stores, files, index maintenance, transactions, shards, event engines.

Queries that write do so into a new folder below :func:`lodestone.session.scratch`.
"""

from __future__ import annotations

import uuid
from itertools import islice

from pyspark.sql import functions as F

from ..operators import indexes, metrics, shards, text_index, typed, typed_store, versions
from ..session import scratch
from ..sources import files
from ..streaming import engine, live, pipeline
from .catalog import BOUNDS, CUSTOMERS_KV, ORDER_VERSIONS, ORDERS_KV, TOKENS, TYPED, USER_LOG, customers_kv, doc_index, order_versions, orders_kv, query, seen, segment_index, table, typed_rows, user_log


def folder(spark, name):
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


# Cursors, stores


@query(f"WITH {USER_LOG}, {seen()} SELECT row_number() OVER (ORDER BY key) - 1 AS place, key, value FROM latest WHERE key >= 'user:5' ORDER BY key LIMIT 25")
def kv_seek(spark, d):
    """The first 25 steps of a cursor; places tell the order."""
    cursor = versions.seek(user_log(spark, d), "user:5")
    steps = [(i, *pair) for i, pair in enumerate(islice(cursor, 25))]
    return spark.createDataFrame(steps, "place bigint, key string, value string")


@query(f"WITH {ORDERS_KV} SELECT row_number() OVER (ORDER BY key DESC) - 1 AS place, key FROM (SELECT * FROM kv WHERE key BETWEEN 'orders:2' AND 'orders:3' ORDER BY key LIMIT 60)")
def ordered_scan_places(spark, d):
    """The order of a descending scan with a limit, as it comes to a reader."""
    from ..operators.query import QueryEngine

    rows = QueryEngine(orders_kv(spark, d)).scan_ordered("orders:2", "orders:3", True, 60).collect()  # 60 rows
    return spark.createDataFrame([(i, r["key"]) for i, r in enumerate(rows)], "place bigint, key string")


STORE_SQL = f"""WITH {CUSTOMERS_KV}, w AS (SELECT key, value, row_number() OVER () AS n FROM kv),
s AS (SELECT key, value FROM kv WHERE NOT ends_with(key, '7')), t AS (SELECT key, CASE WHEN key = 'customer:1' THEN '' WHEN key = 'customer:12' THEN 'second' ELSE value END AS value FROM s WHERE key NOT IN ('customer:2', 'customer:3'))"""


def written_store(spark, d):
    """A store after a bulk load, tombstones, single writes and a batch."""
    store = versions.Store(spark, folder(spark, "store"))
    rows = customers_kv(spark, d)
    store.load(rows)
    gone = rows.where(F.col("key").endswith("7")).select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted"), F.lit(0).alias("ordinal"))
    store.append(gone, 1)
    store.put("customer:1", "")
    store.delete("customer:2")
    store.batch_put([("customer:new", "fresh"), ("customer:12", "first")])
    store.batch_delete(["customer:3", "customer:none"])
    store.batch_execute([("PUT", "customer:12", "second"), ("PUT", "customer:late", "x"), ("DELETE", "customer:late")])
    return store


@query(STORE_SQL + " SELECT key, value FROM t UNION ALL SELECT 'customer:new', 'fresh'")
def store_writes(spark, d):
    return versions.latest(written_store(spark, d).log).select("key", "value")


@query(STORE_SQL + " SELECT key, value FROM t UNION ALL SELECT 'customer:new', 'fresh'")
def store_compacted(spark, d):
    store = written_store(spark, d)
    store.compact()
    return store.log.select("key", "value")


@query(f"WITH {CUSTOMERS_KV} SELECT key, value FROM kv")
def store_snapshot(spark, d):
    """A snapshot reads what was there, through later writes and a rewrite."""
    store = versions.Store(spark, folder(spark, "store"))
    store.load(customers_kv(spark, d))
    at = store.snapshot()
    store.batch_execute([("PUT", "customer:1", "changed"), ("DELETE", "customer:2"), ("PUT", "customer:new", "x")])
    store.compact()
    return versions.latest(store.log, at).select("key", "value")


@query(f"WITH {CUSTOMERS_KV} SELECT key, value FROM kv")
def store_checkpoint(spark, d):
    """A restored checkpoint undoes what came behind it."""
    store = versions.Store(spark, folder(spark, "store"))
    store.load(customers_kv(spark, d))
    number = store.checkpoint("before")
    store.batch_execute([("PUT", "customer:1", "changed"), ("DELETE", "customer:2"), ("PUT", "customer:new", "x")])
    store.restore(number)
    return versions.latest(store.log).select("key", "value")


@query(f"WITH {CUSTOMERS_KV} SELECT key, value FROM kv WHERE key NOT IN ('customer:1', 'customer:2') UNION ALL SELECT 'customer:1', 'kept'")
def store_transactions(spark, d):
    """One transaction commits, one rolls back."""
    store = versions.Store(spark, folder(spark, "store"))
    store.load(customers_kv(spark, d))
    first, second = store.transaction(), store.transaction()
    first.put("customer:1", "kept")
    first.delete("customer:2")
    second.put("customer:3", "lost")
    first.commit()
    second.rollback()
    return versions.latest(store.log).select("key", "value")


@query(f"WITH {CUSTOMERS_KV} SELECT key, value FROM kv WHERE key BETWEEN 'customer:2' AND 'customer:4'")
def store_range_scan(spark, d):
    """On a stored log the key's bounds reach the scan."""
    store = versions.Store(spark, folder(spark, "store"))
    store.load(customers_kv(spark, d))
    store.compact()
    return versions.range_scan(store.log, "customer:2", "customer:4")


@query(f"WITH {USER_LOG} SELECT key, seq, value, deleted FROM log WHERE seq <= 4000")
def backup_and_restore(spark, d):
    """A full backup, an incremental one behind it, and a restore up to a sequence number."""
    log, full, more = user_log(spark, d), folder(spark, "backup"), folder(spark, "backup")
    files.backup(log.where("seq <= 2500"), full)
    files.backup(log, more, 2500)
    return files.restore(spark, [full, more], 4000)


# Typed stores


@query(f"WITH {TYPED} SELECT key, type, coalesce(CAST(i AS VARCHAR), printf('%.6f', d), s, strftime(ts, '%Y-%m-%d %H:%M:%S'), CAST(dt AS VARCHAR)) AS text FROM typed")
def typed_store_round_trip(spark, d):
    store = typed_store.TypedStore(spark, folder(spark, "typed"))
    store.load(typed_rows(spark, d))
    return typed.text(store.rows())


@query(f"WITH {TYPED} SELECT key, type, coalesce(CAST(i AS VARCHAR), printf('%.6f', d), s, strftime(ts, '%Y-%m-%d %H:%M:%S'), CAST(dt AS VARCHAR)) AS text FROM typed WHERE type <> 'STRING'")
def typed_export_import(spark, d):
    first, second, path = typed_store.TypedStore(spark, folder(spark, "typed")), typed_store.TypedStore(spark, folder(spark, "typed")), folder(spark, "json")
    first.load(typed_rows(spark, d).where("type <> 'STRING'"))
    first.export_json(path)
    second.import_json(path)
    return typed.text(second.rows())


@query("""SELECT * FROM (VALUES ('age', 'INT', '25'), ('price', 'FLOAT', '19.990000'), ('pi', 'DOUBLE', '3.141593'), ('name', 'STRING', 'Alice "A"'), ('at', 'TIMESTAMP', '2024-01-15 10:30:00'), ('born', 'DATE', '1990-05-15'),
('list', 'LIST', '[b, a, b]'), ('set', 'SET', '{a, b}'), ('map', 'MAP', '{k: v, z: ü}'), ('blob', 'BLOB', 'BLOB(5 bytes)'), ('whole', 'INT', '19'), ('kept', 'STRING', 'yes')) AS t(key, type, text)""")
def typed_puts(spark, d):
    """Every type through put, a conversion, and transactions of which one is rolled back."""
    from datetime import date, datetime

    store = typed_store.TypedStore(spark, folder(spark, "typed"))
    store.put_all([("age", "INT", 25), ("price", "FLOAT", 19.99), ("pi", "DOUBLE", 3.14159265359), ("name", "STRING", 'Alice "A"'), ("at", "TIMESTAMP", datetime(2024, 1, 15, 10, 30)), ("born", "DATE", date(1990, 5, 15))])
    store.put_all([("list", "LIST", ["b", "a", "b"]), ("set", "SET", ["b", "a", "b"]), ("map", "MAP", {"z": "ü", "k": "v"}), ("blob", "BLOB", bytearray(b"12345")), ("whole", "DOUBLE", 19.9), ("gone", "INT", 1)])
    store.convert("whole", "INT")
    first, second = store.transaction(), store.transaction()
    first.put("kept", "STRING", "yes")
    first.delete("gone")
    second.put("lost", "INT", 1)
    first.commit()
    second.rollback()
    return typed.text(store.rows())


# Files


@query(f"WITH {USER_LOG} SELECT key, seq, CASE WHEN deleted THEN NULL ELSE value END AS value, deleted FROM log")
def log_replay(spark, d):
    """The log as text lines in files that follow each other, read back as versions."""
    path = folder(spark, "wal")
    line = F.when(F.col("deleted"), F.concat(F.lit("DEL "), "key")).otherwise(F.concat(F.lit("PUT "), "key", F.lit(" "), "value"))
    user_log(spark, d).repartitionByRange(4, "seq").sortWithinPartitions("seq").select(line.alias("value")).write.text(path)
    return files.replay(spark, path)


def _round_trip(spark, d, format):
    path = folder(spark, "export")
    files.export(customers_kv(spark, d), path, format)
    return files.load(spark, path, format)


@query(f"WITH {CUSTOMERS_KV} SELECT key, value FROM kv")
def json_export_import(spark, d):
    return _round_trip(spark, d, "json")


@query(f"WITH {CUSTOMERS_KV} SELECT key, value FROM kv")
def csv_export_import(spark, d):
    return _round_trip(spark, d, "csv")


@query(f"WITH {CUSTOMERS_KV} SELECT key, value FROM kv")
def columnar_write_read(spark, d):
    return _round_trip(spark, d, "parquet")


@query(f"WITH {CUSTOMERS_KV} SELECT key, value FROM kv WHERE contains(key, ':11')")
def migrate_keys(spark, d):
    """Rows of one file format go to another, with a key filter."""
    source, target = folder(spark, "source"), folder(spark, "target")
    files.export(customers_kv(spark, d), source, "json")
    files.export(files.load(spark, source, "json"), target, "csv", ":11")
    return files.load(spark, target, "csv")


@query("SELECT c_mktsegment FROM customer")
def read_column(spark, d):
    return files.read_column(spark, f"{d}/customer.parquet", "c_mktsegment")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def records_where(spark, d):
    return files.records_where(spark, f"{d}/customer.parquet", "c_mktsegment", "BUILDING").select("c_custkey", "c_name", "c_acctbal")


def _rewritten(strategy):
    def run(spark, d):
        path = folder(spark, "layout")
        rows = table(spark, d, "events").select(F.concat(F.lit("e:"), "event_id").alias("key"), "ts", F.round("value", 2).alias("value"))
        files.rewrite(rows, path, strategy, "ts")
        return spark.read.parquet(path).select("key", "value")

    run.__name__ = f"layout_{strategy.lower()}"
    return query("SELECT 'e:' || event_id AS key, round(value, 2) AS value FROM events")(run)


for _strategy in files.LAYOUTS:
    _rewritten(_strategy)


@query(f"WITH {CUSTOMERS_KV} SELECT key, value FROM kv WHERE key IN ('customer:7', 'customer:77')")
def point_read_by_bloom(spark, d):
    """Key ranges, statistics and Bloom filters leave few row groups to read."""
    path = folder(spark, "keyed")
    files.keyed(customers_kv(spark, d), path, "zstd")
    return spark.read.parquet(path).where(F.col("key").isin("customer:7", "customer:77"))


@query("SELECT * FROM (VALUES ('gzip', true), ('lz4', true), ('none', false), ('snappy', true), ('zstd', true)) AS t(codec, smaller)")
def codec_comparison(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.repeat("l_returnflag", 20).alias("text"))
    sizes = files.codec_sizes(rows, folder(spark, "codecs"))
    return spark.createDataFrame([(c, n < sizes["none"]) for c, n in sizes.items()], "codec string, smaller boolean")


# Index maintenance

CHANGES = "changes AS (SELECT c_name AS key, CASE WHEN c_custkey % 10 = 0 THEN 'MOVED' ELSE NULL END AS value FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 7 = 0)"


def segment_changes(spark, d):
    at = F.col("c_custkey")
    return table(spark, d, "customer").where((at % 10 == 0) | (at % 7 == 0)).select(F.col("c_name").alias("key"), F.when(at % 10 == 0, "MOVED").alias("value"))


@query(f"WITH {CHANGES} SELECT c_mktsegment AS value, c_name AS key FROM customer WHERE c_name NOT IN (SELECT key FROM changes) UNION ALL SELECT value, key FROM changes WHERE value IS NOT NULL")
def index_after_writes(spark, d):
    return segment_index(spark, d).updated(segment_changes(spark, d)).rows


@query(f"WITH {CHANGES}, idx AS (SELECT c_mktsegment AS value, c_name AS key FROM customer WHERE c_name NOT IN (SELECT key FROM changes) UNION ALL SELECT value, key FROM changes WHERE value IS NOT NULL) SELECT key FROM idx WHERE value = 'MOVED'")
def catalog_after_writes(spark, d):
    """Lookups in a catalog follow writes to its table; an index that is made again gives the same."""
    rows = table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    catalog = indexes.Catalog(rows)
    catalog.create_secondary("segment")
    catalog.write(segment_changes(spark, d))
    catalog.rebuild("segment")
    return catalog.lookup("segment", "exact", "MOVED")


@query("SELECT 'brand' AS name, 'COMPOSITE' AS kind, count(*) AS entries, count(DISTINCT left(c_mktsegment, 1) || '|' || c_nationkey) AS distinct_values FROM customer UNION ALL SELECT 'segment', 'SECONDARY', count(*), count(DISTINCT c_mktsegment) FROM customer")
def index_catalog_stats(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), "c_nationkey")
    catalog = indexes.Catalog(rows)
    catalog.create_secondary("segment")
    catalog.create_composite("brand", [F.substring("value", 1, 1), F.col("c_nationkey")])
    return catalog.stats()


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'")
def index_saved_and_fetched(spark, d):
    """An index goes to files and back, and its keys fetch their rows."""
    rows = table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    catalog, path = indexes.Catalog(rows), folder(spark, "index")
    catalog.create_secondary("segment")
    catalog.save("segment", path)
    catalog.drop("segment")
    catalog.load("again", path)
    return catalog.fetch("again", "range", "B", "G")


@query(f"WITH {TOKENS} SELECT doc, freq, array_to_string(positions, ',') AS positions FROM postings WHERE term = 'license'")
def search_posting_list(spark, d):
    return text_index.posting_list(doc_index(spark, d), "License").select("doc", "freq", F.array_join("positions", ",").alias("positions"))


@query(f"WITH {TOKENS} SELECT DISTINCT term FROM postings")
def search_all_index_terms(spark, d):
    return text_index.all_terms(doc_index(spark, d))


@query(f"WITH {TOKENS} SELECT doc FROM postings WHERE term IN ('public', 'license') GROUP BY doc HAVING count(*) = 2")
def search_phrase_without_places(spark, d):
    return text_index.search_together(doc_index(spark, d), ["Public", "License"])


@query(f"""WITH {TOKENS}, kept AS (SELECT term, doc FROM postings WHERE doc % 5 <> 0 UNION ALL SELECT 'renewed', doc_id FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'license', doc_id FROM documents WHERE doc_id % 10 = 0)
SELECT term, count(*) AS df FROM kept WHERE term IN ('license', 'renewed', 'public') GROUP BY term""")
def search_after_updates(spark, d):
    """Some documents leave the postings, others come back with another text."""
    index = doc_index(spark, d)
    docs = table(spark, d, "documents").select("doc_id")
    left = text_index.removed(index, docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("doc")))
    now = text_index.updated(left, docs.where("doc_id % 10 = 0").withColumn("text", F.lit("The renewed license!")))
    return now.where(F.col("term").isin("license", "renewed", "public")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


# Transactions

TXN = ORDER_VERSIONS + ", x AS (SELECT *, key % 5 AS txn FROM v)"


def transactions(spark, d):
    return order_versions(spark, d).withColumn("txn", (F.col("key") % 5).cast("bigint"))


@query(f"""WITH {TXN}, w AS (SELECT key, create_ts, value, delete_ts, committed, txn FROM x UNION ALL SELECT DISTINCT key, 90000, 'new', 0, false, 7 FROM x WHERE key % 3 = 0 UNION ALL SELECT DISTINCT key, 90001, 'lost', 0, false, 8 FROM x WHERE key % 4 = 0)
SELECT key, create_ts, value, delete_ts, committed OR txn = 7 AS committed FROM w WHERE committed OR txn <> 8""")
def mvcc_commit_and_abort(spark, d):
    """Two transactions write; one commits, the other is aborted."""
    now = transactions(spark, d)
    keys = now.select("key").distinct()
    now = versions.written(now, keys.where("key % 3 = 0").withColumn("value", F.lit("new")), 7, 90000)
    now = versions.written(now, keys.where("key % 4 = 0").withColumn("value", F.lit("lost")), 8, 90001)
    return versions.aborted(versions.committed(now, 7), 8).drop("txn")


@query(f"""WITH {TXN} SELECT key, create_ts, CASE WHEN key % 6 = 0 AND create_ts = max(create_ts) OVER (PARTITION BY key) THEN 95000 ELSE delete_ts END AS delete_ts FROM x""")
def mvcc_remove(spark, d):
    now = transactions(spark, d)
    return versions.removed(now, now.where("key % 6 = 0").select("key"), 95000).select("key", "create_ts", "delete_ts")


@query(f"WITH {TXN} SELECT count(DISTINCT key) AS keys, count(*) AS versions, count(DISTINCT CASE WHEN NOT committed THEN txn END) AS active, min(CASE WHEN NOT committed THEN create_ts END) AS oldest FROM x")
def mvcc_active(spark, d):
    return versions.version_stats(transactions(spark, d))


# Shards

_SPLIT = "CASE WHEN key < 'orders:3' THEN 0 WHEN key < 'orders:45' THEN 1 WHEN key < 'orders:6' THEN 3 ELSE 2 END"


@query(f"WITH {ORDERS_KV} SELECT {_SPLIT} AS shard, count(*) AS n FROM kv GROUP BY 1")
def shard_split(spark, d):
    return shards.counts(orders_kv(spark, d), shards.split(BOUNDS, 1, "orders:45"))


@query(f"WITH {ORDERS_KV} SELECT CASE WHEN key < 'orders:6' THEN 0 ELSE 2 END AS shard, count(*) AS n FROM kv GROUP BY 1")
def shard_merge(spark, d):
    return shards.counts(orders_kv(spark, d), shards.merged(BOUNDS, 0, 1))


HASHED = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(key, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 18446744073709551616::HUGEINT)"


@query(f"WITH {ORDERS_KV} SELECT CAST({HASHED} % 6 AS INTEGER) AS shard, count(*) AS n FROM kv GROUP BY 1")
def shard_hashed(spark, d):
    return shards.hashed(orders_kv(spark, d), 6).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


# Events

EVENT_SQL = "SELECT 'e' || event_id AS id, event_type AS type, 'user_' || user_id AS key, CAST(round(value, 2) AS VARCHAR) AS new_value, ts AS timestamp FROM events"


def change_events(spark, d):
    t = table(spark, d, "events")
    empty = F.lit(None).cast("string")
    return t.select(
        F.concat(F.lit("e"), "event_id").alias("id"), F.col("event_type").alias("type"), F.concat(F.lit("user_"), "user_id").alias("key"), empty.alias("old_value"), F.round("value", 2).cast("string").alias("new_value"),
        F.col("ts").cast("timestamp").alias("timestamp"), empty.alias("transaction_id"), F.lit(None).cast("map<string,string>").alias("metadata"), "event_id", "value",
    )


@query("""SELECT event_id, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events WHERE event_type IN ('click', 'purchase') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20')) / 4) AS BIGINT) AS delay_us
FROM events WHERE event_type IN ('click', 'purchase') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""")
def event_replay(spark, d):
    return engine.replayed(change_events(spark, d), "2024-01-05", "2024-01-20", ["click", "purchase"], 4.0).select("event_id", "delay_us")


@query("SELECT event_id, subscriber FROM events JOIN (VALUES ('ones', 'user_1.*'), ('all', '.*'), ('two', 'user_.2')) AS s(subscriber, pattern) ON regexp_full_match('user_' || user_id, pattern)")
def subscriptions(spark, d):
    return engine.subscribed(change_events(spark, d), {"ones": "user_1*", "all": "*", "two": "user_?2"}).select("event_id", "subscriber")


@query("SELECT count(*) AS processed, count(*) FILTER (event_type = 'click' AND value > 20) AS passed, count(*) FILTER (NOT (event_type = 'click' AND value > 20)) AS filtered FROM events")
def stream_counts(spark, d):
    return engine.counted(change_events(spark, d), pipeline.event_filter(["click"], None, F.col("value") > 20))


@query("SELECT CAST((row_number() OVER (ORDER BY event_id) - 1) // 300 AS BIGINT) AS batch, event_id FROM events WHERE event_type = 'view'")
def handler_batches(spark, d):
    return engine.batches(change_events(spark, d).where("type = 'view'"), 300, "event_id").select("batch", "event_id")


@query("""SELECT 'user_' || user_id AS key, count(*) AS group_size FROM events WHERE event_type = 'click' GROUP BY 1""")
def engine_pipelines(spark, d):
    """A running engine sends a batch through its pipelines, a sink among them; a stopped one does not."""
    seen_by_sink = []
    ours = engine.Engine()
    ours.register(pipeline.Pipeline("clicks").filter(F.col("type") == "click").step(lambda df: df.select("key")).group_by(F.col("key")).to(seen_by_sink.append))
    events = change_events(spark, d)
    ours.process(events)
    ours.start()
    ours.process(events)
    ours.stop()
    ours.process(events)
    return seen_by_sink[0]


@query("""WITH both_sides AS (SELECT 'user_' || user_id AS key, event_id AS value, ts AS timestamp, CASE WHEN event_id % 2 = 0 THEN 'local' ELSE 'remote' END AS origin FROM events),
one AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY timestamp DESC, origin) AS place FROM (SELECT key, origin, timestamp, max(value) AS value FROM both_sides GROUP BY ALL)) SELECT key, origin, epoch_us(timestamp) AS us FROM one WHERE place = 1""")
def two_way_sync(spark, d):
    rows = change_events(spark, d).select("key", F.col("event_id").alias("value"), "timestamp", "event_id")
    local, remote = (rows.where(F.col("event_id") % 2 == k).drop("event_id") for k in (0, 1))
    return engine.reconciled(local, remote).select("key", "origin", F.unix_micros("timestamp").alias("us"))


def stored_events(spark, d):
    """Change events in a folder, as a stream reads them, in four files by time."""
    path = folder(spark, "events")
    change_events(spark, d).select("id", "type", "key", "old_value", "new_value", "timestamp", "transaction_id", "metadata").repartitionByRange(4, "timestamp").write.parquet(path)
    return path


@query(f"""WITH e AS (SELECT key, max_by(new_value, (timestamp, id)) AS value, max_by(type, (timestamp, id)) AS kind FROM ({EVENT_SQL}) WHERE type <> 'error' GROUP BY key) SELECT key, value FROM e""")
def stream_sync(spark, d):
    """A change stream goes to a store micro-batch by micro-batch; the last change of a key is there in the end."""
    path = stored_events(spark, d)
    store = versions.Store(spark, folder(spark, "synced"))
    events = live.read(spark, path, files_per_trigger=100).where("type <> 'error'")
    live.sync(events, [store.append], folder(spark, "offsets")).awaitTermination()
    return versions.latest(store.log).select("key", "value")


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS start, 'user_' || user_id AS key, count(*) AS n FROM events GROUP BY 1, 2")
def stream_watermark_windows(spark, d):
    """Windows on a stream with a watermark, run to the end with all state kept in the output."""
    stream = live.windowed(live.read(spark, stored_events(spark, d)), "1 day", "1 day")
    out = live.drain(stream, f"w{uuid.uuid4().hex}", "complete")
    return out.select(F.unix_micros("start").alias("start"), "key", "n")



# Metrics


@query("SELECT event_type AS field, CASE WHEN user_id % 2 = 0 THEN '=' ELSE 'LIKE' END AS operator, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS worst FROM events GROUP BY 1, 2")
def query_patterns(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("field"), F.when(F.col("user_id") % 2 == 0, "=").otherwise("LIKE").alias("operator"), F.col("value").alias("took"))
    return metrics.query_patterns(log).withColumn("mean", F.round("mean", 6))


@query("SELECT round(exp(regr_slope(ln(l_extendedprice), l_quantity)), 6) AS rate, round(exp(regr_intercept(ln(l_extendedprice), l_quantity)), 2) AS start, round(regr_r2(ln(l_extendedprice), l_quantity), 6) AS r2 FROM lineitem WHERE l_extendedprice > 0")
def price_growth(spark, d):
    return metrics.growth(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("rate", 6).alias("rate"), F.round("start", 2).alias("start"), F.round("r2", 6).alias("r2"))


@query("SELECT CAST(hour(ts) AS INTEGER) AS part, count(*) AS n, round(avg(value), 6) AS mean, round(avg(value) / (SELECT avg(value) FROM events), 6) AS share FROM events GROUP BY 1")
def seasonal_values(spark, d):
    return metrics.seasonal(table(spark, d, "events"), "ts", "value").select("part", "n", F.round("mean", 6).alias("mean"), F.round("share", 6).alias("share"))


@query("SELECT event_type, CAST(sum(sign) AS BIGINT) AS folded FROM (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS sign FROM events) GROUP BY 1")
def stream_fold_by_key(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).cast("bigint").alias("sign"))
    p = pipeline.Pipeline().fold("event_id", "sign", F.lit(0).cast("bigint"), lambda acc, x: acc + x, "event_type")
    return p.execute(rows).select("event_type", F.col("sign").alias("folded"))
