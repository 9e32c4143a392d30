"""More registered queries: scalar functions on typed values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import typed
from .catalog import PARTS_KV, TYPED, USER_SETS, parts_kv, query, table, typed_rows, user_sets

HASH31 = "CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(key, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 18446744073709551616::HUGEINT) AS VARCHAR)"


@query(f"WITH {PARTS_KV} SELECT key, {HASH31} AS hash, array_to_string(string_split(key, ':'), '|') AS joined, string_split(key, ':')[2] AS second FROM kv")
def hash_and_composite_key(spark, d):
    kv = parts_kv(spark, d)
    parts = F.split("key", ":")
    joined = V.composite_key(parts[0], parts[1], parts[2])
    return kv.select("key", V.hash31(F.col("key")).cast("string").alias("hash"), joined.alias("joined"), V.composite_parts(joined)[1].alias("second"))


@query(f"""WITH RECURSIVE {PARTS_KV}, crc(n, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE k < 8),
entry AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8)
SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda r, b: xor(t[xor(r % 256, b) + 1], r // 256)), 4294967295) AS crc FROM kv, entry""")
def key_crc32(spark, d):
    return parts_kv(spark, d).select("key", F.crc32(F.col("key").cast("binary")).alias("crc"))


@query("""SELECT o_orderkey, array_to_string(list_transform(list_filter(range(9), lambda i: i = 0 OR (o_orderkey >> (7 * i)) > 0),
lambda i: printf('%02x', ((o_orderkey >> (7 * i)) % 128 + CASE WHEN (o_orderkey >> (7 * (i + 1))) > 0 THEN 128 ELSE 0 END)::INTEGER)), '') AS code FROM orders""")
def varint_codes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.varint(F.col("o_orderkey").cast("bigint")).alias("code"))


def order_json(spark, d):
    mark = F.concat("o_orderpriority", F.lit('"\\\n'))
    return table(spark, d, "orders").select(
        "o_orderkey", V.json_value("INT", F.col("o_custkey")).alias("whole"), V.json_value("DOUBLE", F.col("o_totalprice")).alias("number"), V.json_value("STRING", mark).alias("text"),
        V.json_value("DATE", F.col("o_orderdate").cast("date")).alias("day"), V.json_value("TIMESTAMP", F.col("o_orderdate").cast("timestamp")).alias("moment"),
        V.json_value("LIST", F.array("o_orderstatus", F.lit("x"))).alias("list"), V.json_value("MAP", F.create_map(F.lit("status"), "o_orderstatus")).alias("map"),
        V.json_value("BLOB", F.col("o_orderstatus").cast("binary")).alias("blob"),
    )


@query("""SELECT o_orderkey, '{"type":"INT","value":' || o_custkey || '}' AS whole, '{"type":"DOUBLE","value":' || printf('%.15f', o_totalprice) || '}' AS number,
'{"type":"STRING","value":' || CAST(to_json(o_orderpriority || chr(34) || chr(92) || chr(10)) AS VARCHAR) || '}' AS text, '{"type":"DATE","value":"' || strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || '"}' AS day,
'{"type":"TIMESTAMP","value":"' || strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') || '"}' AS moment, '{"type":"LIST","value":[{"type":"STRING","value":"' || o_orderstatus || '"},{"type":"STRING","value":"x"}]}' AS list,
'{"type":"MAP","value":{"status":{"type":"STRING","value":"' || o_orderstatus || '"}}}' AS map, '{"type":"BLOB","value":"' || base64(encode(o_orderstatus)) || '"}' AS blob FROM orders""")
def json_values(spark, d):
    return order_json(spark, d)


@query("""SELECT o_orderkey, o_custkey AS whole, o_totalprice AS number, o_orderpriority || chr(34) || chr(92) || chr(10) AS text, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day,
strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS moment, o_orderstatus || ',x' AS list, o_orderstatus AS status, o_orderstatus AS blob, 'DATE' AS kind FROM orders""")
def json_parsed(spark, d):
    of = lambda c, kind: V.json_parsed(F.col(c))[kind]
    return order_json(spark, d).select(
        "o_orderkey", of("whole", "INT").alias("whole"), of("number", "DOUBLE").alias("number"), of("text", "STRING").alias("text"), of("day", "DATE").cast("string").alias("day"),
        F.date_format(of("moment", "TIMESTAMP"), "yyyy-MM-dd HH:mm:ss").alias("moment"), F.array_join(of("list", "LIST"), ",").alias("list"), of("map", "MAP")["status"].alias("status"),
        of("blob", "BLOB").cast("string").alias("blob"), of("day", "type").alias("kind"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(f"""WITH {TYPED} SELECT key, CASE type WHEN 'INT' THEN 8 WHEN 'DOUBLE' THEN 8 WHEN 'TIMESTAMP' THEN 8 WHEN 'DATE' THEN 12 ELSE strlen(s) END AS bytes,
  CASE type WHEN 'INT' THEN 1 WHEN 'DOUBLE' THEN 3 WHEN 'STRING' THEN 4 WHEN 'TIMESTAMP' THEN 5 ELSE 6 END AS rank, type AS name FROM typed""")
def value_sizes_and_types(spark, d):
    rank = V.type_rank(F.col("type")).cast("int")
    return typed_rows(spark, d).select("key", V.byte_size(F.col("type"), F.col("s")).cast("bigint").alias("bytes"), rank.alias("rank"), V.type_name(rank).alias("name"))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 4 END AS rank, lpad(CAST(user_id AS VARCHAR), 8, '0') AS value FROM events),
w AS (SELECT event_id, row_number() OVER (ORDER BY rank, value, event_id) AS place FROM v) SELECT event_id, place FROM w WHERE place <= 50""")
def value_order_first(spark, d):
    """The first 50 values by type, then value, with their places."""
    kind = F.when(F.col("event_id") % 2 == 0, "INT").otherwise("STRING")
    rows = table(spark, d, "events").select("event_id", V.order_key(kind, F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("k"))
    return rows.orderBy("k", "event_id").limit(50).select("event_id", F.row_number().over(Window.orderBy("k", "event_id")).cast("bigint").alias("place"))


@query("""SELECT a.event_id, (a.event_id % 2 = b.event_id % 2) AND a.user_id = b.user_id AS same,
CASE WHEN a.event_id % 2 = b.event_id % 2 THEN a.user_id < b.user_id ELSE a.event_id % 2 = 0 END AS less FROM events AS a JOIN events AS b ON b.event_id = a.event_id + 3""")
def value_comparisons(spark, d):
    kind = lambda c: F.when(F.col(c) % 2 == 0, "INT").otherwise("STRING")
    a = table(spark, d, "events").select("event_id", F.col("user_id").alias("x"))
    b = table(spark, d, "events").select((F.col("event_id") - 3).alias("event_id"), F.col("user_id").alias("y"))
    left, right = V.order_key(kind("event_id"), F.col("x")), V.order_key(F.when((F.col("event_id") + 3) % 2 == 0, "INT").otherwise("STRING"), F.col("y"))
    return a.join(b, "event_id").select("event_id", (left == right).alias("same"), (left < right).alias("less"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, year(ts) || '/' || month(ts) || '/' || day(ts) AS loose FROM events")
def parse_and_format_times(spark, d):
    ts = F.col("ts").cast("timestamp")
    loose = F.concat_ws("/", F.year(ts), F.month(ts), F.dayofmonth(ts))
    moment = V.parse_timestamp(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("moment"), V.parse_date(loose).cast("string").alias("day"), loose.alias("loose"))


@query(f"WITH {TYPED}, w AS (SELECT 'e:' || i AS key FROM range(0, 40) t(i) UNION ALL SELECT 'none:' || i FROM range(0, 5) t(i)) SELECT key, coalesce(type, 'NULL') AS type FROM w LEFT JOIN typed USING (key)")
def key_types(spark, d):
    keys = spark.range(40).select(F.concat(F.lit("e:"), "id").alias("key")).unionByName(spark.range(5).select(F.concat(F.lit("none:"), "id").alias("key")))
    return typed.key_type(typed_rows(spark, d), keys)


@query(f"""WITH {USER_SETS} SELECT user_id, array_to_string(list_transform(kinds, lambda e, i: CASE WHEN i = 2 THEN 'set' ELSE e END), ',') AS changed, 0 AS cleared, len(kinds) > 2 AS has_third, false AS has_before,
array_to_string(list_sort(list_distinct(list_append(kinds, 'new'))), ',') AS added FROM sets""")
def list_set_and_clear(spark, d):
    k = F.col("kinds")
    return user_sets(spark, d).select(
        "user_id", F.array_join(V.list_set(k, 1, F.lit("set")), ",").alias("changed"), F.size(V.list_clear(k)).alias("cleared"), V.has_index(k, 2).alias("has_third"), V.has_index(k, -1).alias("has_before"),
        F.array_join(V.set_add(k, F.lit("new")), ",").alias("added"),
    )
