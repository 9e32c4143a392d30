"""Typed values: rows (key, type, i, f, d, s, ts, dt, list, set, map, b) with one column in use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

COLUMNS = {
    "INT": ("i", "bigint"), "FLOAT": ("f", "float"), "DOUBLE": ("d", "double"), "STRING": ("s", "string"), "TIMESTAMP": ("ts", "timestamp"), "DATE": ("dt", "date"),
    "LIST": ("list", "array<string>"), "SET": ("set", "array<string>"), "MAP": ("map", "map<string,string>"), "BLOB": ("b", "binary"),
}


def rows(source: DataFrame, key, kind: str, value) -> DataFrame:
    """Typed rows of one kind from a key and a value column."""
    kind = kind.upper()
    value = F.array_sort(F.array_distinct(value)) if kind == "SET" else value
    return source.select(
        key.alias("key"), F.lit(kind).alias("type"), *[(value if k == kind else F.lit(None)).cast(t).alias(c) for k, (c, t) in COLUMNS.items()]
    )


def _limited(df: DataFrame, limit: int) -> DataFrame:
    return df.limit(limit) if limit else df


def type_scan(typed: DataFrame, kind: str, limit: int = 0) -> DataFrame:
    return _limited(typed.where(F.col("type") == kind.upper()).orderBy("key"), limit)


def range_scan(typed: DataFrame, start: str, end: str = "", limit: int = 0) -> DataFrame:
    """Both ends included; an empty end is no bound."""
    found = typed.where(F.col("key") >= start)
    return _limited((found.where(F.col("key") <= end) if end else found).orderBy("key"), limit)


def numeric_range(typed: DataFrame, low: float, high: float, limit: int = 0) -> DataFrame:
    """INT rows, then FLOAT, then DOUBLE, each by key, with values from low to high; the limit follows that order."""
    value = F.coalesce(F.col("i").cast("double"), F.col("f").cast("double"), F.col("d"))
    found = typed.where(F.col("type").isin("INT", "FLOAT", "DOUBLE")).withColumn("number", value).where(F.col("number").between(low, high))
    return _limited(found.orderBy(V.type_rank(F.col("type")), "key"), limit)


def timestamp_range(typed: DataFrame, low: str, high: str) -> DataFrame:
    return typed.where((F.col("type") == "TIMESTAMP") & F.col("ts").between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp"))).orderBy("key")


def date_range(typed: DataFrame, low: str, high: str) -> DataFrame:
    return typed.where((F.col("type") == "DATE") & F.col("dt").between(F.lit(low).cast("date"), F.lit(high).cast("date"))).orderBy("key")


def type_stats(typed: DataFrame) -> DataFrame:
    return typed.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def text(typed: DataFrame) -> DataFrame:
    """key, type and the value's text form."""
    shown = F.coalesce(
        F.col("i").cast("string"), V.fixed(F.col("f")), V.fixed(F.col("d")), F.col("s"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("dt").cast("string"),
        V.list_text(F.col("list")), V.set_text(F.col("set")), V.map_text(F.col("map")), V.blob_text(F.col("b")), F.lit("NULL"),
    )
    return typed.select("key", "type", shown.alias("text"))


def key_type(typed: DataFrame, keys: DataFrame) -> DataFrame:
    """key, type of wanted keys; NULL where a key is missing."""
    return keys.join(typed.select("key", "type"), "key", "left").select("key", F.coalesce("type", F.lit("NULL")).alias("type"))


def set_operation(typed: DataFrame, first: str, second: str, target: str, operation: str) -> DataFrame:
    """The row that union, intersection or difference of two sets writes; none unless both keys hold sets."""
    pick = {"union": V.set_union, "intersection": V.set_intersection, "difference": V.set_difference}[operation]
    sets = typed.where(F.col("key").isin(first, second) & (F.col("type") == "SET"))
    pair = sets.agg(F.max(F.when(F.col("key") == first, F.col("set"))).alias("x"), F.max(F.when(F.col("key") == second, F.col("set"))).alias("y"))
    return rows(pair.where("x is not null and y is not null"), F.lit(target), "SET", pick(F.col("x"), F.col("y")))
