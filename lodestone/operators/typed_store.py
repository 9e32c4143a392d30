"""A store of typed values over the version log: a value is kept as its typed JSON text.

Writers and readers are the log's; :func:`rows_of` gives the typed columns back,
so that every typed scan works on a store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from . import typed, versions


def encoded(rows: DataFrame) -> DataFrame:
    """key, value (JSON) of typed rows; a type that is none of the known ones gives NULL."""
    text = V.json_value("NULL", F.lit(None))
    for kind, (column, _) in typed.COLUMNS.items():
        text = F.when((F.col("type") == kind) & F.col(column).isNotNull(), V.json_value(kind, F.col(column))).otherwise(text)
    return rows.select("key", text.alias("value"))


def rows_of(kv: DataFrame) -> DataFrame:
    """Typed rows of key-value rows with JSON texts; texts that are none have the type NULL."""
    found = V.json_parsed(F.col("value"))
    columns = [found[kind].cast(t).alias(c) for kind, (c, t) in typed.COLUMNS.items()]
    return kv.select("key", F.coalesce(found["type"], F.lit("NULL")).alias("type"), *columns)


class TypedStore:
    """Typed puts and gets, transactions, and JSON files, over a :class:`versions.Store`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, versions.Store(spark, path)

    def _typed(self, pairs) -> DataFrame:
        """(key, kind, value) as typed rows; lists may be strings only."""
        parts = None
        for n, (key, kind, value) in enumerate(pairs):
            _, column_type = typed.COLUMNS.get(kind.upper(), ("s", "string"))
            literal = F.lit(value) if not isinstance(value, (list, dict, set)) else F.array(*map(F.lit, value)) if not isinstance(value, dict) else F.create_map(*[F.lit(x) for p in value.items() for x in p])
            own = typed.rows(self.spark.range(1), F.lit(key), kind, literal.cast(column_type)).withColumn("ordinal", F.lit(n))
            parts = own if parts is None else parts.unionByName(own)
        return parts

    def put_all(self, pairs: list[tuple]) -> None:
        """(key, kind, value) in order, as one append."""
        if pairs:
            rows = self._typed(pairs)
            texts = encoded(rows.withColumn("key", F.struct("key", "ordinal")))
            self.store.append(texts.select("key.key", "key.ordinal", "value", F.lit(False).alias("deleted")), len(pairs))

    def put(self, key: str, kind: str, value) -> None:
        self.put_all([(key, kind, value)])

    def load(self, rows: DataFrame) -> None:
        """Typed rows with distinct keys, as one append."""
        self.store.load(encoded(rows))

    def rows(self, snapshot: int | None = None) -> DataFrame:
        return rows_of(versions.latest(self.store.log, snapshot).select("key", "value"))

    def get(self, key: str):
        """(type, value), or None."""
        row = rows_of(versions.get(self.store.log, key)).first()
        if row is None:
            return None
        return row["type"], row[typed.COLUMNS[row["type"]][0]] if row["type"] in typed.COLUMNS else None

    def delete(self, key: str) -> None:
        self.store.delete(key)

    def convert(self, key: str, kind: str) -> None:
        """Rewrite a key's value as another type, where that conversion exists."""
        source, value = self.get(key)
        column, _ = typed.COLUMNS[source]
        own = rows_of(versions.get(self.store.log, key)).select(V.convert(F.col(column), source, kind).alias("v"))
        self.store.load(encoded(typed.rows(own, F.lit(key), kind, F.col("v"))))

    def put_file(self, key: str, path: str) -> None:
        """A file's bytes as a BLOB."""
        found = self.spark.read.format("binaryFile").load(path)
        self.store.load(encoded(typed.rows(found, F.lit(key), "BLOB", F.col("content"))))

    def get_file(self, key: str, path: str) -> None:
        """Write a BLOB's bytes to a file of the driver."""
        kind, value = self.get(key) or (None, None)
        if kind != "BLOB":
            raise ValueError(f"{key!r} holds no BLOB")
        with open(path, "wb") as f:
            f.write(value)

    def export_json(self, path: str) -> None:
        """Lines of {"key": ..., "value": typed JSON}."""
        versions.latest(self.store.log).select("key", "value").write.mode("overwrite").json(path)

    def import_json(self, path: str) -> None:
        self.store.load(self.spark.read.schema("key string, value string").json(path))

    def transaction(self) -> TypedTransaction:
        return TypedTransaction(self)


class TypedTransaction:
    """Writes wait for commit, which is one append; reads see the store, not the waiting writes."""

    def __init__(self, store: TypedStore):
        self.store, self.ops = store, []

    def put(self, key: str, kind: str, value) -> None:
        self.ops.append((key, kind, value))

    def delete(self, key: str) -> None:
        self.ops.append((key, None, None))

    def get(self, key: str):
        return self.store.get(key)

    def commit(self) -> None:
        last = {key: (n, kind, value) for n, (key, kind, value) in enumerate(self.ops)}
        puts = [(key, kind, value) for key, (_, kind, value) in last.items() if kind]
        gone = [key for key, (_, kind, _) in last.items() if not kind]
        rows = None
        if puts:
            rows = encoded(self.store._typed(puts)).withColumn("deleted", F.lit(False))
        if gone:
            dead = self.store.spark.createDataFrame([(k, None, True) for k in gone], "key string, value string, deleted boolean")
            rows = dead if rows is None else rows.unionByName(dead)
        if rows is not None:
            self.store.store.append(rows.withColumn("ordinal", F.lit(0)), 1)
        self.ops = []

    def rollback(self) -> None:
        self.ops = []
