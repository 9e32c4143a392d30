"""Secondary and composite indexes as derived tables, a catalog of them, and advice on new ones."""

from __future__ import annotations

from copy import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Condition
from ..functions.values import composite_key
from . import text_index

FREQUENT_USE = 5


class Secondary:
    """(value, key): exact, range and prefix lookups in string order."""

    def __init__(self, rows: DataFrame, key, value, unique: bool = False):
        self.rows = rows.select(value.alias("value"), key.alias("key")).where("value is not null")
        if unique and (twice := self.violations().first()):
            raise ValueError(f"{twice['value']!r} stands for {twice['n']} keys")

    def violations(self) -> DataFrame:
        """Values with more than one key."""
        return self.rows.groupBy("value").agg(F.count_distinct("key").alias("n")).where("n > 1")

    def exact(self, value: str) -> DataFrame:
        return self.rows.where(F.col("value") == value).select("key").orderBy("key")

    def between(self, low: str, high: str) -> DataFrame:
        return self.rows.where(F.col("value").between(low, high)).orderBy("value", "key")

    def prefix(self, prefix: str) -> DataFrame:
        return self.rows.where(F.col("value").startswith(prefix)).orderBy("value", "key")

    def updated(self, changes: DataFrame) -> Secondary:
        """The index after writes: ``changes`` has value and key; a null value takes the key's entry away."""
        out = copy(self)
        kept = self.rows.join(changes.select("key").distinct(), "key", "left_anti")
        out.rows = kept.select("value", "key").unionByName(changes.select("value", "key").where("value is not null"))
        return out

    def stats(self) -> DataFrame:
        """entries, distinct_values and their ratio."""
        return self.rows.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("value").alias("distinct_values")).withColumn(
            "selectivity", F.when(F.col("entries") > 0, F.col("distinct_values") / F.col("entries")).otherwise(0.0)
        )


class Composite(Secondary):
    """A secondary index on fields joined by a bar."""

    def __init__(self, rows: DataFrame, key, fields: list, unique: bool = False):
        super().__init__(rows, key, composite_key(*[f.cast("string") for f in fields]), unique)

    def exact_fields(self, *values: str) -> DataFrame:
        return self.exact("|".join(values))

    def prefix_fields(self, *values: str, strict: bool = False) -> DataFrame:
        """Leading fields; unless ``strict``, the last one may go on ('a' also finds 'ab')."""
        joined = "|".join(values)
        if not strict:
            return self.prefix(joined)
        return self.rows.where((F.col("value") == joined) | F.col("value").startswith(joined + "|")).orderBy("value", "key")


class Catalog:
    """Named indexes over one key-value table; they are plans, so writes show on the next read."""

    def __init__(self, rows: DataFrame):
        self.rows, self.indexes = rows, {}

    def create_secondary(self, name: str, field=None, unique: bool = False) -> None:
        self._add(name, Secondary(self.rows, F.col("key"), F.col("value") if field is None else field, unique))

    def create_composite(self, name: str, fields: list, unique: bool = False) -> None:
        self._add(name, Composite(self.rows, F.col("key"), fields, unique))

    def create_fulltext(self, name: str) -> None:
        self._add(name, text_index.postings(self.rows, "key", "value"))

    def _add(self, name, index):
        if name in self.indexes:
            raise ValueError(f"index {name!r} exists")
        self.indexes[name] = index

    def drop(self, name: str) -> None:
        del self.indexes[name]

    def names(self) -> list[str]:
        return sorted(self.indexes)

    def lookup(self, name: str, kind: str, *terms: str) -> DataFrame:
        """kind: exact, range, prefix, search, any, phrase or wildcard."""
        index = self.indexes[name]
        if isinstance(index, Secondary):
            return {"exact": index.exact, "range": index.between, "prefix": index.prefix}[kind](*terms)
        if kind == "phrase":
            return text_index.search_phrase(index, [t.lower() for t in terms])
        if kind == "any":
            return text_index.search_any(index, list(terms))
        return {"search": text_index.search, "wildcard": text_index.search_wildcard}[kind](index, *terms)

    def fetch(self, name: str, kind: str, *terms: str) -> DataFrame:
        """The key-value rows that a lookup points at."""
        found = self.lookup(name, kind, *terms)
        return self.rows.join(found.select(F.col(found.columns[-1] if "key" in found.columns else "doc").alias("key")).distinct(), "key", "left_semi")

    def save(self, name: str, path: str) -> None:
        index = self.indexes[name]
        if isinstance(index, Secondary):
            index.rows.repartitionByRange("value").sortWithinPartitions("value", "key").write.mode("overwrite").parquet(path)
        else:
            text_index.save(index, path)

    def load(self, name: str, path: str) -> None:
        """A saved index under a name, instead of the one made from the rows."""
        rows = self.rows.sparkSession.read.parquet(path)
        if "term" in rows.columns:
            self._add(name, rows)
        else:
            self._add(name, Secondary(rows, F.col("key"), F.col("value")))

    def write(self, changes: DataFrame) -> None:
        """Rows (key, value) written to the table; a null value deletes.  Secondary and full-text indexes on the value follow."""
        changed = changes.select("key", "value")
        self.rows = self.rows.join(changed.select("key"), "key", "left_anti").select(*self.rows.columns).unionByName(changed.where("value is not null"), allowMissingColumns=True)
        texts = changed.select("key", F.coalesce("value", F.lit("")).alias("value"))
        for name, index in self.indexes.items():
            if isinstance(index, Composite):
                raise ValueError(f"index {name!r} has fields of its own; make it again")
            self.indexes[name] = index.updated(changed) if isinstance(index, Secondary) else text_index.updated(index, texts, "key", "value")

    def rebuild(self, name: str) -> None:
        """Make an index on the value from the rows as they are now."""
        index = self.indexes.pop(name)
        self.create_secondary(name) if isinstance(index, Secondary) else self.create_fulltext(name)

    def stats(self) -> DataFrame:
        """name, kind, entries and distinct values (or terms) of each index."""
        out = None
        for name in self.names():
            index = self.indexes[name]
            kind, rows, value = ("SECONDARY", index.rows, "value") if isinstance(index, Secondary) else ("FULLTEXT", index, "term")
            kind = "COMPOSITE" if isinstance(index, Composite) else kind
            own = rows.agg(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("entries"), F.count_distinct(value).alias("distinct_values"))
            out = own if out is None else out.unionByName(own)
        return out


def condition_log(conditions: list[Condition], spark) -> DataFrame:
    return spark.createDataFrame([(c.field, c.operator) for c in conditions] or [("", "")], "field string, operator string").where("field <> ''")


def recommend(log: DataFrame) -> DataFrame:
    """name, kind, field, gain: an index for each field used five times or more, full text for LIKE on the value."""
    often = log.groupBy("field").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT_USE)
    secondary = often.select(F.concat("field", F.lit("_idx")).alias("name"), F.lit("SECONDARY").alias("kind"), "field", (F.col("n") * 0.8).alias("gain"))
    like = log.where("operator = 'LIKE' and field = 'value'").limit(1)
    return secondary.unionByName(like.select(F.lit("value_fulltext_idx").alias("name"), F.lit("FULLTEXT").alias("kind"), "field", F.lit(10.0).alias("gain")))
