"""Query engine over key-value rows (key, value): filters, aggregates, ordered scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Condition, combined, glob, number


def _limited(rows: DataFrame, limit: int) -> DataFrame:
    return rows.limit(limit) if limit else rows


class QueryEngine:
    """Every method returns a lazy DataFrame; a limit of 0 is none."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("key", "value")

    def where(self, condition: Condition, limit: int = 0) -> DataFrame:
        return self.where_multiple([condition], True, limit)

    def where_multiple(self, conditions: list[Condition], use_and: bool = True, limit: int = 0) -> DataFrame:
        """The first rows in key order that fulfil all (or any) conditions."""
        return _limited(self.rows.where(combined(conditions, use_and)).orderBy("key"), limit)

    def where_ordered(self, condition: Condition, descending: bool = False, limit: int = 0) -> DataFrame:
        """Sort, then limit: the true top of the matching keys."""
        rows = self.rows.where(condition.column())
        return _limited(rows.orderBy(F.desc("key") if descending else F.asc("key")), limit)

    def keys(self, pattern: str = "") -> DataFrame:
        return self.rows.where(glob(F.col("key"), pattern)).select("key").orderBy("key")

    def count(self, condition: Condition | None = None) -> DataFrame:
        rows = self.rows.where(condition.column()) if condition else self.rows
        return rows.agg(F.count(F.lit(1)).alias("count"))

    def aggregate(self, pattern: str = "") -> DataFrame:
        """count, sum, avg, min, max over values that start with a number; zeros where there are none."""
        value = number(F.col("value"))
        found = self.rows.where(glob(F.col("key"), pattern)).select(value.alias("v")).where("v is not null")
        zero = F.lit(0.0)
        return found.agg(
            F.count("v").alias("count"), *[F.coalesce(f("v"), zero).alias(n) for n, f in (("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max))]
        )

    def sum_values(self, pattern: str = "") -> DataFrame:
        return self.aggregate(pattern).select("count", "sum", "avg")

    avg_values = sum_values

    def min_max_values(self, pattern: str = "") -> DataFrame:
        return self.aggregate(pattern)

    def scan_ordered(self, start: str = "", end: str = "", descending: bool = False, limit: int = 0, top_k: bool = False) -> DataFrame:
        """Keys from start to end inclusive, '' being no bound.

        Descending, the limit takes the first keys in ascending order and then
        turns them round; ``top_k`` takes the last keys instead.
        """
        rows = self.rows.where(F.col("key") >= start) if start else self.rows
        return self._ordered(rows.where(F.col("key") <= end) if end else rows, descending, limit, top_k)

    def prefix_scan_ordered(self, prefix: str, descending: bool = False, limit: int = 0, top_k: bool = False) -> DataFrame:
        return self._ordered(self.rows.where(F.col("key").startswith(prefix)), descending, limit, top_k)

    @staticmethod
    def _ordered(rows: DataFrame, descending: bool, limit: int, top_k: bool) -> DataFrame:
        if not descending:
            return _limited(rows.orderBy("key"), limit)
        if limit and not top_k:
            rows = rows.orderBy("key").limit(limit)
        return _limited(rows.orderBy(F.desc("key")), limit)
