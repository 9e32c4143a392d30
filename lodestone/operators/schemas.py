"""Type guesses and field statistics of records of strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import SPARK_TYPE, inferred_type, key_pattern


def fields(records: DataFrame) -> DataFrame:
    """field, value: the non-null fields of all records, one row each."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in records.columns])
    return records.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null")


def votes(records: DataFrame) -> DataFrame:
    """field, type, n."""
    return fields(records).groupBy("field", inferred_type(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def infer(records: DataFrame) -> DataFrame:
    """field, type, n, optional: the most frequent type, the first by name among equals."""
    total = records.agg(F.count(F.lit(1))).scalar()
    best = votes(records).groupBy("field").agg(F.min_by("type", F.struct((-F.col("n")).alias("a"), F.col("type"))).alias("type"), F.max("n").alias("votes"), F.sum("n").alias("n"))
    return best.select("field", "type", "votes", (F.col("n") < total).alias("optional"))


def spark_schema(records: DataFrame) -> str:
    """The guesses as a DDL string, fields by name."""
    return ", ".join(f"`{r['field']}` {SPARK_TYPE[r['type']]}" for r in infer(records).orderBy("field").collect())


def field_stats(records: DataFrame) -> DataFrame:
    """field, frequency, bytes, coverage."""
    total = records.agg(F.count(F.lit(1))).scalar()
    stats = fields(records).groupBy("field").agg(F.count(F.lit(1)).alias("frequency"), F.sum(F.octet_length("value")).alias("bytes"))
    return stats.select("field", "frequency", "bytes", (F.col("frequency") / total).alias("coverage"))


def compression_potential(records: DataFrame) -> DataFrame:
    """One row: text bytes, binary bytes, and the share that binary saves."""
    value = F.octet_length("value")
    kind = inferred_type(F.col("value"))
    binary = F.when(kind == "BOOL", 1).when(kind.isin("VARINT", "INT32", "UINT32"), 4).when(kind.isin("INT64", "UINT64", "DOUBLE"), 8).otherwise(value + 2)
    sums = fields(records).agg(F.sum(F.octet_length("field") + value + 2).alias("text_bytes"), F.sum(binary).alias("binary_bytes"))
    return sums.withColumn("potential", F.when(F.col("text_bytes") > 0, 1 - F.col("binary_bytes") / F.col("text_bytes")).otherwise(0.0))


def pattern_groups(rows: DataFrame, least: int = 1) -> DataFrame:
    """pattern, n: keys by their form with digits starred, from ``least`` members on."""
    return rows.groupBy(key_pattern(F.col("key")).alias("pattern")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def latest_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    place = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
