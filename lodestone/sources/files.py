"""Import and export of key-value rows, logs, blobs, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KV = "key string, value string"


def detect(path: str) -> str:
    """Format by the file's ending; JSON where it tells nothing."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return {"csv": "csv", "parquet": "parquet", "json": "json", "jsonl": "json", "orc": "orc"}.get(ending, "json")


def export(rows: DataFrame, path: str, format: str | None = None, key_contains: str = "") -> None:
    """Write key and value; ``key_contains`` keeps keys with that text."""
    format = format or detect(path)
    rows = rows.where(F.col("key").contains(key_contains)) if key_contains else rows
    writer = rows.select("key", "value").write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "")
    writer.format(format).save(path)


def load(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    format = format or detect(path)
    reader = spark.read.schema(KV)
    if format == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\0").option("emptyValue", "")
    return reader.format(format).load(path)


def migrate(spark: SparkSession, source: str, target: str, key_contains: str = "") -> None:
    export(load(spark, source), target, None, key_contains)


def replay(spark: SparkSession, path: str, start_seq: int = 1) -> DataFrame:
    """Version log from text lines ``PUT key value`` and ``DEL key``; files by name, lines in order.

    The value is all behind the key's blank.  Lines are read one by one and
    numbered by file and byte range: Spark's partition of a row and its place in
    it, with the files' ranges put in order, so that no file is held whole.
    """
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value", F.monotonically_increasing_id().alias("id"))
    ranges = lines.groupBy("file_path", "file_block_start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("file_path", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)  # one row a range of a file
    ranges = ranges.select(F.col("file_path").alias("p"), F.col("file_block_start").alias("b"), "first", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    parts = F.split("value", " ", 3)
    kind = F.upper(F.element_at(parts, 1))
    rows = lines.join(ranges, (F.col("file_path") == F.col("p")) & (F.col("file_block_start") == F.col("b"))).where(kind.isin("PUT", "DEL") & (F.size(parts) >= 2))
    seq = (F.col("base") + F.col("id") - F.col("first") + start_seq).cast("bigint")
    return rows.select(F.element_at(parts, 2).alias("key"), seq.alias("seq"), F.when(kind == "PUT", F.coalesce(F.get(parts, 2), F.lit(""))).alias("value"), (kind == "DEL").alias("deleted"))


def since(log: DataFrame, seq: int, upto: int | None = None) -> DataFrame:
    """What a log has behind a sequence number, up to another one."""
    rows = log.where(F.col("seq") > seq)
    return rows.where(F.col("seq") <= upto) if upto is not None else rows


def read_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a Parquet table; the others are not read."""
    return spark.read.parquet(path).select(column)


def records_where(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """The records whose column has a value; row groups that cannot have it are skipped."""
    return spark.read.parquet(path).where(F.col(column) == value)


def keyed(rows: DataFrame, path: str, codec: str = "snappy", key: str = "key") -> None:
    """Write a table for point reads: sorted key ranges, a Bloom filter of the keys in each row group, compressed by a codec."""
    writer = rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("compression", codec)
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", "1000000").parquet(path)


def codec_sizes(rows: DataFrame, path: str, codecs: tuple[str, ...] = ("none", "snappy", "lz4", "gzip", "zstd")) -> dict[str, int]:
    """Bytes of a table under each codec, by writing it below ``path`` in the tasks that read it."""
    spark, out = rows.sparkSession, {}
    for codec in codecs:
        rows.write.mode("overwrite").option("compression", codec).parquet(f"{path}/{codec}")
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{codec}")
        out[codec] = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(found).getLength()
    return out


#: How a rewrite lays out a table, by strategy: rows a file, and what the files are ordered or cut by.
LAYOUTS = {"LEVELED": 1_000_000, "TIERED": 4_000_000, "SIZE_TIERED": 2_000_000, "TIME_WINDOW": 1_000_000}


def rewrite(rows: DataFrame, path: str, strategy: str = "LEVELED", time: str | None = None, window: str = "day") -> None:
    """Write a table in the layout of a strategy: key ranges that do not meet (LEVELED), sorted runs of some size, or folders by time window."""
    writer = rows
    if strategy == "TIME_WINDOW":
        writer = rows.withColumn("window", F.date_trunc(window, F.col(time).cast("timestamp")).cast("date")).repartition("window").sortWithinPartitions("window", "key").write.partitionBy("window")
    elif strategy == "LEVELED":
        writer = rows.repartitionByRange("key").sortWithinPartitions("key").write
    else:
        writer = rows.sortWithinPartitions("key").write
    writer.option("maxRecordsPerFile", LAYOUTS[strategy]).mode("overwrite").parquet(path)


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """key (path), b: whole files as bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("key"), F.col("content").alias("b"))


def backup(log: DataFrame, path: str, after: int | None = None) -> None:
    """A full copy of a log, or of what came after a sequence number."""
    (since(log, after) if after is not None else log).write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, paths: list[str], upto: int | None = None) -> DataFrame:
    """The log of a full backup and those after it, up to a sequence number."""
    out = spark.read.parquet(*paths)
    return out.where(F.col("seq") <= upto) if upto is not None else out
