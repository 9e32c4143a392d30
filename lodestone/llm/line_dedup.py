"""Operator 10 [native]: cross-site boilerplate lines by HyperLogLog spread.

A HyperLogLog sketch of the sites on which a line occurs merges by aggregation
on the line's 128-bit hash, so a line on a third of all pages is combined on the
map side.  Lists of such lines are broadcast while they are short, else joined with
salt, so that no line's rows gather in one task.  Lines whose estimate is clear of the threshold are decided by it;
those within a factor ``BAND`` of it get an exact distinct count.  Lines on at
least ``min_sites`` sites are removed from all documents but the first that has
them (the least id), so that no content vanishes altogether.

DataFrame functions only.  Defined results: a null text counts as empty and a
null site as no site; lines without a word are never boilerplate; documents may
be left with an empty text and are kept; rows equal in id and text are treated
alike; texts are taken whole; extra columns pass through :func:`remove`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, forget, small, text_or_empty

MIN_SITES, BAND, PRECISION = 10, 2.0, 10
#: Lines up to which a list is broadcast (three numbers each), and parts of a line's rows beyond.
BROADCAST_LINES, SALT = 100_000, 32
WORD = r"[^\x20\x09-\x0D]"


def _keyed(docs: DataFrame, id_column: str, text_column: str, site_column: str) -> DataFrame:
    text = text_or_empty(text_column)
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), F.col(site_column).cast("string").alias("site"), text.alias("body"))


def _lines(keyed: DataFrame) -> DataFrame:
    parts = keyed.select("id", "t1", "t2", "site", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(WORD))
    return parts.select("id", "t1", "t2", "site", "pos", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(1), "line").alias("l2"))


def _among(lines: DataFrame, listed: DataFrame) -> DataFrame:
    """The lines that are listed.  A short list is broadcast; else lines are salted by id, as one line may hold a third of all rows."""
    if small(listed, BROADCAST_LINES):
        return lines.join(F.broadcast(listed), ["l1", "l2"])
    salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return lines.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALT))).join(salted, ["l1", "l2", "salt"]).drop("salt")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """l1, l2, first: lines on at least ``min_sites`` sites and the least id that has them.  A durable table."""
    sketched = lines.groupBy("l1", "l2").agg(F.hll_sketch_agg("site", F.lit(PRECISION)).alias("sketch"), F.min("id").alias("first"))
    spread = sketched.select("l1", "l2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites / BAND)
    spread = durable(spread, "spread")
    clear = spread.where(F.col("sites") > min_sites * BAND).select("l1", "l2", "first")
    near = spread.where(F.col("sites") <= min_sites * BAND).select("l1", "l2", "first")
    counted = _among(lines, near).groupBy("l1", "l2", "first", "site").agg(F.lit(1).alias("one"))
    exact = counted.groupBy("l1", "l2", "first").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    out = durable(clear.unionByName(exact.select("l1", "l2", "first")), "boilerplate")
    forget(spread)
    return out


def _dropped(docs: DataFrame, min_sites: int, id_column: str, text_column: str, site_column: str) -> DataFrame:
    """id, t1, t2, drop: positions of the lines to remove, for documents that have any."""
    lines = _lines(_keyed(docs, id_column, text_column, site_column))
    found = boilerplate(lines.select("id", "site", "l1", "l2"), min_sites)
    hit = _among(lines.select("id", "t1", "t2", "pos", "l1", "l2"), found).where(~F.col("id").eqNullSafe(F.col("first")))
    return hit.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("drop"))


def remove(docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source") -> DataFrame:
    """The same rows and columns with boilerplate lines taken out of the text."""
    drop = _dropped(docs, min_sites, id_column, text_column, site_column)
    text = text_or_empty(text_column)
    names = [f"_d{i}" for i in range(len(docs.columns))]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.col(id_column).alias("_id"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2"))
    joined = own.join(drop, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left")
    body = names[docs.columns.index(text_column)]
    left = F.array_join(F.filter(F.split(body, "\n", -1), lambda line, i: ~F.array_contains("drop", i)), "\n")
    columns = [(F.when(F.col("drop").isNull(), F.col(n)).otherwise(left) if n == body else F.col(n)).alias(c) for c, n in zip(docs.columns, names)]
    return joined.select(*columns)


def summary(docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source") -> DataFrame:
    """id, n_lines (with a word), n_removed, kept_sha256 of every document."""
    text = text_or_empty(text_column)
    before = docs.select(F.col(id_column), text.alias("text"), F.col(site_column).alias("site"), _inked(text).alias("n_lines"))
    after = remove(before, min_sites, id_column, "text", "site")
    return after.select(id_column, "n_lines", (F.col("n_lines") - _inked(F.col("text"))).alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _inked(text):
    return F.size(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))).cast("long")
