"""Operator 6: URL block and allow lists by hashed host-suffix and path-prefix expressions.

Each URL expands into the expressions a rule could have: its last labels (as
many as some rule's host has) times its path's prefixes (as long as some rule's
path is).  The SHA-256 of an expression is joined with the rules' on its first
eight hex digits, the whole digest confirms, and the longest rule wins (then
the longer host, then block before allow).

Defined results: a null URL or one without ``://`` has an empty host and path
and gets the default verdict; repeated rows each give a row; the expansion is
bounded by the rules' label counts and lengths however long a URL is; other
columns are not read; without rules every row gets the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small

#: Rules up to this number are broadcast (a digest, a rule text and a verdict each).
BROADCAST_RULES = 100_000
#: Copies of a row that one array stands for.
COPIES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every page.

    ``rules`` has host, path and verdict ('allow' or 'block').
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null").distinct()
    fold = F.col("host")
    shapes = rules.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")
    ).first()  # bounded: label counts of a host name and lengths of a path
    labels = F.array(*[F.lit(x) for x in sorted(shapes["labels"])]) if shapes["labels"] else F.array().cast("array<int>")
    lengths = F.array(*[F.lit(x) for x in sorted(shapes["lengths"])]) if shapes["lengths"] else F.array().cast("array<int>")

    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    pages = pages.select(
        F.col(id_column).alias("id"), F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path")
    )
    # equal rows are judged once; the same partitioning serves the last aggregation
    pages = pages.groupBy("id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    names = F.split(fold, r"\.")
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(names)), lambda n: F.array_join(F.slice(names, F.size(names) - n + 1, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat(h, p).cast("binary"), 256))))
    expressions = pages.select("id", "host", "path", "copies", F.explode_outer(F.array_distinct(digests)).alias("digest"))
    expressions = expressions.withColumn("short", F.substring("digest", 1, 8))

    text = F.concat("host", "path")
    rank = F.struct(F.length(text).alias("a"), F.length("host").alias("b"), (F.col("verdict") == "block").alias("c"), text.alias("rule"), F.col("verdict").alias("verdict"))
    listed = rules.select(F.sha2(text.cast("binary"), 256).alias("rule_digest"), rank.alias("rank"))
    listed = listed.withColumn("rule_short", F.substring("rule_digest", 1, 8))
    if small(listed, BROADCAST_RULES):
        listed = F.broadcast(listed)
    hit = (F.col("short") == F.col("rule_short")) & (F.col("digest") == F.col("rule_digest"))
    best = expressions.join(listed, hit, "left").groupBy("id", "host", "path", "copies").agg(F.max("rank").alias("rank"))
    out = best.select("id", "host", "path", F.col("rank.rule").alias("rule"), F.coalesce("rank.verdict", F.lit(default)).alias("verdict"), "copies")
    # as many rows as there were, in steps, so that no array grows with the number of copies
    out = out.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES).cast("bigint"), F.col("copies") - F.col("step") * COPIES))))
    return out.select(F.col("id").alias(id_column), "host", "path", "rule", "verdict")
