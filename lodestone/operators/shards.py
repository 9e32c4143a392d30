"""Key ranges: routing, overlap, balance."""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import hash31


def route(rows: DataFrame, bounds: list[tuple[int, str, str]]) -> DataFrame:
    """Adds ``shard``: start <= key < end, where '' starts and '~' ends without bound; null where no range fits.

    Ranges are few, so they go into the plan as one expression instead of a range join.
    """
    shard = F.lit(None).cast("int")
    for number, start, end in reversed(bounds):
        inside = (F.col("key") >= start if start else F.lit(True)) & (F.col("key") < end if end and end != "~" else F.lit(True))
        shard = F.when(inside, F.lit(number)).otherwise(shard)
    return rows.withColumn("shard", shard)


def overlapping(bounds: list[tuple[int, str, str]], start: str, end: str) -> list[int]:
    """Shards that a scan from start to end touches."""
    return [n for n, a, b in bounds if (not end or a <= end) and (b in ("", "~") or start < b)]


def scan(rows: DataFrame, bounds: list[tuple[int, str, str]], start: str, end: str) -> DataFrame:
    """The union of the touched shards' rows in the range."""
    routed = route(rows, bounds).where(F.col("shard").isin(*overlapping(bounds, start, end)))
    return routed.where((F.col("key") >= start) & ((F.col("key") <= end) if end else F.lit(True)))


def counts(rows: DataFrame, bounds: list[tuple[int, str, str]]) -> DataFrame:
    return route(rows, bounds).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def balanced(rows: DataFrame, shards: int) -> list[tuple[int, str, str]]:
    """Ranges of about equal row counts, from approximate quantiles of a key sample that Spark's range partitioner takes."""
    parts = rows.select("key").repartitionByRange(shards, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("k")).orderBy("k").collect()
    starts = ["", *[r["k"] for r in parts[1:]]]  # one row a shard
    return [(i, a, b) for i, (a, b) in enumerate(zip(starts, [*starts[1:], "~"]))]


# Changes of ranges: each gives the bounds after it.


def split(bounds: list[tuple[int, str, str]], shard: int, at: str) -> list[tuple[int, str, str]]:
    """The shard keeps what lies before ``at``; a new shard, numbered behind all others, takes the rest."""
    start, end = next((a, b) for n, a, b in bounds if n == shard)
    if not (start < at and (end in ("", "~") or at < end)):
        raise ValueError(f"{at!r} does not lie inside shard {shard}")
    fresh = max(n for n, _, _ in bounds) + 1
    out = [(n, a, at if n == shard else b) for n, a, b in bounds]
    return sorted([*out, (fresh, at, end)], key=lambda x: x[1])


def merged(bounds: list[tuple[int, str, str]], first: int, second: int) -> list[tuple[int, str, str]]:
    """Two neighbours as one shard of the first one's number."""
    (a, b), (c, d) = (next((x, y) for n, x, y in bounds if n == shard) for shard in (first, second))
    if b != c and d != a:
        raise ValueError(f"shards {first} and {second} are no neighbours")
    whole = (first, min(a, c), d if b == c else b)
    return sorted([*[x for x in bounds if x[0] not in (first, second)], whole], key=lambda x: x[1])


def rebalanced(rows: DataFrame, bounds: list[tuple[int, str, str]], most: int) -> list[tuple[int, str, str]]:
    """Shards of more than ``most`` rows are split at the key in their middle, once."""
    found = route(rows, bounds).where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    for r in found.collect():  # one row a shard
        own = route(rows, bounds).where(F.col("shard") == r["shard"]).select("key")
        middle = balanced(own, 2)
        if len(middle) == 2:
            bounds = split(bounds, r["shard"], middle[1][1])
    return bounds


def migrated(owners: dict[int, str], shard: int, source: str, target: str) -> dict[int, str]:
    """Owners after a shard has moved; one that the source does not own stays."""
    return {n: target if n == shard and node == source else node for n, node in owners.items()}


def hashed(rows: DataFrame, shards: int) -> DataFrame:
    """Adds ``shard``: the 31-hash of the key modulo the number of shards."""
    return rows.withColumn("shard", F.pmod(hash31(F.col("key")), F.lit(shards)).cast("int"))


def ring(rows: DataFrame, nodes: list[str], virtual: int = 100, cells: int = 1024) -> DataFrame:
    """Adds ``node`` by consistent hashing over a circle of ``cells`` places (a power of two).

    A cell belongs to the first virtual point of a node at or after it, so that
    another node takes over about 1 / len(nodes) of the cells only.
    """
    bits = 32 - (cells.bit_length() - 1)
    points = sorted((zlib.crc32(f"{n}#{v}".encode()), i) for i, n in enumerate(nodes) for v in range(virtual))
    places = [p for p, _ in points]
    owners = [points[bisect.bisect_left(places, c << bits) % len(points)][1] for c in range(cells)]
    cell = F.shiftright(F.crc32(F.col("key").cast("binary")), bits).cast("int")
    owner = F.element_at(F.array(*map(F.lit, owners)), cell + 1)
    return rows.withColumn("node", F.element_at(F.array(*map(F.lit, nodes)), owner + 1))


def load_stats(rows: DataFrame) -> DataFrame:
    """Cluster figures of (node, load, healthy)."""
    return rows.agg(F.count(F.lit(1)).alias("nodes"), F.avg("load").alias("average_load"), F.count_if("healthy").alias("healthy_nodes"))
