"""Summaries of measurements: percentiles, rates, thresholds, alerts, trends.

Exact ranks come from counts per distinct value, which are combined on the map
side; windows then sum the counts of those ranges of values that hold the ranks.
"""

from __future__ import annotations

import html
import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming import windows

#: Ranges that a group's values are cut into.
PARTS = 64


def ranked_values(rows: DataFrame, group: list[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """For each group n, mean and the values at given 0-based ranks; a pick may use the column ``n``.

    A group's distinct values are cut into PARTS ranges at approximate quantiles.
    Counts of the ranges tell which of them hold the ranks, and only those are
    sorted, so that one large group is no one task.  The tables of cuts and ranges
    are small, and adaptive execution broadcasts them where they are.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = F.percentile_approx(value, F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), F.lit(10 * PARTS))
    edges = counts.groupBy(*group).agg(cuts.alias("_cuts"), F.sum("_c").alias("n"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"))
    placed = counts.join(edges, group).withColumn("_part", F.size(F.filter("_cuts", lambda e: e < F.col(value)))).drop("_cuts")
    sums = placed.groupBy(*group, "_part", "n").agg(F.sum("_c").alias("_s"))
    upto = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows a group at most
    parts = sums.withColumn("_before", F.coalesce(F.sum("_s").over(upto), F.lit(0)))
    parts = parts.where(reduce(or_, [(F.col("_before") <= p) & (p < F.col("_before") + F.col("_s")) for p in picks.values()])).drop("_s", "n")
    within = Window.partitionBy(*group, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(parts, [*group, "_part"]).select(*group, "n", "mean", F.col(value).alias("_v"), "_c", (F.col("_before") + F.sum("_c").over(within)).alias("_upto"))
    out = [F.max(F.when((F.col("_upto") > p) & (F.col("_upto") - F.col("_c") <= p), F.col("_v"))).alias(name) for name, p in picks.items()]
    return ranked.groupBy(*group, "n", "mean").agg(*out)


def percentiles(rows: DataFrame, group: list[str], value: str, points: list[float]) -> DataFrame:
    """Nearest rank floor(p / 100 * (n - 1)), with mean and count."""
    return ranked_values(rows, group, value, {f"p{p:g}".replace(".", "_"): F.floor(F.lit(p / 100) * (F.col("n") - 1)) for p in points})


def op_summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, p95 and p99 of each operation, ranks being floor(n * p)."""
    return ranked_values(rows, group, value, {"p95": F.floor(F.col("n") * 0.95), "p99": F.floor(F.col("n") * 0.99)})


def rate(rows: DataFrame, time: str = "ts", width: str = "1 second") -> DataFrame:
    """Rows per window."""
    return rows.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def alerts(rows: DataFrame, group: list[str], time: str, condition: Column, cooldown_seconds: float) -> DataFrame:
    """Rows that fire: the condition holds and the last alert of the group lies a cooldown back.

    Whether a row fires depends on the last one that did: firing times are the
    starts of windows anchored at the data, which stream through one task a
    group; only times that fulfil the condition travel.
    """
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in group]
    hot = rows.where(condition).select(F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("key"), time)
    fired = windows.tumbling(hot, int(cooldown_seconds * 1e6), "key", time)
    return fired.select(F.from_json("key", ", ".join(kinds)).alias("g"), "start").select("g.*", F.col("start").alias("us"))


def notify(found: DataFrame, handlers: list) -> int:
    """Hand each alert (a row as a dict) to every handler; alerts are few, and stream partition by partition."""
    n = 0
    for row in found.toLocalIterator():
        n += 1
        for handler in handlers:
            handler(row.asDict(recursive=True))
    return n


def log_handler(path: str):
    """A handler that appends a line an alert to a file of the driver."""

    def write(alert: dict) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(" ".join(f"{k}={v}" for k, v in alert.items()) + "\n")

    return write


def thresholds(rows: DataFrame, limits: dict[str, float]) -> DataFrame:
    """metric, value, breached for columns against fixed limits."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), (F.col(c) > v).alias("breached")) for c, v in limits.items()])
    return rows.select(F.explode(pairs).alias("m")).select("m.*")


def trend(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Straight line by least squares: slope, intercept, r2."""
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def anomalies(rows: DataFrame, group: list[str], value: str, sigmas: float = 3.0) -> DataFrame:
    """Rows further than ``sigmas`` standard deviations from their group's mean."""
    stats = rows.groupBy(*group).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_dev"))
    joined = rows.join(stats, group)
    return joined.withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_dev")).where(F.abs("z") > sigmas).drop("_mean", "_dev")


def top_keys(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(k)


def query_patterns(log: DataFrame) -> DataFrame:
    """field, operator, n, mean and worst time of logged conditions (field, operator, took)."""
    return log.groupBy("field", "operator").agg(F.count(F.lit(1)).alias("n"), F.avg("took").alias("mean"), F.max("took").alias("worst"))


def growth(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Exponential growth: the straight line through ln(y) over x, as rate and start."""
    fit = trend(rows.where(F.col(y) > 0).withColumn("_ln", F.ln(y)), x, "_ln")
    return fit.select(F.exp("slope").alias("rate"), F.exp("intercept").alias("start"), "r2")


def seasonal(rows: DataFrame, time: str, value: str, period: str = "hour") -> DataFrame:
    """The mean of each part of the period (hour of the day, day of the week) against the mean of all."""
    part = {"hour": F.hour, "weekday": F.dayofweek, "month": F.month}[period](F.col(time).cast("timestamp"))
    means = rows.groupBy(part.alias("part")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return means.withColumn("share", F.col("mean") / rows.agg(F.avg(value)).scalar())


def as_json(metrics: dict[str, dict[str, float]]) -> str:
    """Groups of numbers as JSON."""
    return json.dumps(metrics, indent=2, sort_keys=True)


def as_html(metrics: dict[str, float], title: str = "Metrics") -> str:
    """A page with a table of numbers."""
    rows = "".join(f"<tr><td>{html.escape(k)}</td><td>{v:g}</td></tr>" for k, v in sorted(metrics.items()))
    return f"<!doctype html><title>{html.escape(title)}</title><table>{rows}</table>"


def prometheus(metrics: dict[str, float], prefix: str = "lodestone") -> str:
    """Exposition text of a few numbers."""
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v:g}\n" for k, v in sorted(metrics.items()))
