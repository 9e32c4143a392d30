"""Operator 1: near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors of a label form one class.  Centres come from a bounded sample
(``SAMPLE`` vectors, ``MAX_CELLS`` centres); every class is then assigned to its
nearest centre, and also probes each later cell that could hold a neighbour: two
unit vectors with cosine t are at most e = sqrt(2 - 2t) apart, so if the other's
nearest centre is c and this one's is h, then x.(h - c) <= e |h - c|.  No pair is
lost, whatever the centres are.  The members of a label's cell are split into
blocks, those at home and those that probe apart, and each block is one row.  Two
blocks are two matrices, multiplied in double precision, and give link counts and
a spanning forest, never pairs; blocks of probes do not meet each other.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without a label, link with nothing; vectors of different
lengths do not link; repeated rows are vectors of their own; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow, durable, looked_up
from .components import components

SAMPLE, MAX_CELLS, CELL, BLOCK, ROUNDS = 20_000, 1024, 4096, 512, 12


def _classes(table: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """id, key (null where it links with nothing), label, vec (unit, doubles as bytes)."""
    id_type = table.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat, size = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
            edge = np.concatenate([[0], np.cumsum(size)])
            values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            keys, units = [], []
            for i, label in enumerate(batch.column(1).to_pylist()):
                key = unit = None
                x = values[edge[i] : edge[i + 1]]
                most = np.abs(x).max(initial=0.0)  # infinite or no number where a component is
                if label is not None and np.isfinite(most) and most > 0:
                    y = x / most  # squares neither overflow nor vanish
                    unit = (y / np.sqrt(y @ y)).tobytes()
                    key = hashlib.blake2b(x.tobytes() + label.encode(), digest_size=16, salt=len(x).to_bytes(8, "little")).digest()
                keys.append(key)
                units.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1), pa.array(units, pa.binary())], ["id", "key", "label", "vec"])

    given = table.select(F.col(id_column).alias("id"), F.col(label_column).cast("string").alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    return arrow(given, run, f"id {id_type}, key binary, label string, vec binary")


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centres of unit vectors."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.sqrt((total**2).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, total / np.maximum(size, 1e-300), centres)
    return centres


def centres_of(classes: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Centres for each vector length, from the SAMPLE classes with the least keys."""
    k = int(min(MAX_CELLS, max(1, -(-count // CELL))))
    rows = classes.select("key", "vec").orderBy("key").limit(SAMPLE).collect()
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r["vec"]) // 8, []).append(np.frombuffer(r["vec"]))
    return {n: spherical_kmeans(np.stack(x), min(k, len(x))) for n, x in by_size.items()}


def _assign(classes: DataFrame, centres: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """A row for each class's own cell and one for each later cell that it must probe."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9

    def run(batches):
        for batch in batches:
            vec = batch.column(2).to_pylist()
            row, cell, probe = [], [], []
            sizes = np.array([len(v) // 8 for v in vec], np.int64)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                c = centres.get(int(n))
                if c is None:  # a length that the sample lacks: one cell
                    row.append(at), cell.append(np.zeros(len(at), np.int64)), probe.append(np.zeros(len(at), bool))
                    continue
                apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                for part in np.split(at, range(4096, len(at), 4096)):
                    dots = np.stack([np.frombuffer(vec[i]) for i in part]) @ c.T
                    home = dots.argmax(axis=1)
                    near = dots[np.arange(len(part)), home][:, None] - dots <= reach * apart[home] + 1e-9
                    near &= np.arange(len(c))[None, :] > home[:, None]
                    r, to = np.nonzero(near)
                    row += [part, part[r]]
                    cell += [home, to]
                    probe += [np.zeros(len(part), bool), np.ones(len(r), bool)]
            row, cell, probe = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((row, np.int64), (cell, np.int64), (probe, bool)))
            taken = batch.take(pa.array(row))
            size = pa.array(sizes[row])
            yield pa.RecordBatch.from_arrays([*taken.columns, size, pa.array(cell), pa.array(probe)], ["key", "label", "vec", "n", "size", "cell", "probe"])

    return arrow(classes.select("key", "label", "vec", "n"), run, "key binary, label string, vec binary, n bigint, size bigint, cell bigint, probe boolean")


def forest(links: np.ndarray) -> np.ndarray:
    """The least node that each node of a boolean adjacency matrix reaches."""
    n = len(links)
    root, todo = np.arange(n), np.ones(n, bool)
    for i in range(n):
        if todo[i]:
            front = np.zeros(n, bool)
            front[i] = True
            todo[i] = False
            while front.any():
                front = links[front].any(axis=0) & todo
                todo &= ~front
                root[front] = i
    return root


def _compare(cosine: float):
    """Links between two blocks of a cell, or within one: a, the least class that it reaches here, number of links."""

    def run(batches):
        for batch in batches:
            sides = []
            for c in (0, 1):
                lists = batch.column(c)
                flat, edge = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                sides.append((flat.field("key").to_pylist(), flat.field("n").to_numpy(), flat.field("vec").to_pylist(), edge))
            for row, same in enumerate(batch.column(2).to_pylist()):
                (a_key, a_n, a_vec), (b_key, b_n, b_vec) = ([x[e[row] : e[row + 1]] for x in (k, n, v)] for k, n, v, e in sides)
                x = np.frombuffer(b"".join(a_vec)).reshape(len(a_vec), -1)
                if same:
                    key, n, links = a_key, a_n, x @ x.T >= cosine
                    np.fill_diagonal(links, False)
                else:
                    y = np.frombuffer(b"".join(b_vec)).reshape(len(b_vec), -1)
                    key, n = a_key + b_key, np.concatenate([a_n, b_n])
                    links = np.zeros((len(key), len(key)), bool)
                    links[: len(a_key), len(a_key) :] = x @ y.T >= cosine
                    links |= links.T
                count = links @ n
                some = np.flatnonzero(count)
                root = forest(links)
                yield pa.RecordBatch.from_arrays([pa.array([key[i] for i in some], pa.binary()), pa.array([key[root[i]] for i in some], pa.binary()), pa.array(count[some], pa.int64())], ["a", "b", "links"])

    return run


def _block_pairs(placed: DataFrame) -> DataFrame:
    """x, y (blocks as arrays of classes), same: pairs of blocks with a home block on one side at least.

    A block is one row, however many members it has; a cell's home blocks meet
    each other once and its probe blocks each, and probes do not meet probes.
    """
    cell = ["label", "size", "cell"]
    sizes = placed.groupBy(*cell).agg(F.count_if(~F.col("probe")).alias("homes"), F.count_if("probe").alias("probes"))
    split = placed.join(sizes, cell)
    split = split.withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.when(F.col("probe"), F.col("probes")).otherwise(F.col("homes")) / BLOCK)))
    blocks = split.groupBy(*cell, "probe", "block").agg(F.first("homes").alias("homes"), F.collect_list(F.struct("key", "n", "vec")).alias("x"))  # a block's worth
    blocks = durable(blocks, "blocks")
    last = F.when(F.col("probe"), F.ceil(F.col("homes") / BLOCK) - 1).otherwise(F.col("block"))
    sent = blocks.where("homes > 0").select(*cell, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"), F.col("x").alias("y"), (~F.col("probe")).alias("home"), F.col("block").alias("from"))
    own = blocks.where("not probe").select(*cell, "block", "x")
    return own.join(sent, [*cell, "block"]).select("x", "y", (F.col("home") & (F.col("block") == F.col("from"))).alias("same"))


def near_duplicates(table: DataFrame, cosine: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    rows = durable(_classes(table, id_column, vector_column, label_column), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = durable(classes, "classes")
    placed = durable(_assign(classes, centres_of(classes, classes.count()), cosine), "cells")
    found = durable(arrow(_block_pairs(placed), _compare(cosine), "a binary, b binary, links bigint"), "links")
    linked = found.groupBy("a").agg(F.sum("links").alias("links"))
    reach = components(found.select("a", "b"))
    least = reach.join(classes.select(F.col("key").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    named = reach.join(least, "root").select(F.col("node").alias("key"), "component")
    told = classes.select("key", "n", "least").join(linked.withColumnRenamed("a", "key"), "key", "left").join(named, "key", "left")
    told = told.select(F.col("key").alias("k"), "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component"))
    out = looked_up(rows.select("id", "key"), durable(told, "told"), "n")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
