"""Operator 4: pack documents into sequences by shortest-pack-first on the length histogram.

A document is its ids and an end id.  It is cut into pieces of the sequence
length and a rest; the histogram of piece lengths (at most ``limit`` rows) goes
to the driver, where lengths are placed longest first, each into the shortest
pack with room, by updating counts of packing patterns.  Patterns become slot
ranges per length, and a piece finds its slot by its rank among the pieces of
its length.  Ranks are a task's own count plus the sum of the tasks before it,
so no length gathers in one task.

Defined results: a null or empty text is the end id alone; documents longer
than a sequence are cut, each id in one piece; repeated rows are packed each;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from ._common import arrow, durable

LIMIT, END = 2048, 1


def patterns(histogram: dict[int, int], limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of every packing pattern; their lengths use up the histogram."""
    packs: dict[int, list[list]] = {}  # open packs by total length
    heap: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(count, pattern, total):
        if total >= limit:
            done.append((count, pattern))
            return
        if not packs.get(total):
            packs[total] = []
            heapq.heappush(heap, total)
        packs[total].append([count, pattern])

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        n = histogram[length]
        while n:
            while heap and not packs.get(heap[0]):
                heapq.heappop(heap)
            if heap and heap[0] + length <= limit:
                total = heap[0]
                count, pattern = packs[total].pop()
                used = min(n, count)
                if used < count:
                    packs[total].append([count - used, pattern])
                put(used, (*pattern, length), total + length)
                n -= used
            else:  # no pack has room: new ones, which the same length goes on to fill
                each = limit // length
                if n >= each:
                    put(n // each, (length,) * each, each * length)
                if n % each:
                    put(1, (length,) * (n % each), n % each * length)
                n = 0
    done += [(count, pattern) for group in packs.values() for count, pattern in group]
    return done


def slots(found: list[tuple[int, tuple[int, ...]]]):
    """Slot ranges, ordered by (length, first rank): those two, first sequence and offset."""
    filled: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in found:
        offset = 0
        for length in pattern:
            rank = filled.get(length, 0)
            rows.append((length, rank, sequence, offset))
            filled[length] = rank + count
            offset += length
        sequence += count
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


def pieces(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT, end_id: int = END, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut documents; ``task`` and ``local`` number the pieces of each length within a task."""
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, local bigint" + ", ids array<int>" * with_ids

    def run(batches):
        from pyspark import TaskContext

        encoder, task = bpe.of_merges(vocabulary_path), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            who, start, size, crc, total, local, own = [], [], [], [], [], [], []
            for first, ids, off in bpe.encoded(batch.column(1), encoder):
                for i in range(len(off) - 1):
                    doc = np.append(ids[off[i] : off[i + 1]], np.int32(end_id)).astype("<u4")
                    for at in range(0, len(doc), limit):
                        piece = doc[at : at + limit]
                        n = len(piece)
                        who.append(first + i)
                        start.append(at)
                        size.append(n)
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(doc))
                        local.append(seen.get(n, 0))
                        seen[n] = local[-1] + 1
                        if with_ids:
                            own.append(piece.astype(np.int32))
            longs = [pa.array(x, pa.int64()) for x in (start, size, crc, total)]
            columns = [batch.column(0).take(pa.array(who, pa.int64())), *longs, pa.array([task] * len(who), pa.int32()), pa.array(local, pa.int64())]
            if with_ids:
                columns.append(pa.array(own, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [id_column, "start", "length", "ids_crc32", "doc_tokens", "task", "local", "ids"][: len(columns)])

    return arrow(docs.select(id_column, F.col(text_column).cast("string").alias("text")), run, schema)


def pack(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT, end_id: int = END, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the piece's ids.  Sequences are to be padded to ``limit``,
    or not at all where their length is a power of two.
    """
    cut = durable(pieces(docs, vocabulary_path, limit, end_id, id_column, text_column, with_ids), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    length, rank, sequence, offset = slots(patterns(histogram, limit))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("local"))
    kept = [id_column, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    width = int(rank.max()).bit_length() + 1 if len(rank) else 1
    key = length << width | rank

    def place(batches):
        for batch in batches:
            own_rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            own_length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            # ranks may exceed the last range's first rank, so the length is searched apart
            lo, hi = np.searchsorted(length, own_length, "left"), np.searchsorted(length, own_length, "right")
            at = np.clip(np.searchsorted(key, own_length << width | np.minimum(own_rank, (1 << width) - 1), "right") - 1, lo, hi - 1)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence[at] + own_rank - rank[at]), pa.array(offset[at])], [*kept, "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in kept)
    return arrow(ranked.select(*kept, "rank"), place, f"{fields}, sequence_id bigint, offset bigint")
