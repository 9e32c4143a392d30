"""Operator 5: repeated passages by fixed-block anchors.

A window of ``2 * b - 1`` words holds exactly one whole block of its document's
non-overlapping blocks of b words.  Blocks are the index; every rolling window
of b words probes it.  A block that a second position matches is an anchor, and
an anchor is extended by up to b - 1 words on either side: those windows, and no
others, can repeat.  Their hashes are matched in turn, and runs of matching
windows are the maximal exact repeats, whose words are removed.

Documents travel as compressed chunks.  A chunk sends each bucket of hashes the
sorted distinct ones it has, so a passage on a third of all pages is one entry
per chunk, and gets back bits.  Anchors are found with 32-bit hashes within a
bucket of bounded size (a false one costs a window, not a result); windows match
on 64 bits and a bucket number from another hash, of words that are hashed to 64
bits by mixing, not by a polynomial.

Defined results: null and empty texts have no words; texts are taken whole; a
repeated row is another document, so its passages repeat; a text shorter than
the window keeps all words; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BASE2, U, covered, gather, mix, rolling, span_hash, window_mask, words
from ._chunks import bucket_count, buckets, by_bucket, chunked, opened, to_buckets
from ._common import arrow, durable

WINDOW = 35


def _open(ends, body):
    data, off = opened(ends, body)
    start, end, word_off = words(data, off)
    return data, off, start, end, word_off, span_hash(data, start, end)


def _anchors(word_off: np.ndarray, block: int) -> np.ndarray:
    """Starts of the whole non-overlapping blocks of each document."""
    count = np.diff(word_off) // block
    first = np.repeat(word_off[:-1], count)
    return first + block * (np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count))


def _probe(block: int, n_buckets: int):
    """Per chunk and bucket: hashes of its blocks with their numbers, and of all rolling windows."""

    def run(batches):
        for batch in batches:
            for chunk, ends, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                *_, word_off, value = _open(ends, body)
                window = rolling(value, block)
                at = _anchors(word_off, block)
                own, every = window[at], window[window_mask(word_off, block)[: len(window)]]
                own_bucket, bucket = buckets(own, n_buckets), buckets(every, n_buckets)
                short = every.astype(np.uint32)
                full = np.sort(bucket.astype(U) << U(32) | short.astype(U))
                first = np.ones(len(full), bool)
                first[1:] = full[1:] != full[:-1]
                again = np.append(full[1:] == full[:-1], False)[first] if len(full) else first
                full = full[first]
                cut = np.searchsorted((full >> U(32)).astype(np.int64), np.arange(n_buckets + 1))
                order = np.argsort(own_bucket, kind="stable")
                own_cut = np.searchsorted(own_bucket[order], np.arange(n_buckets + 1))
                some = np.flatnonzero((np.diff(cut) > 0) | (np.diff(own_cut) > 0))
                rows = [[], [], [], []]
                for k in some:
                    blocks_here = order[own_cut[k] : own_cut[k + 1]]
                    rows[0].append(own[blocks_here].astype("<u4").tobytes())
                    rows[1].append(blocks_here.astype("<u4").tobytes())
                    rows[2].append(full[cut[k] : cut[k + 1]].astype("<u4").tobytes())
                    rows[3].append(np.packbits(again[cut[k] : cut[k + 1]]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([chunk] * len(some), pa.int64()), *[pa.array(r, pa.binary()) for r in rows]], ["bucket", "chunk", "own", "number", "probes", "again"])

    return run


def _repeated(values: list[np.ndarray], again: list[np.ndarray]) -> np.ndarray:
    """Sorted values that stand in two arrays or are marked in one."""
    every = np.sort(np.concatenate(values))
    return np.union1d(every[1:][every[1:] == every[:-1]], np.concatenate([v[a] for v, a in zip(values, again)]))


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[at] == values


def _find_anchors(batches):
    """Numbers of a chunk's blocks that a second position matches."""
    for _, rows in by_bucket(batches):
        probes = [np.frombuffer(r[3], "<u4") for r in rows]
        again = [np.unpackbits(np.frombuffer(r[4], np.uint8), count=len(p)).astype(bool) for r, p in zip(rows, probes)]
        listed = _repeated(probes, again)
        hits = [np.frombuffer(r[2], "<u4")[_among(np.frombuffer(r[1], "<u4"), listed)].tobytes() for r in rows]
        some = [i for i, h in enumerate(hits) if h]
        yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in some], pa.int64()), pa.array([hits[i] for i in some], pa.binary())], ["chunk", "numbers"])


def _extended(word_off, value, numbers, block: int, n_buckets: int):
    """Starts of the windows that hold an anchor, and their sorted distinct hashes.

    Returns starts, for each start the place of its hash, hashes, buckets and
    marks of those that several starts share.  Ordered by bucket, then hash.
    """
    size = 2 * block - 1
    at = _anchors(word_off, block)
    hit = np.zeros(len(at), bool)
    for n in numbers or ():
        hit[np.frombuffer(n, "<u4")] = True
    owner = np.searchsorted(word_off, at[hit], "right") - 1
    starts = (at[hit][:, None] - np.arange(block)[::-1][None, :]).reshape(-1)
    starts = starts[starts >= np.repeat(word_off[owner], block)]
    starts = starts[window_mask(word_off, size)[starts]]
    hashed, other = rolling(value, size)[starts], rolling(mix(value + BASE2), size)[starts]
    bucket = buckets(other, n_buckets)
    order = np.lexsort((hashed, bucket))
    h, b = hashed[order], bucket[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
    place = np.zeros(len(h), np.int64)
    place[order] = np.cumsum(fresh) - 1
    count = np.bincount(place, minlength=int(fresh.sum()))
    return starts, place, h[fresh], b[fresh], count > 1


def _windows(block: int, n_buckets: int):
    def run(batches):
        for batch in batches:
            for chunk, ends, body, numbers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                *_, word_off, value = _open(ends, body)
                _, _, hashed, bucket, again = _extended(word_off, value, numbers, block, n_buckets)
                cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
                some = np.flatnonzero(np.diff(cut))
                values = [hashed[cut[k] : cut[k + 1]].astype("<u8").tobytes() for k in some]
                marks = [np.packbits(again[cut[k] : cut[k + 1]]).tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([chunk] * len(some), pa.int64()), pa.array(values, pa.binary()), pa.array(marks, pa.binary())], ["bucket", "chunk", "values", "again"])

    return run


def _match(batches):
    for bucket, rows in by_bucket(batches):
        values = [np.frombuffer(r[1], "<u8") for r in rows]
        again = [np.unpackbits(np.frombuffer(r[2], np.uint8), count=len(v)).astype(bool) for r, v in zip(rows, values)]
        listed = _repeated(values, again)
        found = [np.packbits(_among(v, listed)).tobytes() for v in values]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array(found, pa.binary())], ["chunk", "bucket", "bits"])


def _cut(block: int, n_buckets: int, id_column: str, with_text: bool):
    size = 2 * block - 1

    def run(batches):
        for batch in batches:
            at = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "ids"}
            lists = batch.column(batch.schema.get_field_index("ids"))
            for row in range(batch.num_rows):
                data, off, start, end, word_off, value = _open(at["ends"][row], at["body"][row])
                starts, place, hashed, bucket, _ = _extended(word_off, value, at["numbers"][row], block, n_buckets)
                repeated = np.zeros(len(hashed), bool)
                cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
                for found in at["found"][row] or ():
                    a, b = cut[found["bucket"]], cut[found["bucket"] + 1]
                    repeated[a:b] = np.unpackbits(np.frombuffer(found["bits"], np.uint8), count=b - a).astype(bool)
                hit = np.zeros(len(start), bool)
                hit[starts[repeated[place]]] = True
                kept = ~covered(hit, size)
                length = (end - start)[kept] + 1
                out = gather(np.append(data, np.uint8(32)), start[kept], length)
                edge = np.cumsum(length)
                out[edge - 1] = 32
                out = out.tobytes()
                before = np.zeros(len(start) + 1, np.int64)
                np.cumsum(kept, out=before[1:])
                edge = np.concatenate([[0], edge])
                n_words, n_kept = np.diff(word_off), before[word_off[1:]] - before[word_off[:-1]]
                texts = [out[edge[before[a]] : max(edge[before[a]], edge[before[b]] - 1)] for a, b in zip(word_off[:-1], word_off[1:])]
                columns = [lists[row].values, pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [id_column, "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every document; ``window`` is odd.

    ``with_text`` adds the words that are left, joined by a blank.
    """
    if window % 2 == 0 or window < 3:
        raise ValueError("window must be odd, so that it holds one whole block")
    block = (window + 1) // 2
    id_type = docs.schema[id_column].dataType.simpleString()
    chunks = chunked(docs, id_column, text_column)
    n_buckets = bucket_count(chunks)
    body = chunks.select("chunk", "ends", "body")

    probes = arrow(body, _probe(block, n_buckets), "bucket bigint, chunk bigint, own binary, number binary, probes binary, again binary")
    hits = arrow(to_buckets(probes, n_buckets), _find_anchors, "chunk bigint, numbers binary")
    anchors = durable(hits.groupBy("chunk").agg(F.collect_list("numbers").alias("numbers")), "anchors")  # at most a chunk's blocks

    hit = body.join(anchors, "chunk").select("chunk", "ends", "body", "numbers")
    sent = arrow(hit, _windows(block, n_buckets), "bucket bigint, chunk bigint, values binary, again binary")
    matched = arrow(to_buckets(sent, n_buckets), _match, "chunk bigint, bucket bigint, bits binary")
    found = durable(matched.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("found")), "found")  # at most a chunk's windows, in bits

    full = chunks.join(anchors, "chunk", "left").join(found, "chunk", "left").select("ids", "ends", "body", "numbers", "found")
    schema = f"`{id_column}` {id_type}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return arrow(full, _cut(block, n_buckets, id_column, with_text), schema)
