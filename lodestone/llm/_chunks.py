"""Texts in compressed chunks, and hashes of theirs dealt out to buckets.

A chunk is a row of some 1 MiB of text.  It can be opened again in a later
stage, with its words in the same order, so that a bucket of hashes may answer
a chunk with an array and no document or hash needs a row of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U, blocks, utf8, words
from ._common import arrow, durable

#: Bytes of a chunk at about most (a longer text stands alone), and documents.
CHUNK, CHUNK_DOCS = 1 << 20, 1 << 12
#: Hashes that one bucket holds at about most, and buckets at least.
BUCKET, LEAST_BUCKETS = 1 << 22, 24


def chunked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A durable table: chunk, ids, ends (byte offsets), body (compressed), n_words; null counts as empty."""
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, off = utf8(batch.column(1))
            ids = batch.column(0)
            for first, last in blocks(off, CHUNK):
                for a in range(first, last, CHUNK_DOCS):
                    b = min(a + CHUNK_DOCS, last)
                    part, own = data[off[a] : off[b]], off[a : b + 1] - off[a]
                    body = pa.compress(part.tobytes(), "zstd", asbytes=True) if len(part) else b""
                    n = int(words(part, own)[2][-1])
                    lists = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array([task << 32 | seq], pa.int64()), lists, pa.array([own[1:]], pa.list_(pa.int64())), pa.array([body], pa.binary()), pa.array([n], pa.int64())], ["chunk", "ids", "ends", "body", "n_words"])
                    seq += 1

    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return durable(arrow(given, run, f"chunk bigint, ids array<{id_type}>, ends array<bigint>, body binary, n_words bigint"), "chunks")


def opened(ends, body) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a chunk's documents, end to end, and their offsets."""
    off = np.concatenate([[0], np.asarray(ends, np.int64)])
    if not off[-1]:
        return np.zeros(0, np.uint8), off
    return np.frombuffer(pa.decompress(body, decompressed_size=int(off[-1]), codec="zstd", asbytes=True), np.uint8), off


def bucket_count(chunks: DataFrame) -> int:
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    least = max(LEAST_BUCKETS, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-total // BUCKET))


def buckets(value: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high bits, whatever n is."""
    return (((value >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def to_buckets(sent: DataFrame, n: int) -> DataFrame:
    """Rows by bucket; a task gets its buckets one after the other, sorted by the JVM, which may spill."""
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket")


def by_bucket(batches):
    """(bucket, rows) of each bucket that a partition of :func:`to_buckets` has; one bucket is held at a time."""
    now, held = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*columns):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held
