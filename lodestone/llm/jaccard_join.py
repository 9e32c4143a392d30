"""Operator 9: set-similarity join of word shingles by token-combination prefixes.

Texts with equal shingle sets form one class.  Shingles are ordered by document
frequency, rarest first; buckets of hashes count it and answer each chunk of
texts with a byte per shingle.  If two sets overlap in at least k tokens more than their suffixes hold, their
first k common tokens lie in both prefixes; so a class is indexed by every rare
token of its plain prefix and, where that runs into frequent tokens, by every
pair of frequent tokens of the prefix extended by one.  Prefixes of more than
``COMBINED`` tokens have entries for single frequent tokens instead, so that a
text has no more entries than half of COMBINED squared, or than its prefix.  Classes that share an
index entry are compared within blocks: the parity of hashed tokens bounds the
symmetric difference from below, which rules out all but near misses.  Of the
pairs that pass, only a spanning forest is verified with the whole sets; where a
tree edge fails, the pairs across the parts that remain are verified too.  So no
link between different texts is lost, and pairs within a group are not emitted.

Defined results: texts without words and null texts have an empty set and link
with nothing; texts are taken whole; repeated rows share a class; a null id
counts for no component's name, and of a group without ids the class with the
least key stays; other columns are not read or, in :func:`representatives`, kept.
Shingles are compared as 64-bit hashes made by mixing, not by a polynomial.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import U, blocks, gather, mix, rolling, span_hash, utf8, words
from ._chunks import CHUNK, CHUNK_DOCS, bucket_count, buckets, by_bucket, chunked, opened, to_buckets
from ._common import arrow, durable, looked_up
from .components import components

#: Bits of a token by which it is sorted first: the rest of 64 numbers the documents of a chunk.
SORT_BITS = 52
#: Powers of two of the document frequency from which on tokens are frequent.
FREQUENT = 12
#: Tokens of a prefix up to which frequent ones are combined; beyond, single ones are indexed.
COMBINED = 32
#: Bits of a set's parities: at least these, and at least its size.
PARITY = 1024
#: Members of an index entry that one group compares; larger entries are split.
BLOCK = 512
#: Rows of index entries that a task works on at once.
HELD = 1 << 14
#: Bits of the filter that keeps sets of uninvolved texts from being shuffled (2 MiB, whatever the input).
FILTER = 1 << 24


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower()


def _fresh(value: np.ndarray) -> np.ndarray:
    """True where a sorted array has a new value."""
    out = np.ones(len(value), bool)
    out[1:] = value[1:] != value[:-1]
    return out


def sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the sets of at most 2**12 documents, ascending in each, and their offsets."""
    docs = len(off) - 1
    data = LOWER[data]
    start, end, word_off = words(data, off)
    value = span_hash(data, start, end)
    window = rolling(value, size)
    count = np.diff(word_off)
    inside = np.maximum(count - size + 1, 0)
    doc = np.repeat(np.arange(docs), inside)
    at = np.repeat(word_off[:-1] - (np.cumsum(inside) - inside), inside) + np.arange(len(doc))
    token = window[at] if len(at) else np.zeros(0, U)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):  # the whole sequence as one shingle
        whole = [mix(rolling(value[word_off[i] : word_off[i + 1]], int(count[i])) + U(count[i])) for i in short]
        doc, token = np.concatenate([doc, short]), np.concatenate([token, *whole])
    key = doc.astype(U) << U(SORT_BITS) | token >> U(64 - SORT_BITS)
    order = np.argsort(key)
    key, token = key[order], token[order]
    if np.any((key[1:] == key[:-1]) & (token[1:] < token[:-1])):  # tokens of a document that differ in their last bits only
        order = np.lexsort((token, key))
        key, token = key[order], token[order]
    fresh = _fresh(key) | _fresh(token)
    return token[fresh], np.searchsorted((key[fresh] >> U(SORT_BITS)).astype(np.int64), np.arange(docs + 1))


def column_sets(column, size: int):
    """The sets of a text column, chunk after chunk."""
    data, off = utf8(column)
    for first, last in blocks(off, CHUNK):
        for a in range(first, last, CHUNK_DOCS):
            b = min(a + CHUNK_DOCS, last)
            yield sets(data[off[a] : off[b]], off[a : b + 1] - off[a], size)


def _hashed(token: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket and 32-bit hash of tokens, in one number."""
    h = mix(token * U(7) + U(3))
    return buckets(h, n_buckets).astype(U) << U(32) | h & U(0xFFFFFFFF)


def _bounds(value: np.ndarray, n_buckets: int) -> np.ndarray:
    return np.searchsorted(value, np.arange(n_buckets + 1).astype(U) << U(32))


def _sent(size: int, n_buckets: int):
    """Per chunk and bucket: hashes of tokens and how many of the chunk's documents have them."""

    def run(batches):
        for batch in batches:
            for chunk, ends, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                value = np.sort(_hashed(sets(*opened(ends, body), size)[0], n_buckets))
                at = np.flatnonzero(_fresh(value))
                value, count = value[at], np.diff(np.append(at, len(value)))
                cut = _bounds(value, n_buckets)
                some = np.flatnonzero(np.diff(cut))
                values = [value[cut[k] : cut[k + 1]].astype("<u4").tobytes() for k in some]
                counts = [count[cut[k] : cut[k + 1]].astype("<u2").tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([chunk] * len(some), pa.int64()), pa.array(values, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "chunk", "values", "counts"])

    return run


def _summed(batches):
    """For each hash that a chunk sent, the power of two of its document frequency."""
    for bucket, rows in by_bucket(batches):
        values = [np.frombuffer(r[1], "<u4") for r in rows]
        every = np.concatenate(values)
        order = np.argsort(every)
        group = np.cumsum(_fresh(every[order])) - 1
        total = np.bincount(group, weights=np.concatenate([np.frombuffer(r[2], "<u2") for r in rows])[order])
        power = np.empty(len(every), np.uint8)
        power[order] = (np.frexp(total)[1] - 1).astype(np.uint8)[group]
        cut = np.cumsum([0, *map(len, values)])
        found = [power[cut[i] : cut[i + 1]].tobytes() for i in range(len(rows))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), pa.array(found, pa.binary())], ["chunk", "bucket", "powers"])


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def text_mark(text: np.ndarray) -> int:
    """A number of 62 bits for a text's bytes."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big") >> 2


def signatures(token: np.ndarray, power: np.ndarray, off: np.ndarray, percent: int) -> list[np.ndarray]:
    """Index entries of each set; a token that no other document has takes its place in the prefix, but is no entry."""
    n = np.diff(off)
    need = (percent * n + 99) // 100
    prefix = np.where(100 * n >= percent * (n + 1), n - need + 1, 0)  # smaller sets link with equal ones only
    alone = np.zeros(len(token) + 1, np.int64)
    np.cumsum(power == 0, out=alone[1:])
    out = [token[:0]] * len(n)
    some = np.flatnonzero(alone[off[1:]] - alone[off[:-1]] < prefix)  # the others' prefixes are all their own
    if not len(some):
        return out
    start, n, prefix = off[some], n[some], prefix[some]
    token, power = gather(token, start, n), gather(power, start, n)
    off = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    order = np.argsort(doc << 8 | power, kind="stable")  # rarest first; tokens ascend already
    token, power = token[order], power[order]
    first = np.arange(len(token)) - off[:-1][doc] < prefix[doc]
    # frequent tokens alone where the prefix is long, or two sets may link by one common token; a size within reach of
    # another that is not combined has both kinds of entries
    longest = COMBINED * 100 // (100 - percent)
    combined = n <= longest
    alone = (100 * n >= percent * longest) | (percent * n <= 100)
    taken = first & (power > 0) & ((power < FREQUENT) | alone[doc])
    cut = np.searchsorted(np.flatnonzero(taken), off)
    single = mix(token[taken] ^ U(0x5851F42D4C957F2D))
    for i, row in enumerate(some):
        out[row] = single[cut[i] : cut[i + 1]]
    for i in np.unique(doc[first & (power >= FREQUENT) & combined[doc]]):  # the prefix runs into frequent tokens: pairs of them, one token further
        reach = slice(off[i], off[i] + min(prefix[i] + 1, n[i]))
        own = token[reach][power[reach] >= FREQUENT]
        a, b = np.triu_indices(len(own), 1)
        out[some[i]] = np.concatenate([out[some[i]], mix(mix(own[a]) * U(3) + own[b])])
    return out


def parities(token: np.ndarray, off: np.ndarray) -> list[bytes]:
    """Per set, whether an odd number of tokens falls on each place; places are a power of two.

    Halving the places folds the upper half onto the lower one by exclusive or.
    """
    n = np.diff(off)
    size = np.full(len(n), PARITY)
    large = n > PARITY
    size[large] = 1 << np.ceil(np.log2(n[large])).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(n)), n)
    place = (mix(token * U(5) + U(1)) & (size[doc] - 1).astype(U)).astype(np.int64)
    odd = (np.bincount(base[doc] + place, minlength=base[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd)
    return [packed[a >> 3 : b >> 3].tobytes() for a, b in zip(base[:-1], base[1:])]


def _shingled(size: int, percent: int, n_buckets: int):
    """id, n, key, parity, entries, mark of every document; key is null for empty sets."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            for row, (ends, body, found) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 4)))):
                data, ends_of = opened(ends, body)
                token, off = sets(data, ends_of, size)
                value = _hashed(token, n_buckets)
                order = np.argsort(value)
                value = value[order]
                fresh = _fresh(value)
                powers, cut = np.zeros(int(fresh.sum()), np.uint8), _bounds(value[fresh], n_buckets)
                for own in found or ():
                    powers[cut[own["bucket"]] : cut[own["bucket"] + 1]] = np.frombuffer(own["powers"], np.uint8)
                power = np.empty(len(token), np.uint8)
                power[order] = powers[np.cumsum(fresh) - 1]
                entries = signatures(token, power, off, percent)
                marks = [text_mark(data[a:b]) for a, b in zip(ends_of[:-1].tolist(), ends_of[1:].tolist())]
                keys = [set_key(token[a:b]) if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                flat = np.concatenate([np.zeros(0, U), *entries]).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int32)
                columns = [lists[row].values, pa.array(np.diff(off), pa.int64()), pa.array(keys, pa.binary()), pa.array(parities(token, off), pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)), pa.array(marks, pa.int64())], ["id", "n", "key", "parity", "entries", "mark"])

    return run


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """Places in which two parities differ, the longer one folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _close(n, parity, large, i, j, percent: int) -> np.ndarray:
    """Pairs that sizes and parities do not rule out: the sets' symmetric difference is no less than either tells."""
    total = n[i] + n[j]
    out = (100 - percent) * total >= (100 + percent) * np.abs(n[i] - n[j])
    at = np.flatnonzero(out)
    apart = np.bitwise_count(parity[i[at]] ^ parity[j[at]]).sum(axis=1, dtype=np.int64)
    out[at] = (100 - percent) * total[at] >= (100 + percent) * apart
    for k in np.flatnonzero(out):
        x, y = int(i[k]), int(j[k])
        if x in large and y in large:
            out[k] = (100 - percent) * int(total[k]) >= (100 + percent) * _apart(large[x], large[y])
    return out


def _candidates(percent: int, across: bool):
    """Compare the members of index entries, group after group of the sorted partition.

    Without ``across``: a spanning forest of the close pairs.  With it: all close
    pairs whose ends have different roots.
    """

    def pairs(table):
        group = np.cumsum(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in (table["entry"], table["i"], table["j"])], axis=0)])) - 1
        size = np.bincount(group)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(group))  # members from here to the group's end
        n = table["n"]
        words_of = PARITY // 64
        whole = [np.frombuffer(p, U) for p in table["parity"]]
        large = {k: p for k, p in enumerate(whole) if len(p) > words_of}
        parity = np.stack([p if len(p) == words_of else np.bitwise_xor.reduce(p.reshape(-1, words_of)) for p in whole])
        for step in range(1, int(size.max())):
            for part in np.array_split(np.flatnonzero(left > step), max(1, int((left > step).sum()) >> 16)):
                i, j = part, part + step
                ok = (table["i"][i] == table["j"][i]) | (table["block"][i] != table["block"][j])
                if across:
                    ok &= table["root"][i] != table["root"][j]
                i, j = i[ok], j[ok]
                good = _close(n, parity, large, i, j, percent)
                yield i[good], j[good]

    def run(batches):
        names = ["entry", "i", "j", "block", "key", "n", "parity", "root"] if across else ["entry", "i", "j", "block", "key", "n", "parity"]
        kept, rows, parent = [], 0, {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def flush(table):
            cols = {c: table[c].to_numpy() if c not in ("key", "parity", "root") else np.array(table[c].to_pylist(), object) for c in names}
            if not len(cols["n"]):
                return
            label, ident = np.unique(cols["key"], return_inverse=True)
            for i, j in pairs(cols):
                a, b = np.minimum(ident[i], ident[j]), np.maximum(ident[i], ident[j])
                code = np.unique(a << 32 | b)
                x, y = label[code >> 32], label[code & 0xFFFFFFFF]
                if not across:
                    new = []
                    for k, (p, q) in enumerate(zip(x, y)):
                        p, q = find(p), find(q)
                        if p != q:
                            parent[max(p, q)] = min(p, q)
                            new.append(k)
                    x, y = x[new], y[new]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.binary()), pa.array(y.tolist(), pa.binary())], ["a", "b"])

        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= HELD:  # hold back the last, perhaps unfinished group
                table = pa.concat_tables(kept).combine_chunks()
                key = [table[c].to_numpy() for c in ("entry", "i", "j")]
                end = table.num_rows - 1
                cut = int(np.flatnonzero((key[0] != key[0][end]) | (key[1] != key[1][end]) | (key[2] != key[2][end])).max(initial=-1)) + 1
                yield from flush(table.slice(0, cut))
                kept, rows = [table.slice(cut)], table.num_rows - cut
        if kept:
            yield from flush(pa.concat_tables(kept).combine_chunks())

    return run


def _grouped(index: DataFrame, percent: int, across: bool) -> DataFrame:
    spread = index.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j")
    return arrow(spread, _candidates(percent, across), "a binary, b binary").distinct()


def _mark_filter(marks: DataFrame) -> np.ndarray:
    """A bit for each mark; FILTER / 64 numbers reach the driver, however many marks there are."""
    place = F.col("mark").bitwiseAND(F.lit(FILTER - 1))
    bits = marks.select(F.shiftright(place, 6).cast("int").alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = bits.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).collect()
    table = np.zeros(FILTER // 64, np.int64)
    if rows:
        table[[r["word"] for r in rows]] = [r["bits"] for r in rows]
    return table.view(U)


def _verified(edges: DataFrame, classes: DataFrame, body: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, ok: whether the whole sets of each edge reach the similarity.

    Sets are made again for the texts that stand for the edges' classes, which
    the filter finds by their marks, and a few others that it lets through.
    """
    nodes = edges.select(F.col("a").alias("key")).unionByName(edges.select(F.col("b").alias("key"))).distinct()
    shared = body.sparkSession.sparkContext.broadcast(_mark_filter(classes.select("key", "mark").join(nodes, "key", "left_semi")))

    def run(batches):
        listed = shared.value
        for batch in batches:
            found, own = [], []
            for ends, chunk in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, off = opened(ends, chunk)
                marks = np.array([text_mark(data[a:b]) & (FILTER - 1) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.int64)
                some = np.flatnonzero(listed[marks >> 6] >> (marks & 63).astype(U) & U(1))
                length = np.diff(off)[some]
                token, off = sets(gather(data, off[some], length), np.concatenate([[0], np.cumsum(length)]), size)
                for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                    if b > a:
                        found.append(set_key(token[a:b]))
                        own.append(token[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(own, pa.binary())], ["key", "tokens"])

    found = arrow(body, run, "key binary, tokens binary").groupBy("key").agg(F.first("tokens").alias("tokens"))
    found = durable(found.join(nodes, "key", "left_semi"), "sets")
    pairs = edges.join(found.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a").join(found.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")

    def test(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return arrow(pairs.select("a", "b", "x", "y"), test, "a binary, b binary, ok boolean")


def _classes(docs: DataFrame, size: int, percent: int, id_column: str, text_column: str):
    """The documents' sets (id, n, key), and key, component, keep for every class that links."""
    id_type = docs.schema[id_column].dataType.simpleString()
    chunks = chunked(docs, id_column, text_column)
    n_buckets = bucket_count(chunks)
    body = chunks.select("chunk", "ends", "body")
    sent = arrow(body, _sent(size, n_buckets), "bucket bigint, chunk bigint, values binary, counts binary")
    powers = arrow(to_buckets(sent, n_buckets), _summed, "chunk bigint, bucket bigint, powers binary")
    powers = powers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "powers")).alias("found"))  # at most a byte a token of the chunk
    told = chunks.join(powers, "chunk", "left").select("ids", "ends", "body", "found")
    shingled = durable(arrow(told, _shingled(size, percent, n_buckets), f"id {id_type}, n bigint, key binary, parity binary, entries array<bigint>, mark bigint"), "shingled")
    classes = shingled.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("entries").alias("entries"), F.first("mark").alias("mark"), F.count(F.lit(1)).alias("members"))
    classes = durable(classes, "classes")
    index = classes.select("key", F.explode("entries").alias("entry"))
    shared = index.groupBy("entry").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    n_blocks = F.ceil(F.col("members") / BLOCK)
    index = index.join(shared, "entry").withColumn("block", F.pmod(F.xxhash64("key", "entry"), n_blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)))
    index = index.select("entry", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key")
    index = durable(index.join(classes.select("key", "n", "parity"), "key").select("entry", "i", "j", "block", "key", "n", "parity"), "index")

    tree = durable(_grouped(index, percent, False), "tree")
    judged = durable(_verified(tree, classes, body, size, percent), "verified")
    links = judged.where("ok").select("a", "b")
    reach = durable(components(links), "reach")
    if judged.where("not ok").limit(1).count():
        rooted = index.join(reach.select(F.col("node").alias("key"), "root"), "key", "left")
        rooted = rooted.select("entry", "i", "j", "block", "key", "n", "parity", F.coalesce("root", "key").alias("root"))
        mixed = rooted.groupBy("entry").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("entry")
        more = _grouped(rooted.join(mixed, "entry", "left_semi").select(*rooted.columns), percent, True)
        more = durable(more.join(judged.select("a", "b"), ["a", "b"], "left_anti"), "across")
        again = durable(_verified(more, classes, body, size, percent), "verified")
        found = again.where("ok").select("a", "b")
        if found.limit(1).count():
            reach = durable(components(found.unionByName(reach.select(F.col("node").alias("a"), F.col("root").alias("b")))), "reach")
    member = reach.join(classes.select(F.col("key").alias("node"), "least"), "node")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))  # classes without an id come last
    best = member.groupBy("root").agg(first.alias("first"))
    named = member.join(best, "root").select(F.col("node").alias("key"), F.col("first.least").alias("component"), F.col("first.node").alias("keep"))
    return shingled.select("id", "n", "key"), classes.select("key", "least", "members"), durable(named, "named")


def join(docs: DataFrame, size: int = 3, percent: int = 90, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every document: links have 100 * |A & B| >= percent * |A | B|."""
    sets_of, classes, named = _classes(docs, size, percent, id_column, text_column)
    told = classes.join(named, "key", "left").select(F.col("key").alias("k"), "members", F.coalesce("component", "least").alias("component"))
    out = looked_up(sets_of, durable(told, "told"), "members")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group (the least id's class, least id), with all columns; texts without words all stay."""
    _, _, named = _classes(docs, size, percent, id_column, text_column)
    gone = named.where("key <> keep").select(F.col("key").alias("k"))
    id_at, text_at = docs.columns.index(id_column), docs.columns.index(text_column)

    def run(batches):
        from pyspark import TaskContext

        lone, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            keys = []
            for token, off in column_sets(batch.column(text_at).cast(pa.string()), size):
                for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                    if b == a:  # a key of its own
                        lone += 1
                    keys.append(set_key(token[a:b]) if b > a else b"%d.%d" % (task, lone))
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays([row, batch.column(id_at), pa.array(keys, pa.binary())], ["row", "id", "key"])

    keyed = arrow(docs, run, T.StructType([T.StructField("row", docs.schema), T.StructField("id", docs.schema[id_column].dataType), T.StructField("key", T.BinaryType())]))
    one = keyed.groupBy("key").agg(F.coalesce(F.min_by("row", "id"), F.first("row")).alias("row"))
    return one.join(gone, F.col("key") == F.col("k"), "left_anti").select("row.*")
