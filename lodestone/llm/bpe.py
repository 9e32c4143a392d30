"""Operator 7: byte-level BPE over padded numpy matrices.

Texts are split into pieces by the tokenizer's pattern, distinct pieces are
encoded once, bucketed by length into padded matrices of ids.  In each round
every row merges its leftmost pair of the least rank (found in a hash table)
and is compacted; rows without a pair leave.  A piece above ``LONG`` bytes is a
matrix of one row, and a round merges all places of its least rank that the
rule would merge one after the other.  Encoded pieces are remembered by a hash
and told apart by their bytes.

Defined results: a null or empty text has no ids and decodes to no bytes;
texts are encoded whole, however long; repeated rows each give a row; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import HashTable, U, blocks, gather, lanes, mix, same_spans, span_hash, utf8
from ._common import arrow, worker_cache

#: Bytes of a piece from which on it has a matrix of its own.
LONG = 256
#: Distinct pieces that a worker remembers before it starts anew, and bytes of theirs.
REMEMBERED, REMEMBERED_BYTES = 1 << 18, 1 << 23
#: Bytes of text that are worked on at once; memory is some 60 times that.
BLOCK = 1 << 19
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of every code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            a, b = m.span()
            for lo, hi, shift in ((a, min(b, 0xD800), 0), (max(a, 0xD800), b, 0x800)):
                out[lo + shift : max(lo, hi) + shift] = kind
    return out


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pattern's matches, and n + 1 offsets of the documents' matches.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+``:
    runs of one class, each with one blank before it; a run of white space keeps
    all but its last character, or all at the end of the text.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    table = worker_cache("classes", _classes)
    kind = table[:128][np.minimum(data, 127)]
    lead = (data & 0xC0) != 0x80
    if data.max() >= 128:
        at = np.flatnonzero(data >= 0xC0)
        b = data[at].astype(np.int32)
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        c1, c2, c3 = (pad[at + i].astype(np.int32) & 63 for i in (1, 2, 3))
        size = 2 + (b >= 0xE0) + (b >= 0xF0)
        point = np.where(size == 2, (b & 31) << 6 | c1, np.where(size == 3, (b & 15) << 12 | c1 << 6 | c2, (b & 7) << 18 | c1 << 12 | c2 << 6 | c3))
        own = table[np.minimum(point, 0x10FFFF)]
        kind[at] = own
        for i in (1, 2, 3):
            more = size > i
            kind[at[more] + i] = own[more]
    top = np.zeros(n + 1, bool)
    top[off[:-1]] = True  # a document begins (n too, for empty ones at the end)
    top = top[:n]
    begin = top.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last white character before other text: a token of its own, or a blank that joins what follows
    follows = np.zeros(n, bool)  # a run of another class begins here, after white space of the same document
    follows[1:] = begin[1:] & ~top[1:] & space[:-1] & ~space[1:]
    at = np.flatnonzero(follows)
    if len(at):
        last = at - 1
        while (cont := ~lead[last]).any():
            last[cont] -= 1
        begin[last] = True
        begin[at[data[last] == 32]] = False
    # contractions
    quote = np.flatnonzero((data == 39) & begin)
    if len(quote):
        pad = np.concatenate([data, np.zeros(3, np.uint8)])
        ends = off[np.searchsorted(off, quote, "right")]
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        size = np.where(one, 1, np.where(two, 2, 0))
        good = (size > 0) & (quote + 1 + size <= ends)
        quote, size, ends = quote[good], size[good], ends[good]
        begin[quote + 1] = False
        rest = quote + 1 + size
        inside = rest < ends
        begin[rest[inside]] = True
    start = np.flatnonzero(begin)
    return start, np.searchsorted(start, off)


def covered_spans(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """True for each of n positions within a span; spans do not overlap."""
    edge = np.zeros(n + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    return np.cumsum(edge[:-1]) > 0


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by id."""
    with open(path, "rb") as f:
        ranks = [x.split() for x in f if x.strip()]
    out: list[bytes] = [b""] * (max(int(r) for _, r in ranks) + 1)
    for token, rank in ranks:
        out[int(rank)] = base64.b64decode(token)
    return out


def rank_pairs(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens that joins to a token, and that token's id, which is its rank."""
    ids = {t: i for i, t in enumerate(vocabulary)}
    keys, values = [], []
    for token, i in ids.items():
        for cut in range(1, len(token)):
            a, b = ids.get(token[:cut]), ids.get(token[cut:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                values.append(i)
    return np.array(keys, U), np.array(values, np.int32)


class Bpe:
    """Encoder of pieces; ``merged`` has the id that each rank's merge gives."""

    def __init__(self, vocabulary, keys, ranks, merged, whole, added=None):
        self.vocabulary = vocabulary
        self.added = added or {}
        byte = {t[0]: i for i, t in enumerate(vocabulary) if len(t) == 1}
        self.byte_id = np.array([byte[b] for b in range(256)], np.int32)
        self.pairs = HashTable(len(keys))
        self.pairs.add(mix(keys), ranks)
        self.merged = merged
        self.whole = {t: i for i, t in enumerate(vocabulary)} if whole else {}
        self.flat = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.size = np.array([len(t) for t in vocabulary], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self._clear()

    @classmethod
    def of_ranks(cls, path: str) -> Bpe:
        """As the tiktoken library: ranks of joined bytes, whole tokens first."""
        vocabulary = read_ranks(path)
        keys, ranks = rank_pairs(vocabulary)
        return cls(vocabulary, keys, ranks, np.arange(len(vocabulary), dtype=np.int32), True)

    @classmethod
    def of_merges(cls, path: str) -> Bpe:
        """As the tokenizers library: only the listed merges, in their order, in the texts between added tokens."""
        import json

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model = given["model"]
        added = {}
        for token in given.get("added_tokens") or ():
            if token.get("lstrip") or token.get("rstrip") or token.get("single_word"):
                raise ValueError(f"added token {token['content']!r}: lstrip, rstrip and single_word are not supported")
            added[token["content"].encode()] = token["id"]
        # printable stand-ins of bytes: those that print stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        back = {c: b for b, c in char.items()}
        vocab = model["vocab"]
        vocabulary = [b""] * (max(*vocab.values(), *added.values(), 0) + 1)
        for token, i in vocab.items():
            vocabulary[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in added.items():
            vocabulary[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], U)
        keys, first = np.unique(keys, return_index=True)
        merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        return cls(vocabulary, keys, first.astype(np.int32), merged, False, added)

    def _clear(self):
        self.known, self.salt = HashTable(), int.from_bytes(os.urandom(7), "little")
        self.ids, self.at, self.len = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.raw, self.raw_at, self.raw_len = np.zeros(1 << 20, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.n_ids = self.n_known = self.n_raw = 0

    def _rank(self, a, b):
        return self.pairs.find(mix(a.astype(U) << U(32) | b.astype(U)))

    def _rounds(self, ids: np.ndarray, size: np.ndarray):
        """Merge rows of a padded matrix (-1 beyond size); yields finished rows and their numbers."""
        none = np.int32(2**31 - 1)
        row = np.arange(len(ids))
        n, width = ids.shape
        rank = np.full((n, max(1, width - 1)), none)
        r, c = np.nonzero(np.arange(1, width)[None, :] < size[:, None])
        if len(r):
            found = self._rank(ids[r, c], ids[r, c + 1])
            rank[r, c] = np.where(found < 0, none, found)
        while len(row):
            at = rank.argmin(axis=1)
            every = np.arange(len(row))
            least = rank[every, at]
            done = least == none
            if done.any():
                yield row[done], ids[done], size[done]
                go = ~done
                ids, rank, size, row, at, least = ids[go], rank[go], size[go], row[go], at[go], least[go]
                every = np.arange(len(row))
                if not len(row):
                    return
                width = int(size.max())
                ids, rank = ids[:, :width], rank[:, : max(1, width - 1)]
            ids[every, at] = self.merged[least]
            # compaction: all behind the pair moves one to the left
            later = np.arange(width - 1)[None, :] > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            if rank.shape[1] > 1:
                move = np.arange(rank.shape[1] - 1)[None, :] >= at[:, None]
                rank[:, :-1] = np.where(move, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = none
            size = size - 1
            for side in (-1, 0):  # the pairs that the new token is in
                p = at + side
                ok = np.flatnonzero((p >= 0) & (p + 1 < size))
                if len(ok):
                    found = self._rank(ids[ok, p[ok]], ids[ok, p[ok] + 1])
                    rank[ok, p[ok]] = np.where(found < 0, none, found)

    def _long(self, piece: np.ndarray) -> np.ndarray:
        """The same rule for one long piece, a run of merges a round.

        Places of the least rank are taken from the left, up to the first whose
        merge makes a pair of that rank or less: that pair would come next.
        """
        none = np.int32(2**31 - 1)

        def ranks(a, b):
            found = self._rank(a, b)
            return np.where((found < 0) | (a < 0) | (b < 0), none, found)

        ids = self.byte_id[piece]
        rank = np.append(ranks(ids[:-1], ids[1:]), none)
        while (least := rank.min()) != none:
            at = np.flatnonzero(rank == least)
            run = np.concatenate([[True], np.diff(at) > 1])
            first = at[run][np.cumsum(run) - 1]
            at = at[(at - first) % 2 == 0]  # places in a run of equal ids overlap
            new = self.merged[least]
            behind = np.concatenate([[False], np.diff(at) == 2])
            left = np.where(behind, new, np.where(at > 0, ids[at - 1], -1))
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            made = np.full(len(at), new)
            early = np.flatnonzero(np.minimum(ranks(left, made), ranks(made, right)) <= least)
            if len(early):
                at = at[: early[0] + 1]
            ids[at] = new
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank = ids[keep], rank[keep]
            at = at - np.arange(len(at))
            for p in (at, at[at > 0] - 1):
                p = p[p + 1 < len(ids)]
                rank[p] = ranks(ids[p], ids[p + 1])
            rank[-1] = none
        return ids

    def encode_pieces(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte spans, end to end, and their number for each span."""
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # span numbers, lengths, ids end to end
        todo = np.arange(len(start))
        if self.whole:
            raw = data.tobytes()
            whole = np.array([self.whole.get(raw[a : a + s], -1) for a, s in zip(start.tolist(), size.tolist())], np.int32)
            hit = np.flatnonzero(whole >= 0)
            got.append((hit, np.ones(len(hit), np.int64), whole[hit]))
            todo = np.flatnonzero(whole < 0)
        length = size[todo]
        for lo, hi in ((1, 4), (5, 6), (7, 8), (9, 11), (12, 16), (17, 24), (25, 40), (41, 80), (81, LONG)):
            own = todo[(length >= lo) & (length <= hi)]
            for part in np.split(own, range(1 << 15, len(own), 1 << 15)):
                if not len(part):
                    continue
                width = np.arange(hi)[None, :]
                inside = width < size[part][:, None]
                ids = np.where(inside, self.byte_id[data[np.minimum(start[part][:, None] + width, len(data) - 1)]], -1)
                for row, done, n in self._rounds(ids, size[part].copy()):
                    got.append((part[row], n, done[np.arange(done.shape[1])[None, :] < n[:, None]]))
        for i in todo[length > LONG]:
            ids = self._long(data[start[i] : start[i] + size[i]])
            got.append((np.array([i]), np.array([len(ids)]), ids))
        count = np.zeros(len(start), np.int64)
        for who, n, _ in got:
            count[who] = n
        at = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for who, n, ids in got:
            out[np.repeat(at[who] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, count

    def _marks(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the added tokens in documents, leftmost and then longest first."""
        raw = data.tobytes()
        if not any(token in raw for token in self.added):
            return []
        any_token = b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        starts = [m.start() for m in re.finditer(b"(?=" + any_token + b")", raw)]
        out = []
        for doc in np.unique(np.searchsorted(off, starts, "right") - 1):
            a, b = int(off[doc]), int(off[doc + 1])
            out += [(a + m.start(), a + m.end(), self.added[m[0]]) for m in re.finditer(any_token, raw[a:b])]
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents, end to end, and their n + 1 offsets."""
        if not (marks := self._marks(data, off)):
            return self._encode(data, off)
        start, end, token = np.array(marks, np.int64).T
        gone = np.concatenate([[0], np.cumsum(end - start)])
        inside = covered_spans(start, end, len(data))
        place = start - gone[:-1]
        before = np.searchsorted(start, off)  # added tokens ahead of each document
        bare = off - gone[before]
        edges = np.unique(np.concatenate([bare, place]))
        ids, cut = self._encode(data[~inside], edges)
        at = lambda x: cut[np.searchsorted(edges, x)]
        return np.insert(ids, at(place), token), at(bare) + before

    def _remember(self, data: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Encode pieces of distinct keys that are not known."""
        if self.n_raw + size.sum() + 8 > len(self.raw):
            bigger = np.zeros(2 * (self.n_raw + int(size.sum()) + 8), np.uint8)
            bigger[: self.n_raw] = self.raw[: self.n_raw]
            self.raw = bigger
        ids, count = self.encode_pieces(data, start, size)
        new = {"ids": ids, "at": self.n_ids + np.cumsum(count) - count, "len": count, "raw_at": self.n_raw + np.cumsum(size) - size, "raw_len": size}
        for name, values in new.items():
            kept, used = getattr(self, name), self.n_ids if name == "ids" else self.n_known
            if used + len(values) > len(kept):
                bigger = np.zeros(2 * (used + len(values)), kept.dtype)
                bigger[:used] = kept[:used]
                setattr(self, name, kept := bigger)
            kept[used : used + len(values)] = values
        self.raw[self.n_raw : self.n_raw + int(size.sum())] = gather(data, start, size)
        self.known.add(key, np.arange(self.n_known, self.n_known + len(key), dtype=np.int32))
        self.n_ids, self.n_known, self.n_raw = self.n_ids + len(ids), self.n_known + len(key), self.n_raw + int(size.sum())

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, cut = pieces(data, off)
        end = np.append(start[1:], len(data))
        size = end - start
        if self.n_known > REMEMBERED or self.n_raw > REMEMBERED_BYTES:
            self._clear()
        key = span_hash(data, start, end, self.salt)
        slot = self.known.find(key)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            fresh, one = np.unique(key[miss], return_index=True)
            one = miss[one]
            self._remember(data, fresh, start[one], size[one])
            slot[miss] = self.known.find(key[miss])
        known = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))
        other = (self.raw_len[slot] != size) | ~same_spans(lanes(data), start, known, self.raw_at[slot], np.minimum(size, self.raw_len[slot]))
        flat, at, count = self.ids, self.at[slot], self.len[slot].astype(np.int64)
        if other.any():  # pieces whose key another piece has
            ids, count[other] = self.encode_pieces(data, start[other], size[other])
            at[other] = self.n_ids + np.cumsum(count[other]) - count[other]
            flat = np.concatenate([flat[: self.n_ids], ids])
        total = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return gather(flat, at, count), total[cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.start[ids], self.size[ids]).tobytes()


def of_ranks(path: str) -> Bpe:
    return worker_cache(("ranks", path), lambda: Bpe.of_ranks(path))


def of_merges(path: str) -> Bpe:
    return worker_cache(("merges", path), lambda: Bpe.of_merges(path))


def encoded(batch_text, bpe: Bpe):
    """For each block of a text column: first row, id array, offsets of the rows' ids."""
    data, off = utf8(batch_text)
    for a, b in blocks(off, BLOCK):
        yield a, *bpe.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])


def round_trip(docs: DataFrame, rank_path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each text and decode its ids: id, n_tokens, ids_sha256, decoded_sha256.

    ``with_ids`` adds the ids themselves (array of int) and the decoded text.
    One pass, no shuffle.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        bpe = of_ranks(rank_path)
        for batch in batches:
            n, ids_hash, text_hash, all_ids, decoded = [], [], [], [], []
            for _, ids, off in encoded(batch.column(1), bpe):
                for i in range(len(off) - 1):
                    own = ids[off[i] : off[i + 1]]
                    text = bpe.decode(own)
                    n.append(len(own))
                    ids_hash.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    text_hash.append(hashlib.sha256(text).hexdigest())
                    if with_ids:
                        all_ids.append(own)
                        decoded.append(text.decode())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow(docs.select(id_column, F.col(text_column).cast("string").alias("text")), run, schema)
