"""Operator 8: quality rules and n-gram perplexity bands.

Base rules count words, symbols, repeated lines and repeated 8-word windows.
The method is a modified Kneser-Ney model of byte n-grams up to ``ORDER``, one
per language.  Spark counts the n-grams of all documents as they are (a code
holds the bytes, none are folded) and works out discounts, interpolated
probabilities and back-off weights by joins; the model is a durable table that
grows with the corpus.  For scoring, a language's n-grams of one order are a
sorted array of hashes with arrays of log-probabilities beside it.  Up to
``BROADCAST_GRAMS`` n-grams the driver works out the same numbers from the
counts and broadcasts the arrays.  A larger model is dealt out to buckets: a chunk
of texts sends each bucket an array of its distinct n-grams and gets an array of
prices back, first in its texts' own languages, where no n-gram is absent, and then,
for the texts that are off, in every language.

A text's score is its bits a byte less the bits that its language's model has
on average, at order ``ORDER`` and, from the same look-up, at order ``LOW``.
A text that its language prices badly is priced by the language that prices
each ``RUN`` words least (at each order; such a score is 0 at least), so that a
mixture is not taken for junk.  Documents are rejected whose score at either
order leaves their language's band: median plus or minus a multiple of the
median deviation, both over all documents; but not if, under a wrong language
code, they lie within the band of the other language that fits them best.
The multiples hold ``GOOD_SHARE`` of the documents of
the language that ``labels`` call good; of all languages where these are fewer
than ``LEAST_GOOD``, and without enough labels they are ``LOWER`` and ``UPPER``.

Defined results: null and empty texts have no words and fail the base rules; a
null language is a language of its own; texts are taken whole; repeated rows
count each; ties in the median and at a band's edge are inside the band;
further columns pass through :func:`keep`; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import U, blocks, covered, gather, mix, rolling, span_hash, utf8, window_mask, words
from ._chunks import LEAST_BUCKETS, buckets
from ._common import arrow, durable, forget, small

MIN_WORDS, WINDOW, MAX_REPEAT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
#: Bytes of the longest n-grams, and of those of the second score.
ORDER, LOW = 5, 3
#: N-grams of order ORDER, in all languages, up to which the model is worked out at the driver and broadcast (some 100 MB then).
BROADCAST_GRAMS = 1 << 21
#: Distinct n-grams that a task holds at about most before it hands counts on.
HELD = 1 << 21
#: Widths of the bands in median deviations, below and above the median, where labels are too few.
LOWER, UPPER = 6.0, 6.0
#: Share of the documents labelled good that a band holds, half of the others to each side, labels that it takes, and its least width.
GOOD_SHARE, LEAST_GOOD, LEAST_WIDTH = 0.995, 200, 3.0
#: Steps of a score, per bit, and those that a deviation has at least.
BINS, LEAST_DEVIATION = 256, 4
#: Bits a byte off its language's average from which on other languages price a text, and words that are priced together.
FAR, RUN = 0.1, 1
BLOCK = 1 << 19
#: Languages up to which their bands are broadcast (four numbers each).
BROADCAST_BANDS = 10_000
#: Bytes of rows in a chunk at about most where the model is dealt out, and n-grams of order ORDER in a bucket.
CHUNK, BUCKET = 1 << 23, 1 << 17
SCORES = ["high", "low", "other_high", "other_low"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def grams(data: np.ndarray, off: np.ndarray, a: int, b: int) -> np.ndarray:
    """Codes of the ORDER bytes that end at each byte from a to b; zeros stand before a document."""
    behind = np.zeros(7 + b - a, np.uint8)
    known = min(a, 7)
    behind[7 - known :] = data[a - known : b]
    out = np.ndarray((b - a,), ">u8", behind, strides=(1,)).astype(U) & U((1 << 8 * ORDER) - 1)
    first = off[np.searchsorted(off, a - ORDER) : np.searchsorted(off, b)]
    for k in range(ORDER - 1):  # bytes of the document before
        at = first[(first + k >= a) & (first + k < b)] + k - a
        out[at] &= U((1 << 8 * (k + 1)) - 1)
    return out


def _languages(langs):
    """Each language of a column, as its key (empty for null), with the rows that have it."""
    for lang in pc.unique(langs).to_pylist():
        rows = pc.is_null(langs) if lang is None else pc.fill_null(pc.equal(langs, pa.scalar(lang)), False)
        yield "" if lang is None else "=" + lang, np.flatnonzero(rows.to_numpy(zero_copy_only=False))


def _own(lang: Column) -> Column:
    """A language's key."""
    return F.when(lang.isNull(), "").otherwise(F.concat(F.lit("="), lang))


def count_grams(docs: DataFrame) -> DataFrame:
    """own, code, c: the n-grams of order ORDER in all documents (columns lang, text)."""

    def merged(parts):
        codes, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(codes)
        codes = codes[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.add.reduceat(counts[order], first)

    def run(batches):
        held: dict[str, list] = {}

        def rows(own):
            codes, counts = merged(held.pop(own))
            for part in np.split(np.arange(len(codes)), range(1 << 16, len(codes), 1 << 16)):
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(part), pa.string()), pa.array(codes[part].astype(np.int64)), pa.array(counts[part])], ["own", "code", "c"])

        for batch in batches:
            for own, at in _languages(batch.column(0)):
                data, off = utf8(batch.column(1).take(pa.array(at)))
                for a in range(0, len(data), BLOCK):
                    codes, counts = np.unique(grams(data, off, a, min(a + BLOCK, len(data))), return_counts=True)
                    held.setdefault(own, []).append((codes, counts.astype(np.int64)))
                    if sum(len(c) for c, _ in held[own]) > HELD // 2:
                        held[own] = [merged(held[own])]
            if sum(len(c) for parts in held.values() for c, _ in parts) > HELD:
                for own in list(held):
                    yield from rows(own)
        for own in list(held):
            yield from rows(own)

    found = arrow(docs.select("lang", "text"), run, "own string, code bigint, c bigint")
    return found.groupBy("own", "code").agg(F.sum("c").alias("c"))


def _discounted(levels: DataFrame) -> DataFrame:
    """own, order, code, c, ctx, taken: what modified Kneser-Ney takes from each count; a half, one and 1.5 where too few counts tell."""
    n = [F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in range(1, 5)]
    seen = levels.groupBy("own", "order").agg(*n)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    enough = (F.col("n1") > 0) & (F.col("n2") > 0)
    cuts = []
    for k in range(1, 4):
        usable = enough & (F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0)
        value = F.when(usable, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(F.lit(k / 2))
        cuts.append(F.greatest(F.lit(0.0), F.least(F.lit(float(k)), value)).alias(f"d{k}"))
    cut = seen.select("own", "order", *cuts)
    taken = F.when(F.col("c") >= 3, F.col("d3")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d1"))
    return levels.join(cut, ["own", "order"]).select("own", "order", "code", "c", F.shiftright("code", 8).alias("ctx"), taken.alias("taken"))


def trained(top: DataFrame) -> DataFrame:
    """own, order, code, c, logp, low, bow of a table of counts: log2 of the interpolated probability, of that at order LOW, and of the back-off weight as a context.

    Every context has at most 256 n-grams, so no window is large.  A durable table.
    """
    level, levels = top, top.withColumn("order", F.lit(ORDER))
    for n in range(ORDER - 1, 0, -1):  # how many different bytes stand before the shorter n-gram
        level = level.groupBy("own", F.col("code").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("c"))
        levels = levels.unionByName(level.withColumn("order", F.lit(n)))
    levels = durable(levels, "levels")
    context = Window.partitionBy("own", "order", "ctx")
    shares = _discounted(levels).select(
        "own", "order", "code", "c", "ctx", ((F.col("c") - F.col("taken")) / F.sum("c").over(context)).alias("direct"), (F.sum("taken").over(context) / F.sum("c").over(context)).alias("gamma")
    )
    shares = durable(shares, "shares")
    weight = shares.select("own", (F.col("order") - 1).alias("order"), F.col("ctx").alias("code"), "gamma").groupBy("own", "order", "code").agg(F.first("gamma").alias("bow"))
    model, before, steps = None, None, []
    for n in range(1, ORDER + 1):
        here = shares.where(F.col("order") == n).drop("order", "ctx")
        if n == 1:
            now = here.select("own", "code", "c", (F.col("direct") + F.col("gamma") / 256).alias("p"))
        else:
            here = here.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
            shorter = before.select("own", F.col("code").alias("suffix"), F.col("p").alias("q"), *(["low"] if n > LOW else []))
            now = here.join(shorter, ["own", "suffix"]).select("own", "code", "c", (F.col("direct") + F.col("gamma") * F.col("q")).alias("p"), *(["low"] if n > LOW else []))
        if n <= LOW:
            now = now.withColumn("low", F.col("p"))
        before = durable(now, f"order{n}")
        steps.append(before)
        model = before.withColumn("order", F.lit(n)) if n == 1 else model.unionByName(before.withColumn("order", F.lit(n)))
    out = model.join(weight, ["own", "order", "code"], "left")
    log = lambda c: F.log2(F.greatest(c, F.lit(1e-30))).cast("float")
    out = durable(out.select("own", "order", "code", "c", log(F.col("p")).alias("logp"), log(F.col("low")).alias("low"), F.when(F.col("bow").isNull(), 0.0).otherwise(log(F.col("bow"))).cast("float").alias("bow")), "model")
    for table in (levels, shares, *steps):
        forget(table)
    return out


def discounts(c: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney; a half, one and 1.5 where too few counts tell."""
    n = [int((c == k).sum()) for k in range(1, 5)]
    out = np.array([0.5, 1.0, 1.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in range(3):
            if n[k] and n[k + 1]:
                out[k] = k + 1 - (k + 2) * y * n[k + 1] / n[k]
    return np.clip(out, 0.0, [1.0, 2.0, 3.0])


def kneser_ney(code: np.ndarray, c: np.ndarray) -> tuple[dict[int, tuple], tuple[float, float]]:
    """One language's counts as :func:`trained` has them, by order: code, logp, low, bow; and its average bits."""
    order = np.argsort(code)
    levels = {ORDER: (code[order].astype(U), c[order])}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = np.unique(levels[n + 1][0] & U((1 << 8 * n) - 1), return_counts=True)
    out, before = {}, None
    for n in range(1, ORDER + 1):
        own, count = levels[n]
        cuts = discounts(count)
        taken = np.where(count >= 3, cuts[2], np.where(count == 2, cuts[1], cuts[0]))
        ctx = own >> U(8)
        fresh = np.concatenate([[True], ctx[1:] != ctx[:-1]])
        at = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        total, gamma = np.add.reduceat(count, at), np.add.reduceat(taken, at)
        gamma = gamma / total
        if n == 1:
            shorter = low = 1 / 256
        else:
            place = np.searchsorted(before[0], own & U((1 << 8 * (n - 1)) - 1))
            shorter, low = before[1][place], before[2][place]
            known = np.searchsorted(before[0], ctx[at])
            good = (known < len(before[0])) & (before[0][np.minimum(known, len(before[0]) - 1)] == ctx[at])
            out[n - 1][3][known[good]] = np.log2(np.maximum(gamma[good], 1e-30))
        p = (count - taken) / total[group] + gamma[group] * shorter
        before = own, p, p if n <= LOW else low
        out[n] = [own, *(np.log2(np.maximum(x, 1e-30)) for x in before[1:]), np.zeros(len(own))]
    _, logp, low, _ = out[ORDER]
    return out, tuple(-float(levels[ORDER][1] @ x) / float(levels[ORDER][1].sum()) for x in (logp, low))


class Sorted:
    """A sorted array of hashes with arrays beside it; an index by the hash's first bits finds where to look."""

    def __init__(self, code, logp, low, bow):
        key = mix(code.astype(U))  # one to one, so no two n-grams meet
        order = np.argsort(key)
        self.key, self.logp, self.low, self.bow = key[order], logp[order].astype(np.float32), low[order].astype(np.float32), bow[order].astype(np.float32)
        self.shift = 64 - max(1, int(2 * len(key)).bit_length())
        self.first = np.searchsorted(self.key >> U(self.shift), np.arange((1 << (64 - self.shift)) + 1).astype(U)).astype(np.int32)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Places of n-grams, -1 where they are absent."""
        want = mix(code)
        at = self.first[(want >> U(self.shift)).astype(np.int64)]
        if not len(self.key):
            return np.full(len(code), -1)
        last = len(self.key) - 1
        left = np.flatnonzero(self.key[np.minimum(at, last)] < want)
        while len(left):
            at[left] += 1
            left = left[at[left] <= last]
            left = left[self.key[at[left]] < want[left]]
        at = np.minimum(at, last)
        return np.where(self.key[at] == want, at, -1)


class Scorer:
    """Log-probabilities by language; ``bits`` has each language's average at both orders."""

    def __init__(self, tables: dict[str, dict[int, Sorted]], bits: dict[str, tuple[float, float]]):
        self.tables, self.bits = tables, bits

    def prices(self, own: str, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each n-gram's last byte at order ORDER and at order LOW, with back-off for n-grams that the language lacks."""
        tables = self.tables.get(own, {})
        if ORDER in tables and (at := tables[ORDER].find(code)).min(initial=0) >= 0:
            return -tables[ORDER].logp[at], -tables[ORDER].low[at]
        out, spent, left = np.zeros((2, len(code))), np.zeros((2, len(code))), np.arange(len(code))
        for n in range(ORDER, 0, -1):
            if n not in tables or not len(left):
                continue
            own_code = code[left] & U((1 << 8 * n) - 1)
            at = tables[n].find(own_code)
            hit = at >= 0
            done, place = left[hit], at[hit]
            out[0, done], out[1, done] = spent[0, done] - tables[n].logp[place], spent[1, done] - tables[n].low[place]
            left = left[~hit]
            if n > 1 and n - 1 in tables and len(left):
                at = tables[n - 1].find(own_code[~hit] >> U(8))
                weight = np.where(at >= 0, tables[n - 1].bow[at], 0.0)
                spent[0, left] -= weight
                if n <= LOW:
                    spent[1, left] -= weight
        out[:, left] = spent[:, left] + 8.0  # a byte that the language lacks
        return out[0], out[1]

    def total(self, own: str, data: np.ndarray, off: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Bits at both orders between edges (ascending places in the data)."""
        out = np.zeros((2, len(edges)))
        so_far = np.zeros(2)
        for a in range(0, len(data), BLOCK):
            b = min(a + BLOCK, len(data))
            inside = np.flatnonzero((edges > a) & (edges <= b))
            for k, price in enumerate(self.prices(own, grams(data, off, a, b))):
                sums = np.cumsum(price, dtype=np.float64)
                out[k, inside] = so_far[k] + sums[edges[inside] - a - 1]
                so_far[k] += sums[-1]
        return np.diff(out, axis=1) if len(edges) else out

    def scores(self, own: str, data: np.ndarray, off: np.ndarray, others: bool = True) -> dict[str, np.ndarray]:
        """Of each document: bits a byte, high, low, far (if it is off); and of one that is off, if ``others``, the other language that fits it best, with its scores."""
        size = np.diff(off)
        bits = self.total(own, data, off, off) / np.maximum(size, 1)
        score = np.where(size > 0, bits - np.array(self.bits.get(own, (8.0, 8.0)))[:, None], 0)
        out = {"bits": bits[0], "high": score[0], "low": score[1], "other": np.full(len(size), None, object), "other_high": np.zeros(len(size)), "other_low": np.zeros(len(size))}
        out["far"] = (np.abs(score) > FAR).any(axis=0)
        far = np.flatnonzero(out["far"] & others)
        ends = np.concatenate([[0], np.cumsum(size[far])])
        for a, b in blocks(ends, BLOCK):
            here = far[a:b]
            bad = (score[:, here] > FAR).any(axis=0)
            for k, found in self._elsewhere(own, gather(data, off[here], size[here]), ends[a : b + 1] - ends[a]).items():
                out[k][here] = np.where(bad, found, out[k][here]) if k in ("bits", "high", "low") else found
        return out

    def _elsewhere(self, own: str, data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        """The same of documents that are not empty, with every RUN words in the language that prices them least at each order."""
        start, _, word_off = words(data, off)
        number = np.arange(len(start)) - np.repeat(word_off[:-1], np.diff(word_off))
        edges = np.unique(np.concatenate([off, start[(number > 0) & (number % RUN == 0)]]))
        names = sorted(self.bits)
        usual = np.array([self.bits[name] for name in names])
        price = np.stack([self.total(name, data, off, edges) for name in names])
        doc, size = np.searchsorted(off, edges[:-1], "right") - 1, np.diff(off)
        a_byte = lambda x: np.bincount(doc, x, len(size)) / size
        out = {}
        for k, name in enumerate(("high", "low")):
            best = price[:, k].argmin(axis=0)
            paid = price[best, k, np.arange(len(best))]
            out[name] = np.maximum(0, a_byte(paid - usual[best, k] * np.diff(edges)))
            if not k:
                out["bits"] = a_byte(paid)
        whole = np.array([[a_byte(x) for x in pair] for pair in price]) - usual[:, :, None]
        worst = np.abs(whole).max(axis=1)
        if own in names:
            worst[names.index(own)] = np.inf
        fit = worst.argmin(axis=0)
        each = np.arange(len(size))
        out["other"] = np.where(np.isfinite(worst[fit, each]), np.array(names, object)[fit], None)
        return out | {"other_high": whole[fit, 0, each], "other_low": whole[fit, 1, each]}


def _grouped(rows: pa.Table):
    """(own, rows as arrays) of each language of a table."""
    owns = rows["own"].combine_chunks().dictionary_encode()
    owns = owns.combine_chunks() if isinstance(owns, pa.ChunkedArray) else owns
    group = owns.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sort = np.argsort(group)
    columns = {c: rows[c].to_numpy()[sort] for c in rows.column_names if c != "own"}
    edge = np.flatnonzero(np.diff(group[sort], prepend=-1))
    for a, b in zip(edge, [*edge[1:], len(sort)]):
        yield owns.dictionary[int(group[sort[a]])].as_py(), {c: x[a:b] for c, x in columns.items()}


def average_bits(model: DataFrame) -> dict[str, tuple[float, float]]:
    """Each language's bits a byte at both orders over all its documents; a row a language reaches the driver."""
    top = model.where(F.col("order") == ORDER).groupBy("own").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("logp")).alias("p"), F.sum(F.col("c") * F.col("low")).alias("q"))
    return {r["own"]: (-r["p"] / r["n"], -r["q"] / r["n"]) for r in top.collect()}


def per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def measures(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    docs = len(off) - 1
    start, end, word_off = words(data, off)
    ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    out = {"n_words": np.diff(word_off), "word_chars": per_doc(ink & ((data & 0xC0) != 0x80), off)}
    out["n_symbols"] = per_doc(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), off)
    # lines: from a document's start or behind a line feed, up to the next one
    feed = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([off[:-1], feed + 1]))
    owner = np.searchsorted(off, line_start, "right") - 1
    # a feed that ends its document starts an empty line, which has no word; its place may be the next document's
    line_end = np.minimum(np.append(line_start[1:], len(data)), np.append(off, len(data))[np.minimum(owner + 1, docs)])
    has_feed = np.zeros(len(line_start), bool)
    has_feed[line_end > line_start] = data[line_end[line_end > line_start] - 1] == 10
    line_end = line_end - has_feed
    inked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ink, out=inked[1:])
    worded = (line_end > line_start) & (inked[np.maximum(line_end, line_start)] > inked[line_start])
    owner = owner[worded]
    again = repeats(span_hash(data, line_start[worded], line_end[worded]), owner)
    out["n_dup_lines"] = np.bincount(owner[again == 2], minlength=docs).astype(np.int64)
    window = rolling(span_hash(data, start, end), WINDOW)
    at = np.flatnonzero(window_mask(word_off, WINDOW)[: len(window)])
    hit = np.zeros(len(start), bool)
    hit[at] = repeats(window[at], np.searchsorted(word_off, at, "right") - 1) > 0
    out["n_repeat_words"] = per_doc(covered(hit, WINDOW), word_off)
    return out


def repeats(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each key: 0 alone in its document, 1 the first of several, 2 a later one."""
    out = np.zeros(len(key), np.int8)
    if not len(key):
        return out
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    first, later = np.append(same, False), np.insert(same, 0, False)
    out[order[first & ~later]] = 1
    out[order[later]] = 2
    return out


def _scored(batch, lang_at: int, text_at: int, carried: list[int], scorer: Scorer, others: bool = True) -> tuple[pa.RecordBatch, np.ndarray]:
    """row (the carried columns), own, other, measures, perplexity and scores in steps; and which documents are off their language."""
    langs, texts = (batch.column(i).cast(pa.string()) for i in (lang_at, text_at))
    data, off = utf8(texts)
    parts = [measures(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in blocks(off, BLOCK)]
    found = [np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]).astype(np.int64) for k in MEASURES]
    found_at = {"bits": np.zeros(batch.num_rows), **{k: np.zeros(batch.num_rows) for k in SCORES}, "own": np.full(batch.num_rows, "", object), "other": np.full(batch.num_rows, None, object), "far": np.zeros(batch.num_rows, bool)}
    for own, at in _languages(langs):
        found_at["own"][at] = own
        for k, values in scorer.scores(own, *utf8(texts.take(pa.array(at))), others).items():
            found_at[k][at] = values
    steps = [pa.array(np.rint(found_at[k] * BINS).astype(np.int64)) for k in SCORES]
    names = [pa.array(found_at[k], pa.string()) for k in ("own", "other")]
    row = pa.StructArray.from_arrays([batch.column(i) for i in carried], fields=[batch.schema.field(i) for i in carried])
    out = pa.RecordBatch.from_arrays([row, *names, *map(pa.array, found), pa.array(np.exp2(found_at["bits"])), *steps], ["row", "own", "other", *MEASURES, "perplexity", *SCORES])
    return out, found_at["far"]


def scored(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all, if not given) in ``row`` (a struct), own, other, measures, perplexity, and the scores in steps.  A durable table."""
    plain = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    top = durable(count_grams(plain), "grams")
    lang_at, text_at = docs.columns.index(lang_column), docs.columns.index(text_column)
    carried = [docs.columns.index(c) for c in columns or docs.columns]
    fields = [("row", T.StructType([docs.schema.fields[i] for i in carried])), ("own", T.StringType()), ("other", T.StringType()), *[(k, T.LongType()) for k in MEASURES], ("perplexity", T.DoubleType()), *[(k, T.LongType()) for k in SCORES]]
    schema = T.StructType([T.StructField(k, t) for k, t in fields])
    size = top.count()
    if size <= BROADCAST_GRAMS:
        tables, usual = {}, {}
        for own, at in _grouped(top.toArrow()):
            levels, usual[own] = kneser_ney(at["code"], at["c"])
            tables[own] = {n: Sorted(*level) for n, level in levels.items()}
        shared = docs.sparkSession.sparkContext.broadcast(tables)

        def run(batches):
            scorer = Scorer(shared.value, usual)
            for batch in batches:
                yield _scored(batch, lang_at, text_at, carried, scorer)[0]

        out = durable(arrow(docs, run, schema), "scored")
        shared.destroy()
    else:
        model, n = trained(top), max(LEAST_BUCKETS, -(-size // BUCKET))
        usual = average_bits(model)
        own = model.where(F.col("order") == ORDER).select("own", "code", (-F.col("logp")).alias("high"), (-F.col("low")).alias("low"))
        first = _dealt_out(docs, own, n, usual, lang_at, text_at, carried, schema, False)
        out, far = first.where("whole is null").drop("whole"), first.where("whole is not null").select("whole.*")
        if not small(far, 0):
            prices = everywhere(model, sorted(usual))
            out = out.unionByName(_dealt_out(far, prices, n, usual, lang_at, text_at, carried, schema, True))
            forget(prices)
        forget(model)
    forget(top)
    return out


def everywhere(model: DataFrame, owns: list[str]) -> DataFrame:
    """own, code, high, low: bits of every n-gram of order ORDER in every language, with back-off where the language lacks it.  A durable table."""
    before = None
    for n in range(1, ORDER + 1):
        level = model.where(F.col("order") == n)
        pairs = level.select("code").distinct().withColumn("own", F.explode(F.lit(owns)))
        now = pairs.join(level.select("own", "code", "logp", F.col("low").alias("logp_low")), ["own", "code"], "left")
        if n == 1:  # a byte that the language lacks
            high = low = F.lit(8.0)
        else:
            now = now.withColumn("ctx", F.shiftright("code", 8)).withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
            weight = model.where(F.col("order") == n - 1).select("own", F.col("code").alias("ctx"), "bow")
            now = now.join(weight, ["own", "ctx"], "left").join(before.withColumnRenamed("code", "suffix"), ["own", "suffix"], "left")
            spent = F.coalesce("bow", F.lit(0.0))
            high, low = F.col("high") - spent, F.col("low") - spent if n <= LOW else F.col("low")
        now = durable(now.select("own", "code", F.coalesce(-F.col("logp"), high).cast("double").alias("high"), F.coalesce(-F.col("logp_low"), low).cast("double").alias("low")), f"prices{n}")
        if before is not None:
            forget(before)
        before = now
    return before


def _by_bucket(code: np.ndarray, n: int):
    """(bucket, places) of each bucket that has any of these n-grams; places stay in order."""
    at = buckets(mix(code), n)
    order = np.argsort(at, kind="stable")
    edge = np.flatnonzero(np.diff(at[order], prepend=-1))
    for a, b in zip(edge, [*edge[1:], len(order)]):
        yield int(at[order[a]]), order[a:b]


def _pressed(code: np.ndarray) -> bytes:
    """Ascending n-grams in few bytes."""
    return pa.compress(np.diff(code, prepend=U(0)).tobytes(), "zstd", asbytes=True)


def _unpressed(body: bytes, size: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(body, decompressed_size=8 * size, codec="zstd"), U), dtype=U)


#: Of what the buckets get: n-grams of the model with their prices (chunk -1), and of a chunk without (own null: in every language).
SENT = ["bucket", "chunk", "own", "size", "codes", "prices"]
SENT_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
SENT_SCHEMA = "bucket int, chunk bigint, own string, size int, codes binary, prices binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), SENT_TYPES)], SENT)


def _dealt_out(docs: DataFrame, prices: DataFrame, n: int, usual: dict, lang_at: int, text_at: int, carried: list[int], schema, others: bool) -> DataFrame:
    """The same for any size of the model, by ``n`` buckets of ``prices`` (own, code, high, low).  A durable table.

    Without ``others`` texts are priced in their own language only, and those
    that are off are given back in ``whole`` (a struct of all columns), else null.
    """

    def cut(batches):
        from pyspark import TaskContext

        task, seq, parts = TaskContext.get().partitionId(), 0, []

        def chunk():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for part in parts:
                    stream.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "body"])

        for batch in batches:
            _, off = utf8(batch.column(text_at).cast(pa.string()))
            for a, b in blocks(off, BLOCK):
                parts.append(batch.slice(a, b - a))
                if sum(part.nbytes for part in parts) >= CHUNK:
                    yield chunk()
                    seq, parts = seq + 1, []
        if parts:
            yield chunk()

    def asked(batches):
        for chunk, body in ((c, b) for batch in batches for c, b in zip(*(x.to_pylist() for x in batch.columns))):
            held: dict[str | None, list] = {}
            for part in pa.ipc.open_stream(body):
                langs, texts = (part.column(i).cast(pa.string()) for i in (lang_at, text_at))
                for own, at in [(None, np.arange(part.num_rows))] if others else _languages(langs):
                    data, off = utf8(texts.take(pa.array(at)))
                    for a in range(0, len(data), BLOCK):
                        held.setdefault(own, []).append(np.unique(grams(data, off, a, min(a + BLOCK, len(data)))))
                        if sum(map(len, held[own])) > HELD:
                            held[own] = [np.unique(np.concatenate(held[own]))]
            rows = []
            for own, codes in held.items():
                code = np.unique(np.concatenate(codes))
                rows += [(bucket, chunk, own, len(at), _pressed(code[at]), None) for bucket, at in _by_bucket(code, n)]
            if rows:
                yield _rows(rows)

    def packed(batches):
        for batch in batches:
            rows = []
            for own, at in _grouped(pa.Table.from_batches([batch])):
                order = np.argsort(at["code"])
                code, price = at["code"][order].astype(U), np.stack([at["high"], at["low"]]).astype(np.float32)[:, order]
                rows += [(bucket, -1, own, len(x), _pressed(code[x]), price[:, x].tobytes()) for bucket, x in _by_bucket(code, n)]
            if rows:
                yield _rows(rows)

    def sealed(parts):
        """A bucket's n-grams in order with their prices; one that it lacks has the price behind the last."""
        known, price = (np.concatenate(x, axis=-1) for x in zip(*parts))
        order = np.argsort(known)
        return np.append(known[order], ~U(0)), np.append(price[:, order], np.full((2, 1), 8, np.float32), axis=1)

    def answered(batches):
        now, parts, model = None, {}, {}
        for batch in batches:
            rows = []
            for bucket, chunk, own, size, codes, price in zip(*(x.to_pylist() for x in batch.columns)):
                if bucket != now:
                    now, parts, model = bucket, {}, {}
                code = _unpressed(codes, size)
                if chunk < 0:  # these come first
                    parts.setdefault(own, []).append((code, np.frombuffer(price, np.float32).reshape(2, -1)))
                    continue
                model |= {name: sealed(parts.pop(name)) for name in list(parts)}
                for name in model if own is None else [own] if own in model else []:
                    known, price = model[name]
                    at = np.searchsorted(known, code)
                    rows.append((bucket, chunk, name, size, codes, price[:, np.where(known[at] == code, at, -1)].tobytes()))
            if rows:
                yield _rows(rows)

    def score(docs_of, answers):
        tables: dict[str, list] = {}
        for own, size, codes, price in zip(*(answers[c].to_pylist() for c in ("own", "size", "codes", "prices"))):
            tables.setdefault(own, []).append((_unpressed(codes, size), np.frombuffer(price, np.float32).reshape(2, -1)))
        for own, parts in tables.items():
            code, price = (np.concatenate(x, axis=-1) for x in zip(*parts))
            tables[own] = {ORDER: Sorted(code, -price[0], -price[1], np.zeros(len(code)))}
        scorer = Scorer(tables, usual)
        for body in docs_of["body"]:
            for batch in pa.ipc.open_stream(body.as_buffer()):
                out, far = _scored(batch, lang_at, text_at, carried, scorer, others)
                if others:
                    yield out
                    continue
                whole = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
                names, near, far = [*out.schema.names, "whole"], out.filter(pa.array(~far)), whole.filter(pa.array(far))
                yield pa.RecordBatch.from_arrays([*near.columns, pa.nulls(near.num_rows, whole.type)], names)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(far), f.type) for f in out.schema), far], names)

    def told(docs_of, answers):
        return pa.Table.from_batches(list(score(docs_of, answers)))

    held = durable(arrow(docs, cut, "chunk bigint, body binary"), "held")
    sent = arrow(prices.select("own", "code", "high", "low"), packed, SENT_SCHEMA, 1 << 16).unionByName(arrow(held, asked, SENT_SCHEMA))
    sorted_ = sent.repartition(n, "bucket").sortWithinPartitions("bucket", "chunk")
    answers = arrow(sorted_, answered, SENT_SCHEMA, 64).select("chunk", "own", "size", "codes", "prices")
    if not others:
        schema = T.StructType([*schema.fields, T.StructField("whole", docs.schema)])
    out = durable(held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(told, schema), "scored")
    forget(held)
    return out


def _histogram(rows: DataFrame) -> DataFrame:
    """own, kind (high or low), at, n: documents by score, combined on the map side."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("at")) for k in ("high", "low")])
    return rows.select("own", F.explode(pairs).alias("p")).select("own", "p.kind", "p.at").groupBy("own", "kind", "at").agg(F.count(F.lit(1)).alias("n"))


def bands(found: DataFrame, lower: float, upper: float, good: DataFrame | None) -> DataFrame:
    """own, and for each score the least and greatest steps of its band; a row a language.

    ``good`` has the own, high and low of the documents labelled good.
    """
    counts = durable(_histogram(found.where(F.col("n_words") >= MIN_WORDS)), "counts")
    middle = counts.groupBy("own", "kind").agg(F.percentile("at", F.lit(0.5), F.col("n")).alias("mid"))
    apart = counts.join(middle, ["own", "kind"]).groupBy("own", "kind", "mid")
    out = apart.agg(F.greatest(F.lit(float(LEAST_DEVIATION)), F.percentile(F.abs(F.col("at") - F.col("mid")), F.lit(0.5), F.col("n"))).alias("dev"))
    down, up = F.lit(float(lower)), F.lit(float(upper))
    if good is not None:
        tail = (1 - GOOD_SHARE) / 2
        away = _histogram(good).join(out, ["own", "kind"]).select("own", "kind", "n", ((F.col("at") - F.col("mid")) / F.col("dev")).alias("away"))

        def tails(prefix):
            ends = [(-F.percentile("away", F.lit(tail), F.col("n"))).alias(prefix + "down"), F.percentile("away", F.lit(1 - tail), F.col("n")).alias(prefix + "up")]
            return [F.sum("n").alias(prefix + "n"), *ends]

        out = out.join(away.groupBy("own", "kind").agg(*tails("own_")), ["own", "kind"], "left").join(away.groupBy("kind").agg(*tails("all_")), "kind", "left")

        def width(side, given):
            for p in ("all_", "own_"):
                given = F.when(F.col(p + "n") >= LEAST_GOOD, F.greatest(F.lit(LEAST_WIDTH), F.col(p + side))).otherwise(given)
            return given

        down, up = width("down", down), width("up", up)
    ends = out.select("own", "kind", (F.col("mid") - down * F.col("dev")).alias("least"), (F.col("mid") + up * F.col("dev")).alias("most"))
    one = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}")
    return ends.groupBy(F.col("own").alias("band")).agg(*[one(k, c) for k in ("high", "low") for c in ("least", "most")])


def judged(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, text_column: str = "text", lang_column: str = "lang", labels: DataFrame | None = None, id_column: str = "doc_id", label_id: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all, if not given) in ``row`` (a struct), with measures, base_failed, perplexity and kept.

    ``labels`` (``label_id``, quality 0 or 1), where given and enough, take the place of ``lower`` and ``upper``.
    """
    found = scored(docs, text_column, lang_column, columns)
    good = None
    if labels is not None:
        listed = labels.where("quality = 1").select(F.col(label_id).alias("label_id")).distinct()
        named = found.where(F.col("n_words") >= MIN_WORDS).select(F.col("row").getField(id_column).alias("label_id"), "own", "high", "low")
        good = named.join(listed, "label_id")
    band = durable(bands(found, lower, upper, good), "bands")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))

    def within(prefix):
        return reduce(and_, [F.col(prefix + k).between(F.col(f"{prefix}{k}_least"), F.col(f"{prefix}{k}_most")) for k in ("high", "low")])

    ends = [c for c in band.columns if c != "band"]
    elsewhere = band.select(F.col("band").alias("other_band"), *[F.col(c).alias("other_" + c) for c in ends])
    if small(band, BROADCAST_BANDS):
        band, elsewhere = F.broadcast(band), F.broadcast(elsewhere)
    out = found.join(band, F.col("own") == F.col("band"), "left").join(elsewhere, F.col("other") == F.col("other_band"), "left").withColumn("base_failed", failed)
    fits = F.coalesce(within(""), F.lit(True)) | F.coalesce(within("other_"), F.lit(False))
    return out.select("row", *MEASURES, "base_failed", "perplexity", (~F.col("base_failed") & fits).alias("kept"))


def verdicts(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", labels: DataFrame | None = None) -> DataFrame:
    """id, n_words, the four measures, base_failed, perplexity, kept."""
    slim = docs.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    out = judged(slim, lower, upper, labels=labels, id_column="id", label_id=id_column, columns=["id"])
    return out.select(F.col("row.id").alias(id_column), *MEASURES, "base_failed", "perplexity", "kept")


def keep(docs: DataFrame, lower: float = LOWER, upper: float = UPPER, text_column: str = "text", lang_column: str = "lang", labels: DataFrame | None = None, id_column: str = "doc_id") -> DataFrame:
    """The documents that stay, with their columns."""
    return judged(docs, lower, upper, text_column, lang_column, labels, id_column, id_column).where("kept").select("row.*")
