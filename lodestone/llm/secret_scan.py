"""Operator 3: secrets by pattern, and credential values that are hard to guess.

Three patterns find assignments, access keys and hex runs.  Then every value in
a credential context is priced by dynamic programming: the least bits that it
takes to write it as known words, dates, repeats, keyboard walks and brute-force
spans, whatever their places, lengths and periods.  Values that cost at least
``min_bits`` give a ``guess`` span.  Known words are the ``DICTIONARY`` most
frequent words of all documents, counted in Spark and priced by their rank, and
some words that passwords are made of.

Spans are code points with an exclusive end.  Starts of repeats and walks that
can no longer be the cheapest are dropped, so that values are priced whole in
about linear time, however long they are.

Defined results: a null or empty text has no spans; texts are scanned whole;
repeated rows each give a row; words equally frequent rank by their letters;
other columns are passed over (or, in :func:`redact`, kept).
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import blocks, span_hash, utf8
from ._common import arrow

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as those of [0-9a-f]+ that are long enough
#: Wider than ASSIGN: more names (as whole words, or behind a small letter as in userPassword), arrows, and whole values.  In quotes a value goes up to the matching quote on its
#: line: one behind no backslash, with no character of the value behind it.  Otherwise it goes up to a blank.
CONTEXT = re.compile(
    r"""(?-i:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|bearer|(?:api|access|private|secret|signing|encryption)[_-]?key)["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*"""
    r"""(?:"((?:[^"\\\r\n]|\\[^\r\n]|"(?![\s,;:.)\]}>]|\Z))*)"|'((?:[^'\\\r\n]|\\[^\r\n]|'(?![\s,;:.)\]}>]|\Z))*)'|(\S))""",
    re.I | re.A,
)
BLANK, NESTED = re.compile(r"\s|\Z"), re.compile(r"""[{\[(]*["']""")
#: Characters of a value at least, and marks that end the sentence around a value without quotes.
LEAST_VALUE, TRAILING = 6, ".,;:)]}>\"'`"
#: Bits from which on a value counts as a secret: 2**36 guesses.
MIN_BITS = 36.0
#: Common passwords and credential words, most common first; the rank prices them.
WORDS = (
    "password 123456 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey letmein shadow master 696969 michael "
    "mustang 666666 superman 654321 superuser access love sunshine iloveyou princess admin welcome login hello freedom whatever trustno1 starwars computer "
    "secret test testing guest root user demo example sample changeme default temp dummy placeholder none null undefined true false your token here string "
    "value pass passwd passphrase key apikey private public client server database account email name username insert replace redacted hidden required "
    "optional empty unknown localhost local development production staging system service config setting summer winter spring autumn monday friday january"
).split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: Words counted in the documents that are known, and their letters.
DICTIONARY, SHORTEST, LONGEST = 1 << 14, 3, 20
BLOCK = 1 << 19
LEET = str.maketrans("4@301$57", "aaeoisst")
#: Keyboard rows, each shifted by half a key against the one above.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (2 * x + y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_YEAR, _MONTH, _DAY, _MARK = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"[-/.]?"
DATES = [re.compile(x, re.A) for x in (_YEAR + _MARK + _MONTH + _MARK + _DAY, _DAY + _MARK + _MONTH + _MARK + _YEAR, _YEAR)]
DATE_BITS, YEAR_BITS, SPAN_BITS, WALK_BITS, TURN_BITS = math.log2(366 * 200 * 6), math.log2(200), 1.0, math.log2(47), 3.0


def char_bits(c: str) -> float:
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log2(26)
    if "0" <= c <= "9":
        return math.log2(10)
    return math.log2(33) if c < "\x80" else math.log2(100)


def _step(a: str, b: str):
    """The direction from key a to key b if they are neighbours, or from a character to the next one."""
    if a in PLACE and b in PLACE:
        dx, dy = PLACE[b][0] - PLACE[a][0], PLACE[b][1] - PLACE[a][1]
        if (abs(dx), dy) == (2, 0) or (abs(dx), abs(dy)) == (1, 1):
            return dx, dy
    if ord(b) - ord(a) in (1, -1) and a.isalnum() and b.isalnum():
        return ord(b) - ord(a), 9
    return None


class _Starts:
    """The cheapest start of a span whose price grows by the logarithm of its length.

    Of two starts, a later one is ahead by less and less, so one that is behind
    an earlier one is dropped for good.
    """

    def __init__(self):
        self.open: list[tuple[int, float]] = []

    def add(self, at: int, price: float) -> None:
        while self.open and self.open[-1][1] >= price:
            self.open.pop()
        self.open.append((at, price))

    def least(self, end: int) -> float:
        out, kept = math.inf, []
        for at, price in self.open:
            now = price + math.log2(end - at)
            if now < out:
                out = now
                kept.append((at, price))
        self.open = kept
        return out


def guess_bits(value: str, limit: float = math.inf, rank: dict[str, int] = RANK) -> float:
    """Bits of the cheapest segmentation, or some number from ``limit`` on if that is not below it; 0 for an empty value."""
    if limit == math.inf:  # periods are tried as far as a limit pays for them, so small limits go first
        limit = 64.0
        while (bits := guess_bits(value, limit, rank)) >= limit:
            limit *= 2
        return bits
    n = len(value)
    low = value.lower()
    if len(low) != n:  # some capitals fold to two characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    price = [char_bits(c) for c in value]
    upto = [0.0]
    for p in price:
        upto.append(upto[-1] + p)
    dates: dict[int, list[tuple[int, float]]] = {}
    for at in range(n - 3):
        if low[at].isdigit():
            for pattern in DATES:
                if m := pattern.match(low, at):
                    dates.setdefault(m.end(), []).append((at, YEAR_BITS if m.end() - at == 4 else DATE_BITS))
    best, brute = [0.0] + [math.inf] * n, math.inf
    periods = int(min(n // 2, limit // math.log2(10)))  # a period is paid for by the character
    run, repeats = [0] * (periods + 1), [_Starts() for _ in range(periods + 1)]
    walk, walks, turns, direction = 0, _Starts(), [0] * n, None
    for i in range(1, n + 1):
        k = i - 1
        brute = min(brute, best[k] + SPAN_BITS) + price[k]
        least = brute
        for size in range(2, min(LONGEST, i) + 1):
            a = i - size
            if best[a] < limit:
                for word, extra in ((low[a:i], 0.0), (plain[a:i], 2.0)):
                    if word in rank:
                        shown = 0.0 if value[a:i] == low[a:i] else 2.0
                        least = min(least, best[a] + SPAN_BITS + math.log2(rank[word] + 1) + shown + extra)
        for a, bits in dates.get(i, ()):
            least = min(least, best[a] + SPAN_BITS + bits)
        for p in range(1, min(periods, k) + 1):
            if value[k] != value[k - p]:
                run[p] = k - p + 1
                repeats[p].open.clear()
            a = i - max(2 * p, 3)  # the last start whose span is long enough
            if a >= run[p] and best[a] < limit:
                repeats[p].add(a, best[a] + SPAN_BITS + upto[a + p] - upto[a] - math.log2(p))
            if repeats[p].open:
                least = min(least, repeats[p].least(i))
        if k:
            step = _step(low[k - 1], low[k])
            if step is None:
                walk, direction = k, None
                walks.open.clear()
            turns[k] = turns[k - 1] + (direction is not None and step is not None and step != direction)
            direction = step
            a = i - 3
            if a >= walk and best[a] < limit:
                walks.add(a, best[a] + SPAN_BITS + WALK_BITS - TURN_BITS * turns[a + 1])
            if walks.open:
                least = min(least, walks.least(i) + TURN_BITS * turns[k])
        best[i] = least
    return best[n]


def values(text: str):
    """(start, end) of every whole value in a credential context.

    Values in quotes may stand inside one without quotes, as in JSON.
    """
    at = run = 0
    while m := CONTEXT.search(text, at):
        a, b = m.span(m.lastindex)
        at = b
        if m.lastindex == 3:
            at = a
            if b <= run:  # inside the last such value
                continue
            run = BLANK.search(text, a).start()
            if text[a] in "{[(" and NESTED.match(text, a):  # a structure, whose values have names of their own
                continue
            a += text[a] in "\"'"  # not closed on its line
            b = a + len(text[a:run].rstrip(TRAILING))
        if b - a >= LEAST_VALUE:
            yield a, b


def scan(text: str | None, min_bits: float = MIN_BITS, rank: dict[str, int] = RANK) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind."""
    if not text:
        return []
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        found += [("guess", a, b) for a, b in values(text) if guess_bits(text[a:b], min_bits, rank) >= min_bits]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def ranked_words(docs: DataFrame, text_column: str = "text", size: int = DICTIONARY) -> dict[str, int]:
    """Ranks of the ``size`` most frequent words (runs of SHORTEST to LONGEST letters, lower-case) of all documents; ``size`` rows reach the driver.

    A word on one place only is not known, so that a secret does not make itself a word.
    """
    fold = np.zeros(256, np.uint8)
    fold[65:91] = fold[97:123] = np.arange(97, 123)

    def run(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            data, off = utf8(batch.column(0))
            for a, b in blocks(off, BLOCK):
                part = fold[np.insert(data[off[a] : off[b]], off[a + 1 : b] - off[a], 0)]  # texts are apart
                edge = np.diff((part > 0).astype(np.int8), prepend=0, append=0)
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                fit = (ends - starts >= SHORTEST) & (ends - starts <= LONGEST)
                start, end = starts[fit], ends[fit]
                _, one, n = np.unique(span_hash(part, start, end), return_index=True, return_counts=True)
                raw = part.tobytes()
                for s, e, c in zip(start[one].tolist(), end[one].tolist(), n.tolist()):
                    held[raw[s:e]] = held.get(raw[s:e], 0) + c
            if len(held) > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    counted = arrow(docs.select(F.col(text_column).cast("string").alias("text")), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(size).collect()
    return {r["word"]: i + 1 for i, r in enumerate(rows)}


def _ranks(docs: DataFrame, text_column: str):
    """The words of the documents and the fixed ones, as a broadcast variable."""
    rank = ranked_words(docs, text_column)
    for word, place in RANK.items():
        rank[word] = min(place, rank.get(word, place))
    return docs.sparkSession.sparkContext.broadcast(rank)


def find(docs: DataFrame, min_bits: float = MIN_BITS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_guess, base_sha256, spans."""
    id_type = docs.schema[id_column].dataType.simpleString()
    counts = ["n_assign", "n_access", "n_hex", "n_guess"]
    rank = _ranks(docs, text_column)

    def run(batches):
        for batch in batches:
            rows = [scan(t, min_bits, rank.value) for t in batch.column(1).to_pylist()]
            numbers = [pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64()) for k in KINDS]
            base = [hashlib.sha256(joined(s for s in r if s[0] != "guess").encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(base, pa.string()), pa.array([joined(r) for r in rows], pa.string())], [id_column, *counts, "base_sha256", "spans"])

    schema = f"`{id_column}` {id_type}, {', '.join(f'{c} bigint' for c in counts)}, base_sha256 string, spans string"
    return arrow(docs.select(id_column, F.col(text_column).cast("string").alias("text")), run, schema)


def redact(docs: DataFrame, min_bits: float = MIN_BITS, text_column: str = "text") -> DataFrame:
    """The same rows and columns with secrets masked in the text (null stays null)."""
    at, schema, rank = docs.columns.index(text_column), docs.schema, _ranks(docs, text_column)

    def run(batches):
        for batch in batches:
            texts = [t and mask(t, scan(t, min_bits, rank.value)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow(docs, run, schema)
