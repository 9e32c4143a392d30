"""Tokenizing on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that search results depend on.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "will", "with", "the", "this", "but", "they", "have",
    "had", "what", "said", "each", "which", "she", "do", "how", "their",
    "if", "up", "out", "many", "then", "them", "these", "so", "some",
    "her", "would", "make", "like", "into", "him", "time", "two", "more",
    "go", "no", "way", "could", "my", "than", "first", "been", "call",
    "who", "oil", "sit", "now", "find", "down", "day", "did", "get",
    "come", "made", "may", "part",
)
SHORTEST, LONGEST = 2, 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """ASCII letters only, so that bytes beyond ASCII stay as they are."""
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column, drop_numbers: bool = False) -> Column:
    """Words without ASCII punctuation, lower case, 2 to 50 bytes, no stop words."""
    words = F.split(F.regexp_replace(lowered(text), r"[!-/:-@\[-`{-~]", ""), r"[ \t\n\x0B\f\r]+")
    kept = F.filter(words, lambda w: F.octet_length(w).between(SHORTEST, LONGEST) & ~w.isin(*sorted(set(STOP_WORDS))))
    return F.filter(kept, lambda w: ~w.rlike(r"^[0-9.+-]+$")) if drop_numbers else kept


def query_tokens(text: str, drop_numbers: bool = False) -> list[str]:
    """The same rule for a query string."""
    strip = str.maketrans(UPPER, LOWER, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    words = [w for w in text.translate(strip).split() if SHORTEST <= len(w.encode()) <= LONGEST and w not in STOP_WORDS]
    return [w for w in words if not (drop_numbers and all(c in "0123456789" for c in w))]
