"""Predicates over key-value rows: globs, comparisons, conditions.

Comparison follows two rules: ``=`` and ``!=`` compare strings; the others
compare numbers where both sides start with one, else strings by bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal number at the start, as strtod reads it; hex, inf and nan are left out.
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
OPERATORS = ("=", "==", "!=", ">", "<", ">=", "<=", "LIKE", "NOT_LIKE")


def unquoted(value: Column) -> Column:
    """Without one pair of double quotes around it."""
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(value.rlike(r'(?s)^".*"$') & (F.length(value) >= 2), inner).otherwise(value)


def number(value: Column) -> Column:
    """The leading number as a double; null where there is none."""
    found = F.regexp_extract(unquoted(value), NUMBER, 1)
    return F.when(found != "", found).try_cast("double")


def literal_number(value: str) -> float | None:
    text = value[1:-1] if len(value) >= 2 and value[0] == value[-1] == '"' else value
    found = re.match(NUMBER, text)
    return float(found[1]) if found else None


def glob_regex(pattern: str) -> str:
    """Whole-string regular expression of a glob with ``*`` and ``?``."""
    parts = {"*": ".*", "?": "."}
    return r"\A(?:" + "".join(parts.get(c) or (c if c.isalnum() or c in "_ " or ord(c) > 127 else "\\" + c) for c in pattern) + r")\z"


def glob(column: Column, pattern: str) -> Column:
    """``*`` is any run and ``?`` any character but a line feed; without either the pattern is a prefix; an empty one fits all.

    The literal start is also given as a prefix, which Parquet scans can use.
    """
    if not pattern:
        return F.lit(True)
    start = re.match(r"[^*?]*", pattern)[0]
    if start == pattern:
        return column.startswith(pattern)
    whole = column.rlike(glob_regex(pattern))
    return column.startswith(start) & whole if start else whole


def compare(column: Column, operator: str, literal: str) -> Column:
    """One comparison with a literal by the two rules above."""
    ops = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    operator = operator.upper()
    if operator in ("=", "=="):
        return column == literal
    if operator == "!=":
        return column != literal
    if operator == "LIKE":
        return glob(column, literal)
    if operator == "NOT_LIKE":
        return ~glob(column, literal)
    if operator not in ops:
        raise ValueError(f"unknown operator {operator!r}; one of {', '.join(OPERATORS)}")
    text = ops[operator](column, F.lit(literal))
    if (value := literal_number(literal)) is None:
        return text
    own = number(column)
    return F.when(own.isNotNull(), ops[operator](own, F.lit(value))).otherwise(text)


@dataclass(frozen=True)
class Condition:
    """field is ``key`` or, for any other name, the value."""

    field: str
    operator: str
    literal: str

    def column(self, key: str = "key", value: str = "value") -> Column:
        return compare(F.col(key if self.field == "key" else value), self.operator, self.literal)


def combined(conditions: list[Condition], use_and: bool = True) -> Column:
    """All (or any) of the conditions; none at all lets every row through."""
    if not conditions:
        return F.lit(True)
    columns = [c.column() for c in conditions]
    return reduce(lambda a, b: a & b if use_and else a | b, columns)


def matches_any(column: Column, patterns: list[str]) -> Column:
    """Whole match of any regular expression; no patterns let everything through."""
    if not patterns:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [column.rlike(rf"\A(?:{p})\z") for p in patterns])
