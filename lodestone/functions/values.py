"""Scalar functions on typed values: text forms, JSON both ways, conversion, order, collections, hashes, type guesses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type names in the order that decides between values of different types.
TYPES = ("NULL", "INT", "FLOAT", "DOUBLE", "STRING", "TIMESTAMP", "DATE", "LIST", "SET", "MAP", "BLOB")


def type_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TYPES)), F.upper(name)) - 1


def type_name(rank: Column) -> Column:
    """The name of a type's number; UNKNOWN for numbers that no type has."""
    return F.coalesce(F.get(F.array(*map(F.lit, TYPES)), rank), F.lit("UNKNOWN"))


def fixed(value: Column, places: int = 6) -> Column:
    """A floating number with fixed places."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value.cast("double")))


def list_text(items: Column, ends: str = "[]") -> Column:
    return F.concat(F.lit(ends[0]), F.array_join(items, ", "), F.lit(ends[1]))


def set_text(items: Column) -> Column:
    return list_text(F.array_sort(F.array_distinct(items)), "{}")


def map_text(value: Column) -> Column:
    """{k: v, ...} by key."""
    entries = F.array_sort(F.map_entries(value))
    return list_text(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "{}")


def blob_text(value: Column) -> Column:
    return F.concat(F.lit("BLOB("), F.octet_length(value).cast("string"), F.lit(" bytes)"))


def to_int(text: Column) -> Column:
    """The leading whole number of a string; null where there is none."""
    found = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.when(found != "", found).try_cast("bigint")


def truncated(value: Column) -> Column:
    """A floating number towards zero."""
    return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("bigint")


def convert(value: Column, source: str, target: str) -> Column:
    """Conversions that exist; others are an error, as they are for single values."""
    source, target = source.upper(), target.upper()
    if source == target:
        return value
    if target == "STRING":
        return fixed(value) if source in ("FLOAT", "DOUBLE") else F.date_format(value, "yyyy-MM-dd HH:mm:ss") if source == "TIMESTAMP" else value.cast("string")
    if target == "INT" and source in ("FLOAT", "DOUBLE"):
        return truncated(value)
    if target == "INT" and source == "STRING":
        return to_int(value)
    if target in ("FLOAT", "DOUBLE") and source in ("INT", "FLOAT", "DOUBLE"):
        return value.cast(target.lower())
    raise ValueError(f"no conversion from {source} to {target}")


def parse_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def parse_date(text: Column) -> Column:
    return F.regexp_replace(text, r"^(\d{1,4})\D(\d{1,2})\D(\d{1,2})$", "$1-$2-$3").try_cast("date")


# Lists count from 0; an index beyond the list leaves it as it is, and has_index tells.


def has_index(items: Column, index: Column | int) -> Column:
    return (F.lit(index) >= 0) & (F.lit(index) < F.size(items))


def list_clear(items: Column) -> Column:
    return F.slice(items, 1, 0)


def list_remove(items: Column, index: Column | int) -> Column:
    return F.filter(items, lambda x, i: i != index)


def list_set(items: Column, index: Column | int, value: Column) -> Column:
    return F.transform(items, lambda x, i: F.when(i == index, value).otherwise(x))


def set_add(items: Column, value: Column) -> Column:
    return F.array_sort(F.array_union(items, F.array(value)))


def set_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def set_intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def set_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def map_put(value: Column, key: Column, item: Column) -> Column:
    return F.map_concat(F.map_filter(value, lambda k, v: k != key), F.create_map(key, item))


def map_remove(value: Column, key: Column) -> Column:
    return F.map_filter(value, lambda k, v: k != key)


def inferred_type(value: Column) -> Column:
    """The narrowest type name that a string could have."""
    whole = value.rlike(r"^[+-]?\d+$")
    size = value.try_cast("decimal(38,0)")
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "STRING")
        .when(F.lower(value).isin("true", "false", "1", "0", "yes", "no"), "BOOL")
        .when(whole & size.between(0, 127), "VARINT")
        .when(whole & size.between(0, 4294967295), "UINT32")
        .when(whole & (size > 0), "UINT64")
        .when(whole & size.between(-2147483648, -1), "INT32")
        .when(whole, "INT64")
        .when(value.rlike(r"^[+-]?\d*\.?\d+([eE][+-]?\d+)?$"), "DOUBLE")
        .otherwise("STRING")
    )


#: Spark type of each inferred name.
SPARK_TYPE = {"BOOL": "boolean", "VARINT": "bigint", "UINT32": "bigint", "UINT64": "decimal(20,0)", "INT32": "int", "INT64": "bigint", "DOUBLE": "double", "STRING": "string"}


def key_pattern(key: Column) -> Column:
    """Each run of digits becomes a star."""
    return F.regexp_replace(key, r"\d+", "*")


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def composite_parts(key: Column) -> Column:
    return F.split(key, r"\|", -1)


def order_key(kind: Column, value: Column) -> Column:
    """What typed values of different types sort and compare by: the type first, then the value."""
    return F.struct(type_rank(kind).alias("rank"), value.alias("value"))


def byte_size(kind: Column, text: Column) -> Column:
    """Bytes of a single value: those of its text for strings and blobs, a fixed number for the others."""
    sizes = {"NULL": 0, "INT": 8, "FLOAT": 4, "DOUBLE": 8, "TIMESTAMP": 8, "DATE": 12}
    out = F.octet_length(text)
    for name, size in sizes.items():
        out = F.when(F.upper(kind) == name, F.lit(size)).otherwise(out)
    return out


def exact_fixed(value: Column, places: int = 15) -> Column:
    """A double with fixed places from its exact binary value, not from its shortest decimal form."""
    size, sign = F.abs(value), F.when(value < 0, "-").otherwise("")
    whole = F.floor(size)
    part = F.floor((size - whole) * F.lit(float(1 << 53))).cast("decimal(17,0)") * F.lit(10**places).cast(f"decimal({places + 1},0)")
    digits = F.floor((part + F.lit(1 << 52)) / F.lit(1 << 53).cast("decimal(17,0)")).cast("bigint")
    carried = digits >= 10**places
    shown = F.lpad(F.when(carried, digits - 10**places).otherwise(digits).cast("string"), places, "0")
    return F.concat(sign, (whole + F.when(carried, 1).otherwise(0)).cast("bigint").cast("string"), F.lit("."), shown)


def json_string(text: Column) -> Column:
    """A string in JSON, with the short escapes."""
    escapes = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
    escapes |= {chr(i): f"\\u{i:04x}" for i in range(32) if chr(i) not in escapes}
    body = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), escapes.items(), text)
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_value(kind: str, value: Column) -> Column:
    """{"type": ..., "value": ...} of a value of a type; items of collections are strings."""
    kind = kind.upper()
    item = lambda x: json_value("STRING", x)
    body = {
        "NULL": lambda: F.lit("null"),
        "INT": lambda: value.cast("string"),
        "FLOAT": lambda: fixed(value),
        "DOUBLE": lambda: exact_fixed(value),
        "STRING": lambda: json_string(value),
        "TIMESTAMP": lambda: F.date_format(value, "'\"'yyyy-MM-dd'T'HH:mm:ss'Z\"'"),
        "DATE": lambda: json_string(value.cast("string")),
        "LIST": lambda: F.concat(F.lit("["), F.array_join(F.transform(value, item), ","), F.lit("]")),
        "SET": lambda: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.array_distinct(value)), item), ","), F.lit("]")),
        "MAP": lambda: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat(json_string(e["key"]), F.lit(":"), item(e["value"]))), ","), F.lit("}")),
        "BLOB": lambda: json_string(F.base64(value)),
    }[kind]()
    return F.concat(F.lit(f'{{"type":"{kind}","value":'), body, F.lit("}"))


def json_parsed(text: Column) -> dict[str, Column]:
    """The type and, by type, the value of a typed JSON text; items of collections as strings."""
    outer = F.from_json(text, "type string, value string")
    kind, raw = F.upper(outer["type"]), outer["value"]
    items = F.transform(F.from_json(raw, "array<struct<type:string,value:string>>"), lambda x: x["value"])
    entries = F.transform_values(F.from_json(raw, "map<string,struct<type:string,value:string>>"), lambda _, x: x["value"])
    values = {
        "INT": raw.try_cast("double").cast("bigint"), "FLOAT": raw.try_cast("float"), "DOUBLE": raw.try_cast("double"), "STRING": raw,
        "TIMESTAMP": F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssX")), "DATE": parse_date(raw), "LIST": items, "SET": F.array_sort(F.array_distinct(items)), "MAP": entries, "BLOB": F.unbase64(raw),
    }
    return {"type": kind, **{name: F.when(kind == name, v) for name, v in values.items()}}


def _bytes_of(text: Column) -> Column:
    raw = text.cast("binary")
    return F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint"))


def hash31(text: Column) -> Column:
    """hash * 31 + signed byte, modulo 2**64, as a decimal; two halves of 32 bits are carried so that nothing overflows."""
    half = (1 << 32) - 1

    def step(acc, byte):
        low = acc["low"] * 31 + F.when(byte > 127, byte - 256).otherwise(byte)
        return F.struct(low.bitwiseAND(half).alias("low"), (acc["high"] * 31 + F.shiftright(low, 32)).bitwiseAND(half).alias("high"))

    start = F.struct(F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"))
    bytes_of = F.when(F.octet_length(text) > 0, _bytes_of(text)).otherwise(F.array().cast("array<bigint>"))
    wide = lambda c: c.cast("decimal(20,0)")
    return F.aggregate(bytes_of, start, step, lambda acc: (wide(acc["high"]) * F.lit(1 << 32).cast("decimal(11,0)") + wide(acc["low"])).cast("decimal(20,0)"))


def varint(value: Column) -> Column:
    """A number of 0 or more as hexadecimal bytes of seven bits, the least first; all but the last have their high bit set."""
    groups = F.array(*[F.shiftright(value, 7 * i) for i in range(9)])
    used = F.filter(groups, lambda x, i: (i == 0) | (x > 0))
    parts = F.transform(used, lambda x, i: F.lpad(F.lower(F.hex(x.bitwiseAND(127) + F.when(i < F.size(used) - 1, 128).otherwise(0))), 2, "0"))
    return F.array_join(parts, "")
