"""Scalar functions whose meaning differs from Spark's of the same name. All but ``exp_c`` are native column expressions."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds of each interval unit.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def length_bytes(s: Column) -> Column:
    return F.octet_length(s)


def trim_all(s: Column) -> Column:
    """Trim white space of every kind, not only spaces."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def concat_skip(*parts: Column) -> Column:
    """Concatenate, leaving out nulls."""
    return F.concat_ws("", *parts)


def split_part(s: Column, delimiter: str, n: int) -> Column:
    """Part ``n`` from 1; the empty text for 0 and beyond the last."""
    return F.lit("") if n == 0 else F.split_part(s, F.lit(delimiter), F.lit(n))


def repeat_capped(s: Column, n: Column) -> Column:
    return F.repeat(s, F.least(n, F.lit(10_000)))


def initcap_words(s: Column) -> Column:
    """Capital initials, with white space runs made one space."""
    return F.initcap(F.regexp_replace(trim_all(s), r"\s+", " "))


def sqrt_safe(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def log_base10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


@F.arrow_udf(T.DoubleType())
def exp_c(x: pa.Array) -> pa.Array:
    """The exponential of the C library, bit for bit; infinite beyond the range."""

    def one(v: float | None) -> float | None:
        try:
            return None if v is None else math.exp(v)
        except OverflowError:
            return math.inf

    return pa.array([one(v) for v in x.to_pylist()], pa.float64())


def week_simple(ts: Column) -> Column:
    """Weeks counted from January 1, from 1."""
    return (F.floor((F.dayofyear(ts) - 1) / 7) + 1).cast("int")


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts).cast("long")


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(epoch(ts) + seconds)


def interval_seconds(text: str) -> int:
    """``5m``, ``1h``, ``250ms`` or plain seconds; a millisecond interval is a second at least."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|d|w)?\s*", text)
    if not m or not int(m[1]):
        raise ValueError(f"not an interval: {text!r}")
    if m[2] == "ms":
        return max(1, int(m[1]) // 1000)
    return int(m[1]) * UNITS[m[2] or "s"]


def json_type(j: Column) -> Column:
    """object, array, string, number, boolean or null; null for what is not JSON."""
    v = F.try_parse_json(j)
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None)).when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def json_get(j: Column, key: str | int) -> Column:
    """``j -> key``: the member as JSON text."""
    path = f"$[{key}]" if isinstance(key, int) else f"$.{key}"
    return F.to_json(F.variant_get(F.try_parse_json(j), path, "variant"))


def json_text(j: Column, key: str | int) -> Column:
    """``j ->> key``: the member as text."""
    return F.get_json_object(j, f"$[{key}]" if isinstance(key, int) else f"$.{key}")


def json_contains(j: Column, wanted: dict) -> Column:
    """``j @> wanted`` for a literal object: every member equal, nested objects in turn."""
    out = F.lit(True)

    def each(path: str, value: object) -> None:
        nonlocal out
        if isinstance(value, dict):
            for k, v in value.items():
                each(f"{path}.{k}", v)
        else:
            text = str(value).lower() if isinstance(value, bool) else str(value)
            out = out & F.coalesce(F.get_json_object(j, path) == text, F.lit(False))

    each("$", wanted)
    return out
