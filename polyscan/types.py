"""Declared column types, and strict conversion of JSON values and text cells to them."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import re

import pyarrow as pa
from pyspark.sql import types as T

NAMES = ("boolean", "int64", "float64", "decimal", "string", "date", "timestamp", "json", "list", "struct")
CELLS = ("int64", "float64", "string", "timestamp")

_SPARK = {
    "boolean": T.BooleanType(),
    "int64": T.LongType(),
    "float64": T.DoubleType(),
    "decimal": T.DecimalType(38, 10),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "json": T.StringType(),
    "list": T.ArrayType(T.StringType()),
    "struct": T.MapType(T.StringType(), T.StringType()),
}
_ARROW = {
    "boolean": pa.bool_(),
    "int64": pa.int64(),
    "float64": pa.float64(),
    "decimal": pa.decimal128(38, 10),
    "string": pa.string(),
    "date": pa.date32(),
    "timestamp": pa.timestamp("us", "UTC"),
    "json": pa.string(),
    "list": pa.list_(pa.string()),
    "struct": pa.map_(pa.string(), pa.string()),
}
_INT = re.compile(r"[+-]?\d+\Z")
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\Z|[+-]?(?:inf|infinity|nan)\Z", re.I)
_STAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)\Z")
_DAY = re.compile(r"(\d{4})-(\d\d)-(\d\d)\Z")
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def spark_type(name: str) -> T.DataType:
    return _SPARK[name]


def arrow_type(name: str) -> pa.DataType:
    return _ARROW[name]


def arrow_of(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.timestamp("us", "UTC") if isinstance(kind, T.TimestampType) else to_arrow_type(kind)


def compact(value) -> str:
    """JSON text without blanks."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def timestamp(text: str) -> dt.datetime | None:
    """RFC 3339 with Z or an offset, to UTC; digits beyond microseconds are cut. None if it isn't one."""
    m = _STAMP.match(text)
    if not m:
        return None
    y, mo, d, h, mi, s = map(int, m.groups()[:6])
    try:
        at = dt.datetime(y, mo, d, h, mi, min(s, 59), int((m[7] or "0")[:6].ljust(6, "0")), dt.timezone.utc)
    except ValueError:
        return None
    at += dt.timedelta(seconds=max(0, s - 59)) if s == 60 else dt.timedelta()
    if m[8] not in "Zz":
        sign = -1 if m[8][0] == "-" else 1
        at -= sign * dt.timedelta(hours=int(m[8][1:3]), minutes=int(m[8][4:6]))
    return at if s <= 60 else None


def day(text: str) -> dt.date | None:
    m = _DAY.match(text)
    try:
        return dt.date(*map(int, m.groups())) if m else None
    except ValueError:
        return None


def integer(text: str) -> int | None:
    if not _INT.match(text) or not text.isascii():
        return None
    n = int(text)
    return n if -(2**63) <= n < 2**63 else None


def number(text: str) -> float | None:
    return float(text) if _FLOAT.match(text) else None


def from_json(value, kind: str):
    """A JSON value as the declared type, without coercion: what is not of the type is NULL."""
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else compact(value)
    if kind == "boolean":
        return value if isinstance(value, bool) else None
    if kind == "int64":
        return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None
    if kind == "float64":
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if kind == "decimal":
        if isinstance(value, bool) or not isinstance(value, (int, float, str)):
            return None
        try:
            d = decimal.Decimal(str(value))
            return d.quantize(decimal.Decimal(1).scaleb(-10), context=decimal.Context(prec=48)) if d.is_finite() and abs(d) < 10**28 else None
        except decimal.InvalidOperation:
            return None
    if kind == "date":
        return day(value) if isinstance(value, str) else None
    if kind == "timestamp":
        return timestamp(value) if isinstance(value, str) else None
    if kind == "json":
        return compact(value)
    text = lambda x: None if x is None else x if isinstance(x, str) else compact(x)
    if kind == "list":
        return [text(x) for x in value] if isinstance(value, list) else None
    return [(k, text(v)) for k, v in value.items()] if isinstance(value, dict) else None


def from_text(cell: str | None, kind: str):
    """A text cell as the declared type; NULL where it does not parse."""
    if cell is None:
        return None
    if kind == "int64":
        return integer(cell)
    if kind == "float64":
        return number(cell)
    if kind == "timestamp":
        return timestamp(cell)
    if kind == "boolean":
        low = cell.strip().lower()
        return True if low in ("true", "1", "yes", "y") else False if low in ("false", "0", "no", "n") else None
    if kind == "date":
        return day(cell)
    if kind == "decimal":
        return from_json(cell, "decimal")
    return cell


def batch(rows: dict[str, list], schema: T.StructType) -> pa.RecordBatch:
    """Columns of Python values as an Arrow batch of the Spark schema."""
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], arrow_of(f.dataType)) for f in schema.fields], [f.name for f in schema.fields])
