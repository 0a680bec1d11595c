"""Predicates that sources can take: one column, one operator, literals."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass
from typing import Any

OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "in", "is_null", "is_not_null")


@dataclass(frozen=True)
class SimpleFilter:
    column: str
    op: str
    value: Any = None

    def __str__(self) -> str:
        if self.op in ("is_null", "is_not_null"):
            return f"{self.column} {self.op.replace('_', ' ')}"
        if self.op == "in":
            return f"{self.column} in ({', '.join(map(plain, self.value))})"
        return f"{self.column} {self.op} {plain(self.value)}"


def plain(value) -> str:
    """A literal as text for a URL or a message."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dt.datetime):
        at = value.astimezone(dt.timezone.utc) if value.tzinfo else value
        return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{at.microsecond:06d}" if at.microsecond else "") + "Z"
    return str(value)


def sql_literal(value) -> str:
    """A literal as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, decimal.Decimal)):
        return repr(value) if isinstance(value, float) else str(value)
    text = plain(value)
    quoted = "'" + text.replace("'", "''") + "'"
    return f"TIMESTAMPTZ {quoted}" if isinstance(value, dt.datetime) else f"DATE {quoted}" if isinstance(value, dt.date) else quoted


def from_spark(f) -> SimpleFilter | None:
    """A pushed filter of Spark as a SimpleFilter; None if it is of another kind."""
    from pyspark.sql import datasource as D

    kinds = {D.EqualTo: "=", D.LessThan: "<", D.LessThanOrEqual: "<=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">="}
    if type(f) in kinds and len(f.attribute) == 1:
        return SimpleFilter(f.attribute[0], kinds[type(f)], f.value)
    if isinstance(f, D.In) and len(f.attribute) == 1:
        return SimpleFilter(f.attribute[0], "in", tuple(f.value))
    if isinstance(f, D.IsNull) and len(f.attribute) == 1:
        return SimpleFilter(f.attribute[0], "is_null")
    if isinstance(f, D.IsNotNull) and len(f.attribute) == 1:
        return SimpleFilter(f.attribute[0], "is_not_null")
    if isinstance(f, D.Not) and isinstance(f.child, D.EqualTo) and len(f.child.attribute) == 1:
        return SimpleFilter(f.child.attribute[0], "!=", f.child.value)
    return None


def matches(f: SimpleFilter, value) -> bool:
    """SQL's answer for a row: unknown counts as no."""
    if f.op == "is_null":
        return value is None
    if value is None:
        return False
    if f.op == "is_not_null":
        return True
    if f.op == "in":
        return value in f.value
    if f.value is None:
        return False
    return {"=": value == f.value, "!=": value != f.value, "<": value < f.value, "<=": value <= f.value, ">": value > f.value, ">=": value >= f.value}[f.op]
