"""Tables from user code: an object with schema() and scan(request), or a function of rows."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from polyscan.errors import SourceError
from polyscan.filters import SimpleFilter
from polyscan.sources.base import BATCH, Scan, wire_schema


def to_spark(schema: pa.Schema | T.StructType) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


@dataclass
class ProviderScan(Scan):
    """provider: schema() -> Arrow schema; scan(request) -> Arrow batches or tables; optionally capabilities() ->
    {"projection", "limit": bool, "filters": {column: [operators]}}.

    A request is {"projection": columns or None, "filters": [{"column", "operator", "value"}], "limit": n or None}.
    A provider may answer more than was asked; the rest is done above the scan.
    """

    provider: Any = None

    kind = "programmatic"

    def capabilities(self) -> dict[str, Any]:
        found = getattr(self.provider, "capabilities", None)
        return {"projection": False, "limit": False, "filters": {}} | ((found() if callable(found) else found) or {})

    def accepts(self, f: SimpleFilter) -> bool:
        ops = (self.capabilities().get("filters") or {}).get(f.column, ())
        return (f.op.upper() if f.op == "in" else f.op) in ops

    def request(self) -> dict[str, Any]:
        c = self.capabilities()
        return {
            "projection": [n for n in self.schema.names if n in self.wanted()] if c["projection"] and self.hints.columns is not None else None,
            "filters": [{"column": f.column, "operator": f.op.upper() if f.op == "in" else f.op, "value": list(f.value) if f.op == "in" else f.value} for f in self.filters],
            "limit": self.hints.limit if c["limit"] else None,
        }

    def read(self, part) -> Iterator[pa.RecordBatch]:
        target = wire_schema(self.schema)
        for x in self.provider.scan(self.request()):
            for b in x.to_batches() if isinstance(x, pa.Table) else [x]:
                missing = [f for f in target if f.name not in b.schema.names]
                if missing and self.hints.columns is None:
                    raise SourceError(f"{self.name}: the provider left out {', '.join(f.name for f in missing)}")
                columns = [b.column(b.schema.get_field_index(f.name)).cast(f.type) if f.name in b.schema.names else pa.nulls(b.num_rows, f.type) for f in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    def describe(self) -> list[str]:
        c = self.capabilities()
        filters = ", ".join(f"{k}:{'|'.join(v)}" for k, v in sorted((c["filters"] or {}).items()))
        return [
            f"capabilities: projection={str(bool(c['projection'])).lower()}, limit={str(bool(c['limit'])).lower()}, filters=[{filters}]",
            f"accepted projection: {', '.join(self.request()['projection']) if self.request()['projection'] else 'none'}",
            f"accepted filters: {', '.join(map(str, self.filters)) or 'none'}",
            f"query limit: {self.hints.limit if self.hints.limit is not None else 'none'}",
            f"accepted limit: {self.request()['limit'] if self.request()['limit'] is not None else 'none'}",
        ]


def provider_scan(name: str, provider: Any) -> ProviderScan:
    return ProviderScan(name, to_spark(provider.schema()), provider=provider)


class StaticProvider:
    """Fixed batches of one schema."""

    def __init__(self, batches: Iterable[pa.RecordBatch], schema: pa.Schema | None = None):
        self.batches = list(batches)
        self._schema = schema or self.batches[0].schema

    def schema(self) -> pa.Schema:
        return self._schema

    def scan(self, request: dict) -> Iterable[pa.RecordBatch]:
        return iter(self.batches)


class RowProvider:
    """A function that yields rows as dicts or tuples, gathered to batches; an async generator is driven to its end."""

    def __init__(self, fn: Callable[..., Iterable], schema: T.StructType | pa.Schema, batch_size: int = BATCH):
        self.fn, self.batch_size = fn, batch_size
        self._schema = to_spark(schema)

    def schema(self) -> T.StructType:
        return self._schema

    def scan(self, request: dict) -> Iterator[pa.RecordBatch]:
        target = wire_schema(self._schema)
        rows = self.fn()
        if hasattr(rows, "__anext__"):
            rows = _drive(rows)
        rows = iter(rows)
        while held := list(itertools.islice(rows, self.batch_size)):
            held = [r if isinstance(r, dict) else dict(zip(target.names, r)) for r in held]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in target.names} for r in held], target)


def _drive(agen) -> Iterator:
    import asyncio

    loop = asyncio.new_event_loop()
    try:
        while True:
            try:
                yield loop.run_until_complete(agen.__anext__())
            except StopAsyncIteration:
                return
    finally:
        loop.run_until_complete(agen.aclose())
        loop.close()
