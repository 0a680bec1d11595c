"""A scan is what a connector offers to Spark: a schema, a way to take filters, partitions, and Arrow batches.

`source_class` turns a scan into a Python data source of its own name. Filters that a scan takes exactly leave the
Spark plan; all others stay there as residual filters, so a remote side that answers too much costs time only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from polyscan.filters import SimpleFilter, from_spark

#: Rows of a batch.
BATCH = 8192


@dataclass(frozen=True)
class Hints:
    """What planning found out beyond filters: the columns anyone reads, a row limit, and filters from ORs."""

    columns: tuple[str, ...] | None = None
    limit: int | None = None
    filters: tuple[SimpleFilter, ...] = ()


class Part(InputPartition):
    """A partition with any picklable content."""

    def __init__(self, value: Any = None):
        super().__init__(value)


@dataclass
class Scan:
    """Base of the connectors' scans. `filters` holds those pushed, `hints` what planning added."""

    name: str
    schema: StructType
    hints: Hints = field(default_factory=Hints)
    filters: tuple[SimpleFilter, ...] = ()

    kind = "scan"

    def accepts(self, f: SimpleFilter) -> bool:
        """Whether the remote side can make use of f."""
        return False

    def exact(self, f: SimpleFilter) -> bool:
        """Whether rows that fail f never come out, so that no residual filter is needed."""
        return False

    def limits(self) -> bool:
        """Whether a row limit is of use."""
        return True

    def bound(self, filters, hints: Hints | None = None) -> Scan:
        """A copy with the filters it accepts."""
        hints = self.hints if hints is None else hints
        return replace(self, filters=tuple(f for f in [*filters, *hints.filters] if self.accepts(f)), hints=hints)

    def wanted(self) -> set[str]:
        """The columns whose values matter; others may be NULL."""
        return set(self.schema.names) if self.hints.columns is None else set(self.hints.columns) | {f.column for f in self.filters}

    def prepare(self, spark) -> None:
        """What executors do ahead of planning."""

    def partitions(self) -> list[Any]:
        return [None]

    def read(self, part: Any) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def describe(self) -> list[str]:
        """Lines of an EXPLAIN block below the provider's name."""
        out = [f"projection: {', '.join(self.hints.columns) if self.hints.columns is not None else '*'}"]
        out.append(f"pushed filters: {', '.join(map(str, self.filters)) or 'none'}")
        out.append(f"pushed limit: {self.hints.limit if self.hints.limit is not None and self.limits() else 'none'}")
        return out


class ScanReader(DataSourceReader):
    def __init__(self, scan: Scan):
        self.scan = scan

    def pushFilters(self, filters):
        taken = []
        for f in filters:
            s = from_spark(f)
            if s is not None and self.scan.accepts(s):
                taken.append(s)
                if self.scan.exact(s):
                    continue
            yield f
        self.scan = self.scan.bound(taken)

    def partitions(self):
        return [Part(p) for p in self.scan.partitions()]

    def read(self, partition):
        left = self.scan.hints.limit if self.scan.limits() else None
        batches = self.scan.read(partition.value)
        try:
            for b in batches:
                if left is not None:
                    b = b.slice(0, left)
                    left -= b.num_rows
                if b.num_rows:
                    yield b
                if left == 0:
                    return
        finally:
            close = getattr(batches, "close", None)
            if close:
                close()


def source_class(name: str, scan: Scan) -> type[DataSource]:
    """A data source class of this name over the scan."""

    class Bound(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return scan.schema

        def reader(self, schema):
            return ScanReader(scan.bound(()))

        def streamReader(self, schema):
            make = getattr(scan, "stream_reader", None)
            if make is None:
                raise NotImplementedError(f"{scan.name} is not a stream")
            return make()

    Bound.__name__ = Bound.__qualname__ = name
    return Bound


def wire_schema(schema: StructType) -> pa.Schema:
    from polyscan.types import arrow_of

    return pa.schema([(f.name, arrow_of(f.dataType)) for f in schema.fields])
