"""Line files as tables: chunks that the index can't rule out, read in parallel."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa

from polyscan.filters import SimpleFilter
from polyscan.sources import index as ix
from polyscan.sources.base import BATCH, Scan
from polyscan.sources.parsers import line_schema

#: Bytes of neighbouring chunks that one task reads.
TASK_BYTES = 32 << 20


@dataclass
class RowsFileScan(Scan):
    table: dict[str, Any] = field(default_factory=dict)

    kind = "rows_file"

    def files(self) -> list[str]:
        """The files as they are now, in order of name."""
        t = self.table
        if t.get("path"):
            return [t["path"]]
        return sorted(p for p in glob.glob(t["glob"], recursive=True) if os.path.isfile(p) and ix.SUFFIX not in os.path.basename(p))

    def kinds(self) -> dict[str, str]:
        return {c["name"]: c["type"] for c in self.table["parser"]["columns"]}

    def accepts(self, f: SimpleFilter) -> bool:
        return f.column in {i["name"] for i in self.table.get("indexed_columns") or []}

    def kept(self) -> Iterator[tuple[str, int, list[dict]]]:
        """Of each file the path, its number of chunks, and those to read."""
        for path in self.files():
            index, _ = ix.refresh(self.table, path)
            yield path, len(index.chunks), index.prune(self.filters, self.kinds())

    def prepare(self, spark) -> None:
        """Indexes new or changed files by the executors, which read them anyway, a task each. Planning finds their sidecars; one file alone is left to it."""
        table, late = self.table, [p for p in self.files() if ix.late(p)]
        if len(late) > 1:
            spark.sparkContext.parallelize(late, len(late)).foreach(lambda p: ix.refresh(table, p))

    def skipping(self) -> tuple[int, int]:
        """(chunks, chunks to read) under the filters given."""
        counts = [(n, len(chunks)) for _, n, chunks in self.kept()]
        return sum(n for n, _ in counts), sum(k for _, k in counts)

    def partitions(self) -> list[Any]:
        """Runs of neighbouring chunks of a file, their byte ranges as they are at planning."""
        out = []
        for path, _, chunks in self.kept():
            run: list[tuple[int, int]] = []
            for c in chunks:
                if run and c["start"] - run[0][0] >= TASK_BYTES:
                    out.append((path, run))
                    run = []
                run.append((c["start"], c["end"]))
            if run:
                out.append((path, run))
        return out or [None]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        path, ranges = part
        parser = ix.parser_for(self.table, path)
        with open(path, "rb") as f:
            for start, end in ranges:
                f.seek(start)
                b = parser.batch(f.read(end - start), start, self.schema)
                for at in range(0, b.num_rows, BATCH):
                    yield b.slice(at, BATCH)

    def whole(self) -> Iterator[pa.RecordBatch]:
        """Every row of every file in this process, without an index."""
        for path in self.files():
            parser = ix.parser_for(self.table, path)
            for data, start in ix.pieces(self.table, path, 0, os.path.getsize(path)):
                yield parser.batch(data, start, self.schema)

    def describe(self) -> list[str]:
        total, kept = self.skipping()
        return [*super().describe(), f"chunks: {kept} of {total}"]

    def stream_reader(self):
        from polyscan.streaming.tail import TailReader

        return TailReader(self)


def rows_file_scan(name: str, source: dict, table: dict) -> RowsFileScan:
    return RowsFileScan(name, line_schema(table["parser"]), table=table)
