"""GraphQL tables: one POST, variables from equality filters, JSONPath rows and columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa

from polyscan import jsonpath
from polyscan.errors import SourceError
from polyscan.filters import SimpleFilter, plain
from polyscan.sources.base import BATCH, Scan
from polyscan.sources.http import Client
from polyscan.sources.rest import json_batch, row_schema


@dataclass
class GraphqlScan(Scan):
    source: dict[str, Any] = field(default_factory=dict)
    table: dict[str, Any] = field(default_factory=dict)

    kind = "graphql"

    def mapped(self) -> dict[str, str]:
        return (self.table.get("pushdown") or {}).get("variables") or {}

    def accepts(self, f: SimpleFilter) -> bool:
        return f.op == "=" and f.value is not None and f.column in self.mapped()

    def limits(self) -> bool:
        return True

    def variables(self) -> dict[str, Any]:
        out = {}
        for f in self.filters:
            value = f.value if isinstance(f.value, (bool, int, float, str)) else plain(f.value)
            out.setdefault(self.mapped()[f.column], value)
        return out

    def body(self) -> dict[str, Any]:
        return {"query": self.table["query"], "variables": self.variables()}

    def read(self, part) -> Iterator[pa.RecordBatch]:
        answer = Client(self.source.get("auth"), self.source.get("runtime")).post(self.source["endpoint"], self.body()).json()
        if isinstance(answer, dict) and answer.get("errors"):
            raise SourceError(f"{self.name}: {answer['errors'][0].get('message', 'error') if isinstance(answer['errors'][0], dict) else answer['errors'][0]}")
        nodes = jsonpath.find(self.table["root"], answer)
        # A column that only carries a variable has the value that was asked for, so the filter above the scan holds
        virtual = {f.column: f.value for f in self.filters}
        for at in range(0, len(nodes), BATCH):
            yield json_batch(nodes[at : at + BATCH], self.schema, self.table["columns"], self.wanted(), None, virtual)

    def describe(self) -> list[str]:
        return [*super().describe(), f"variables: {', '.join(f'{k}={plain(v) if not isinstance(v, dt.date) else v}' for k, v in sorted(self.variables().items())) or 'none'}"]


def graphql_scan(name: str, source: dict, table: dict) -> GraphqlScan:
    return GraphqlScan(name, row_schema(table), source=source, table=table)
