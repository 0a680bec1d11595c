"""REST tables: paged GETs, JSONPath rows and columns, filters, limit and projection as query parameters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from polyscan import jsonpath, types
from polyscan.errors import DecodeError, PageLimitReached
from polyscan.filters import SimpleFilter, plain
from polyscan.sources.base import BATCH, Scan
from polyscan.sources.http import Client, join, next_link, with_params

PAGE_SIZE, MAX_PAGES = 1000, 1000


@dataclass
class RequestPlan:
    """What a scan asks the server: path and sorted parameters, and what stays to be done here."""

    path: str
    params: dict[str, str]
    pushed: list[SimpleFilter]
    residual: list[SimpleFilter]
    limit: int | None = None

    def render(self) -> str:
        """The request line as people read it, not encoded."""
        query = "&".join(f"{k}={v}" for k, v in sorted(self.params.items()))
        return f"GET {self.path}" + (f"?{query}" if query else "")


def row_schema(table: dict[str, Any]) -> T.StructType:
    """Columns in order of name, the raw one last; all nullable."""
    fields = [T.StructField(n, types.spark_type(table["columns"][n]["type"])) for n in sorted(table["columns"])]
    if table.get("include_raw_json"):
        fields.append(T.StructField(table.get("raw_column", "_raw"), T.StringType()))
    return T.StructType(fields)


def param_for(table: dict[str, Any], f: SimpleFilter) -> str | None:
    """The query parameter that takes f, if the table declares one for its column and operator."""
    spec = ((table.get("pushdown") or {}).get("filters") or {}).get(f.column)
    op = f.op.upper() if f.op == "in" else f.op
    if spec is None:
        return None
    ops = spec["operators"]
    return ops.get(op) if isinstance(ops, dict) else spec.get("param") if op in ops else None


def plan_request(table: dict[str, Any], filters, columns=None, limit: int | None = None) -> RequestPlan:
    """Of two filters for one parameter the first is sent; a list with commas in a value isn't sent at all.

    A capped limit is sent only where pages bring the rest.
    """
    push, params = table.get("pushdown") or {}, {}
    pushed, residual = [], []
    for f in filters:
        param = param_for(table, f)
        values = [plain(v) for v in (f.value if f.op == "in" else [f.value])]
        if param is None or param in params or None in (f.value if f.op == "in" else [f.value]) or (f.op == "in" and (not values or any("," in v for v in values))):
            residual.append(f)
            continue
        params[param] = ",".join(values)
        pushed.append(f)
    sent = None
    if push.get("limit") and limit is not None:
        most = push["limit"].get("max")
        if most is None or limit <= most or table.get("pagination"):
            sent = limit if most is None else min(limit, int(most))
            params[push["limit"]["param"]] = str(sent)
    if push.get("projection") and columns is not None and columns and not table.get("include_raw_json"):
        params[push["projection"]["param"]] = ",".join(sorted(columns))
    return RequestPlan(table["endpoint"]["path"], params, pushed, residual, sent)


def pages(client: Client, base: str, plan: RequestPlan, pagination: dict | None, root: str, limit: int | None, max_pages: int) -> Iterator[list]:
    """Lists of row nodes, page by page, until the server has no more or the limit is reached."""
    url, params, kind = join(base, plan.path), dict(plan.params), (pagination or {}).get("type")
    rows = at = 0
    size = None
    if kind in ("page", "offset"):
        name = pagination["size_param" if kind == "page" else "limit_param"]
        size = int(params.get(name, min(limit, PAGE_SIZE) if limit else PAGE_SIZE))
        params[name] = str(size)
    number = int(pagination.get("start_page") or 1) if kind == "page" else 0
    target: str | None = url
    for _ in range(max_pages):
        if kind == "page":
            target = with_params(url, params | {pagination["page_param"]: str(number)})
        elif kind == "offset":
            target = with_params(url, params | {pagination["offset_param"]: str(at)})
        elif target == url:
            target = with_params(url, params)
        answer = client.get(target)
        body = answer.json()
        found = jsonpath.find(root, body)
        yield found
        rows += len(found)
        if kind is None or (limit is not None and rows >= limit):
            return
        if kind in ("page", "offset"):
            # A page below the size asked for may be a server's own smaller cap, so only an empty one ends the paging
            if not found:
                return
            number, at = number + 1, at + len(found)
        elif kind == "cursor":
            cursor = jsonpath.first(pagination["cursor_path"], body)
            if cursor is None or cursor == "":
                return
            if not isinstance(cursor, str):
                raise DecodeError(f"the cursor from {plan.path} is no string")
            target = with_params(url, params | {pagination["cursor_param"]: cursor})
        else:
            target = next_link(answer.headers.get("link"), pagination.get("rel") or "next", answer.url)
            if target is None:
                return
    raise PageLimitReached(f"{plan.path} has more than {max_pages} pages")


def json_batch(nodes: list, schema: T.StructType, columns: dict[str, dict], wanted: set[str], raw: str | None = None, virtual: dict | None = None) -> pa.RecordBatch:
    out = {}
    for f in schema.fields:
        spec = columns.get(f.name)
        if raw is not None and f.name == raw:
            out[f.name] = [types.compact(n) for n in nodes] if f.name in wanted else [None] * len(nodes)
        elif spec.get("virtual"):
            out[f.name] = [(virtual or {}).get(f.name)] * len(nodes)
        elif f.name not in wanted:
            out[f.name] = [None] * len(nodes)
        else:
            out[f.name] = [types.from_json(jsonpath.first(spec["path"], n), spec["type"]) for n in nodes]
    return types.batch(out, schema)


@dataclass
class RestScan(Scan):
    source: dict[str, Any] = field(default_factory=dict)
    table: dict[str, Any] = field(default_factory=dict)

    kind = "rest"

    def accepts(self, f: SimpleFilter) -> bool:
        return param_for(self.table, f) is not None

    def exact(self, f: SimpleFilter) -> bool:
        """Only where the configuration says so: a server may not know a parameter and answer with every row."""
        return bool(self.table.get("trust_remote")) and f in plan_request(self.table, [f]).pushed

    def plan(self) -> RequestPlan:
        columns = None if self.hints.columns is None else [c for c in self.wanted() if c in self.table["columns"]]
        return plan_request(self.table, self.filters, columns, self.hints.limit)

    def read(self, part) -> Iterator[pa.RecordBatch]:
        runtime = self.source.get("runtime") or {}
        client = Client(self.source.get("auth"), runtime)
        raw = self.table.get("raw_column", "_raw") if self.table.get("include_raw_json") else None
        for nodes in pages(client, self.source["base_url"], self.plan(), self.table.get("pagination"), self.table["root"], self.hints.limit, int(runtime.get("max_pages") or MAX_PAGES)):
            for at in range(0, len(nodes), BATCH):
                yield json_batch(nodes[at : at + BATCH], self.schema, self.table["columns"], self.wanted(), raw)

    def describe(self) -> list[str]:
        return [*super().describe(), f"http plan: {self.plan().render()}"]


def rest_scan(name: str, source: dict, table: dict) -> RestScan:
    return RestScan(name, row_schema(table), source=source, table=table)
