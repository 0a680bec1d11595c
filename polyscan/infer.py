"""Configuration from samples: `detect` reads the head of a line file, `probe` makes one GET."""

from __future__ import annotations

import csv
import itertools
import json
import os
import re
from typing import Any
from urllib.parse import urlsplit

import yaml

from polyscan import types
from polyscan.sources.parsers import _PAIR, _SYSLOG

SAMPLE = 200
#: Where an API usually puts its rows; `$` is the answer itself.
ROOTS = ("data", "results", "items", "records", "rows", "value", "payload")


def text_type(values: list[str]) -> str:
    """The narrowest cell type of all non-empty values."""
    some = [v for v in values if v not in ("", None)]
    if not some:
        return "string"
    if all(types.integer(v) is not None for v in some):
        return "int64"
    if all(types.number(v) is not None for v in some):
        return "float64"
    return "timestamp" if all(types.timestamp(v) is not None for v in some) else "string"


def json_type(values: list) -> str:
    some = [v for v in values if v is not None]
    if some and all(isinstance(v, bool) for v in some):
        return "boolean"
    if some and all(isinstance(v, int) and not isinstance(v, bool) for v in some):
        return "int64"
    if some and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in some):
        return "float64"
    if some and all(isinstance(v, str) and types.timestamp(v) for v in some):
        return "timestamp"
    if some and all(isinstance(v, str) and types.day(v) for v in some):
        return "date"
    if some and any(isinstance(v, (dict, list)) for v in some):
        return "json"
    return "string"


def _indexes(columns: list[dict]) -> list[dict]:
    """Zone maps for what has an order, Bloom filters for identifiers."""
    out = []
    for c in columns:
        if c["type"] in ("int64", "float64", "timestamp"):
            out.append({"name": c["name"], "kind": "zone_map"})
        elif re.search(r"(^|_)id$", c["name"], re.I):
            out.append({"name": c["name"], "kind": "bloom"})
    return out


def _member(name: str) -> str:
    return f"$.{name}" if re.fullmatch(r"[A-Za-z_]\w*", name) else f"$['{name}']"


def detect(path: str, source: str = "files", table: str | None = None) -> dict[str, Any]:
    """A configuration for a line file, from its first lines."""
    with open(path, encoding="utf-8", errors="replace", newline="") as f:
        lines = [x.rstrip("\r\n") for x in itertools.islice(f, SAMPLE)]
    full = [x for x in lines if x.strip()]
    suffix = os.path.splitext(path)[1].lower()
    spec: dict[str, Any]
    if full and all(_is_object(x) for x in full):
        rows = [json.loads(x) for x in full]
        names = list(dict.fromkeys(k for r in rows for k in r))
        columns = []
        for n in names:
            kind = json_type([r.get(n) for r in rows])
            columns.append({"name": n, "path": _member(n), "type": kind if kind in types.CELLS else "string"})
        spec = {"format": "jsonl", "columns": columns}
    elif suffix in (".csv", ".tsv") or _delimiter(full):
        d = "\t" if suffix == ".tsv" else _delimiter(full) or ","
        rows = list(csv.reader(full, delimiter=d))
        header, body = (rows[0], rows[1:]) if rows else ([], [])
        columns = [{"name": n, "source": {"name": n}, "type": text_type([r[k] for r in body if k < len(r)])} for k, n in enumerate(header)]
        spec = {"format": "csv", "has_header": True, "columns": columns} | ({"delimiter": d} if d != "," else {})
    elif full and all(_SYSLOG.match(x) for x in full):
        fields = ("priority", "timestamp", "hostname", "app_name", "proc_id", "msg_id", "message")
        columns = [{"name": n, "field": n, "type": "int64" if n == "priority" else "timestamp" if n == "timestamp" else "string"} for n in fields]
        spec = {"format": "syslog", "columns": columns}
    elif full and all("=" in x and _PAIR.search(x) for x in full):
        found = [dict(_PAIR.findall(x)) for x in full]
        names = list(dict.fromkeys(k for r in found for k in r))
        columns = [{"name": n, "key": n, "type": text_type([r[n].strip('"') for r in found if n in r])} for n in names]
        spec = {"format": "logfmt", "columns": columns}
    else:
        spec = {"format": "regex", "pattern": "(?P<line>.*)", "columns": [{"name": "line", "group": "line", "type": "string"}]}
    name = table or re.sub(r"\W+", "_", os.path.splitext(os.path.basename(path))[0]).strip("_") or "table"
    body = {"path": path, "parser": spec}
    if found := _indexes(spec["columns"]):
        body["indexed_columns"] = found
    return {"version": 1, "sources": {source: {"type": "rows_file", "tables": {name: body}}}}


def _is_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def _delimiter(lines: list[str]) -> str | None:
    """The delimiter that all lines have equally often, if any."""
    for d in (",", "\t", ";", "|"):
        counts = {x.count(d) for x in lines[:20]}
        if len(counts) == 1 and counts != {0} and len(lines) > 1:
            return d
    return None


def probe(url: str, source: str = "api", table: str | None = None, auth: dict | None = None) -> dict[str, Any]:
    """A configuration for a JSON endpoint, from one answer."""
    from polyscan.sources.http import Client

    answer = Client(auth, {"timeout_ms": 30_000}).get(url)
    return describe(url, answer.json(), answer.headers, source, table, auth)


def describe(url: str, body: Any, headers: dict, source: str, table: str | None, auth: dict | None = None) -> dict[str, Any]:
    if isinstance(body, list):
        root, rows = "$[*]", body
    else:
        key = next((k for k in ROOTS if isinstance(body, dict) and isinstance(body.get(k), list)), None)
        root, rows = (f"$.{key}[*]", body[key]) if key else ("$", [body])
    objects = [r for r in rows if isinstance(r, dict)]
    names = list(dict.fromkeys(k for r in objects for k in r))
    columns = {re.sub(r"\W", "_", n): {"path": _member(n), "type": json_type([r.get(n) for r in objects])} for n in names} or {"value": {"path": "$", "type": "json"}}
    u = urlsplit(url)
    t: dict[str, Any] = {"endpoint": {"method": "GET", "path": u.path or "/"}, "root": root, "columns": columns}
    if 'rel="next"' in headers.get("link", ""):
        t["pagination"] = {"type": "link_header", "rel": "next"}
    name = table or re.sub(r"\W+", "_", (u.path.rstrip("/").rsplit("/", 1)[-1] or "table")).strip("_") or "table"
    s: dict[str, Any] = {"type": "rest", "base_url": f"{u.scheme}://{u.netloc}"} | ({"auth": auth} if auth else {})
    return {"version": 1, "sources": {source: s | {"tables": {name: t}}}}


def to_yaml(config: dict[str, Any]) -> str:
    return yaml.safe_dump(config, sort_keys=False, allow_unicode=True)
