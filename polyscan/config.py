"""The YAML configuration: version 1, sources by name, each with typed tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from polyscan import jsonpath
from polyscan.errors import ConfigError
from polyscan.types import CELLS, NAMES

KINDS = ("rest", "rows_file", "parquet", "excel", "graphql", "postgres", "ldap")
AUTH = {"none": (), "basic": ("username_env", "password_env"), "bearer": ("token_env",), "api_key": ("in", "name", "value_env"), "custom_header": ("name", "value_env")}
PAGES = {"page": ("page_param", "size_param"), "offset": ("offset_param", "limit_param"), "cursor": ("cursor_param", "cursor_path"), "link_header": ()}
SYSLOG_FIELDS = ("priority", "facility", "severity", "version", "timestamp", "hostname", "app_name", "proc_id", "msg_id", "structured_data", "message")
FILTER_OPS = ("=", "IN", ">", ">=", "<", "<=")


@dataclass
class Source:
    name: str
    kind: str
    settings: dict[str, Any]
    tables: dict[str, dict[str, Any]] = field(default_factory=dict)


@dataclass
class Config:
    sources: dict[str, Source]
    version: int = 1

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ConfigError(f"failed to parse config: {e}") from e
        return cls.from_dict(raw)

    @classmethod
    def from_path(cls, path: str | Path) -> Config:
        try:
            return cls.from_yaml(Path(path).read_text())
        except OSError as e:
            raise ConfigError(f"failed to read config file: {e}") from e

    @classmethod
    def from_dict(cls, raw: Any) -> Config:
        top = _mapping(raw, "the config")
        if top.get("version") != 1:
            raise ConfigError(f"invalid config: unsupported config version {top.get('version')}")
        sources = _mapping(top.get("sources") or {}, "`sources`")
        if not sources:
            raise ConfigError("invalid config: at least one source must be defined")
        return cls({str(n): _source(str(n), s) for n, s in sources.items()})

    def table_names(self) -> list[str]:
        return sorted(f"{s.name}.{t}" for s in self.sources.values() for t in s.tables)


def _need(ok: Any, message: str) -> None:
    if not ok:
        raise ConfigError(f"invalid config: {message}")


def _mapping(x: Any, what: str) -> dict:
    _need(isinstance(x, dict), f"{what} must be a mapping")
    return x


def _text(x: dict, key: str, what: str) -> str:
    v = x.get(key)
    _need(isinstance(v, (str, int)) and str(v).strip(), f"{what} must define a non-empty {key}")
    return str(v)


def _path(text: Any, what: str) -> str:
    try:
        jsonpath.parse(str(text))
    except (jsonpath.JsonPathError, ValueError) as e:
        raise ConfigError(f"invalid config: {what}: {e}") from e
    return str(text)


def _source(name: str, raw: Any) -> Source:
    _need(name.strip(), "source names must not be empty")
    s = dict(_mapping(raw, f"source `{name}`"))
    kind = s.pop("type", None)
    _need(kind in KINDS, f"source `{name}` has unknown type `{kind}`")
    tables = _mapping(s.pop("tables", None) or {}, f"tables of `{name}`")
    _need(tables, f"source `{name}` must define at least one table")
    for key in {"rest": ["base_url"], "graphql": ["endpoint"], "postgres": ["connection"], "ldap": ["url"]}.get(kind, []):
        _text(s, key, f"source `{name}`")
    if kind == "ldap":
        _need(str(s["url"]).startswith(("ldap://", "ldaps://")), f"source `{name}` url must start with ldap:// or ldaps://")
        auth = s.get("auth") or {"type": "anonymous"}
        _need(auth.get("type") in ("anonymous", "simple"), f"source `{name}` has unknown auth type")
        if auth["type"] == "simple":
            _need(str(auth.get("bind_dn") or "").strip() and str(auth.get("password_env") or "").strip(), f"source `{name}` simple auth requires non-empty bind_dn and password_env")
    elif s.get("auth"):
        auth = _mapping(s["auth"], f"auth of `{name}`")
        _need(auth.get("type") in AUTH, f"source `{name}` has unknown auth type `{auth.get('type')}`")
        for key in AUTH[auth["type"]]:
            _text(auth, key, f"auth of source `{name}`")
        if auth["type"] == "api_key":
            _need(auth["in"] in ("header", "query"), f"auth of source `{name}`: in is header or query")
    retry = (s.get("runtime") or {}).get("retry")
    if retry:
        _need(int(retry.get("max_attempts", 1)) >= 1, f"source `{name}`: max_attempts is at least 1")
    out = Source(name, kind, s)
    for table, t in tables.items():
        _need(str(table).strip(), f"source `{name}` contains an empty table name")
        t = dict(_mapping(t, f"table `{name}.{table}`"))
        globals()[f"_{kind}"](f"{name}.{table}", t)
        out.tables[str(table)] = t
    return out


def _columns(q: str, t: dict) -> None:
    columns = _mapping(t.get("columns") or {}, f"columns of `{q}`")
    _need(columns, f"table `{q}` must define at least one column")
    for c, d in columns.items():
        _need(str(c).strip(), f"table `{q}` contains an empty column name")
        d = _mapping(d, f"column `{q}.{c}`")
        _need(d.get("type") in NAMES, f"column `{q}.{c}` has unknown type `{d.get('type')}`")
        if not d.get("virtual"):
            _text(d, "path", f"column `{q}.{c}`")
            _path(d["path"], f"column `{q}.{c}` has invalid JSONPath")


def _rest(q: str, t: dict) -> None:
    e = _mapping(t.get("endpoint") or {}, f"endpoint of `{q}`")
    _need(str(e.get("method")).upper() == "GET", f"table `{q}`: the method must be GET")
    _need(str(e.get("path") or "").startswith("/"), f"table `{q}` endpoint path must start with `/`")
    _path(t.get("root", ""), f"table `{q}` has invalid root JSONPath")
    _columns(q, t)
    t.setdefault("raw_column", "_raw")
    _need(not (t.get("include_raw_json") and t["raw_column"] in t["columns"]), f"table `{q}`: raw column `{t['raw_column']}` is a column already")
    pages = t.get("pagination")
    if pages:
        _need(pages.get("type") in PAGES, f"table `{q}` has unknown pagination `{pages.get('type')}`")
        for key in PAGES[pages["type"]]:
            _text(pages, key, f"pagination of `{q}`")
        if pages["type"] == "cursor":
            _path(pages["cursor_path"], f"table `{q}` has invalid cursor JSONPath")
    push = t.get("pushdown") or {}
    for c, f in (push.get("filters") or {}).items():
        what = f"filter pushdown `{q}.{c}`"
        _need(c in t["columns"], f"{what} names an unknown column")
        _need(f.get("param") is None or str(f["param"]).strip(), f"{what} has an empty param")
        ops = f.get("operators")
        _need(isinstance(ops, (list, dict)) and ops, f"{what} must define at least one operator")
        _need(isinstance(ops, dict) or f.get("param"), f"{what} requires `param` when operators is a list")
        _need(all(str(o).upper() in FILTER_OPS for o in ops), f"{what} has an unknown operator")
    if push.get("limit") is not None:
        _text(push["limit"], "param", f"limit pushdown of `{q}`")
    if push.get("projection") is not None:
        _text(push["projection"], "param", f"projection pushdown of `{q}`")
        _need(push["projection"].get("style", "comma_separated") == "comma_separated", f"projection pushdown of `{q}`: the style is comma_separated")


def _graphql(q: str, t: dict) -> None:
    _text(t, "query", f"table `{q}`")
    _path(t.get("root", ""), f"table `{q}` has invalid root JSONPath")
    _columns(q, t)
    for c, v in ((t.get("pushdown") or {}).get("variables") or {}).items():
        _need(str(v).strip(), f"variable of `{q}.{c}` must not be empty")
        t["columns"].setdefault(c, {"type": "string", "virtual": True})  # a variable without a column of its own


def _parquet(q: str, t: dict) -> None:
    _text(t, "path", f"table `{q}`")


def _excel(q: str, t: dict) -> None:
    _text(t, "path", f"table `{q}`")
    t.setdefault("has_header", True)


def _postgres(q: str, t: dict) -> None:
    _text(t, "relation", f"table `{q}`")


def _ldap(q: str, t: dict) -> None:
    _text(t, "base_dn", f"table `{q}`")
    _need(t.get("scope", "sub") in ("base", "one", "sub"), f"table `{q}`: the scope is base, one or sub")
    attributes = _mapping(t.get("attributes") or {}, f"attributes of `{q}`")
    _need(attributes, f"table `{q}` must define at least one attribute")
    for c, a in attributes.items():
        _text(_mapping(a, f"attribute `{q}.{c}`"), "ldap", f"attribute `{q}.{c}`")
        a.setdefault("type", "string")
        _need(a["type"] in NAMES, f"attribute `{q}.{c}` has unknown type `{a['type']}`")
    for c, a in ((t.get("pushdown") or {}).get("attributes") or {}).items():
        _need(c in attributes, f"pushdown `{q}.{c}` names an unknown attribute")
        _need(re.fullmatch(r"[A-Za-z0-9.;_-]+", str(a)), f"pushdown `{q}.{c}`: `{a}` is no attribute name")


def _rows_file(q: str, t: dict) -> None:
    _need(t.get("path") or t.get("glob"), f"table `{q}` must define `path` or `glob`")
    _need(not (t.get("path") and t.get("glob")), f"table `{q}` cannot define both `path` and `glob`")
    _need(t.get("chunk_rows") is None or int(t["chunk_rows"]) >= 1, f"table `{q}`: chunk_rows is at least 1")
    p = _mapping(t.get("parser") or {}, f"parser of `{q}`")
    kind = p.get("format")
    _need(kind in ("jsonl", "csv", "logfmt", "regex", "syslog"), f"table `{q}` has unknown format `{kind}`")
    columns = p.get("columns") or []
    _need(isinstance(columns, list) and columns, f"parser of `{q}` must define at least one column")
    pattern = None
    if kind == "regex":
        try:
            pattern = re.compile(str(p.get("pattern", "")))
        except re.error as e:
            raise ConfigError(f"invalid config: table `{q}` has an invalid pattern: {e}") from e
    seen = set()
    for c in columns:
        name = _text(_mapping(c, f"column of `{q}`"), "name", f"column of `{q}`")
        _need(name not in seen, f"table `{q}` has two columns `{name}`")
        seen.add(name)
        what = f"column `{q}.{name}`"
        if kind == "syslog":
            _need(c.get("field") in SYSLOG_FIELDS, f"{what} has unknown field `{c.get('field')}`")
            number = c["field"] in ("priority", "facility", "severity", "version")
            c.setdefault("type", "int64" if number else "timestamp" if c["field"] == "timestamp" else "string")
        _need(c.get("type") in CELLS, f"{what} has unknown type `{c.get('type')}`")
        if kind == "jsonl":
            _path(c.get("path", ""), f"{what} has invalid JSONPath")
        elif kind == "csv":
            s = c.get("source")
            _need(isinstance(s, dict) and len(s) == 1 and ("name" in s or isinstance(s.get("index"), int) and s["index"] >= 0), f"{what}: source is a name or an index")
            _need("index" in s or p.get("has_header", True), f"{what} needs a header")
        elif kind == "logfmt":
            _text(c, "key", what)
        elif kind == "regex":
            _need(c.get("group") in pattern.groupindex, f"{what}: the pattern has no group `{c.get('group')}`")
    if kind == "csv":
        _need(len(str(p.get("delimiter") or ",")) == 1, f"table `{q}`: the delimiter is one character")
    for i in t.get("indexed_columns") or []:
        _need(i.get("name") in seen, f"table `{q}`: indexed column `{i.get('name')}` is no column")
        _need(i.get("kind") in ("zone_map", "bloom", "zone_map_and_bloom"), f"table `{q}`: unknown index kind `{i.get('kind')}`")
