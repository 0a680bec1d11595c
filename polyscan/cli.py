"""Command line: python -m polyscan validate | inspect | explain | query | detect | index | probe | init | attach."""

from __future__ import annotations

import argparse
import sys

from polyscan import infer
from polyscan.config import Config
from polyscan.errors import PolyscanError
from polyscan.types import spark_type


def grid(columns: list[str], rows: list[tuple]) -> str:
    """Rows as a bordered table."""
    cells = [list(map(str, columns)), *[["NULL" if v is None else str(v) for v in r] for r in rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {c.ljust(w)} " for c, w in zip(r, widths)) + "|"
    return "\n".join([rule, line(cells[0]), rule, *map(line, cells[1:]), rule])


def inspect_text(config: Config) -> str:
    out = []
    for s in config.sources.values():
        for name, t in s.tables.items():
            out.append(f"{s.name}.{name} ({s.kind})")
            columns = t.get("columns") or t.get("attributes") or {c["name"]: c for c in (t.get("parser") or {}).get("columns", ())}
            out += [f"  {c}: {d['type']} ({spark_type(d['type']).simpleString()})" for c, d in columns.items()]
    return "\n".join(out)


def attach_script(config: Config, schema: str) -> str:
    """The SQL that gives every table a view in a schema; the engine's attach() runs the like."""
    out = [f"CREATE SCHEMA IF NOT EXISTS `{schema}`;"]
    out += [f"CREATE OR REPLACE VIEW `{schema}`.`{n.replace('.', '_')}` AS SELECT * FROM {'.'.join(f'`{p}`' for p in n.split('.'))};" for n in config.table_names()]
    return "\n".join(out)


def init(ask=input) -> str:
    """Asks for a kind and a place, and infers the rest."""
    kind = ask("Source kind (file, rest, parquet, excel): ").strip().lower()
    where = ask("Path or URL: ").strip()
    source = ask("Source name: ").strip() or "main"
    table = ask("Table name (empty: from the path): ").strip() or None
    if kind == "rest":
        return infer.to_yaml(infer.probe(where, source, table))
    if kind in ("parquet", "excel"):
        return infer.to_yaml({"version": 1, "sources": {source: {"type": kind, "tables": {table or "data": {"path": where}}}}})
    return infer.to_yaml(infer.detect(where, source, table))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="polyscan")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("validate", "inspect"):
        sub.add_parser(name).add_argument("config")
    for name in ("explain", "query"):
        q = sub.add_parser(name)
        q.add_argument("config")
        q.add_argument("sql", help="a statement, or @file")
    d = sub.add_parser("detect")
    d.add_argument("path")
    r = sub.add_parser("probe")
    r.add_argument("url")
    r.add_argument("--bearer-env")
    for x in (d, r):
        x.add_argument("--source")
        x.add_argument("--table")
    i = sub.add_parser("index")
    i.add_argument("config")
    i.add_argument("table")
    i.add_argument("--rebuild", action="store_true")
    sub.add_parser("init").add_argument("--output")
    a = sub.add_parser("attach")
    a.add_argument("config")
    a.add_argument("--schema", default="attached")
    return p


def run(args: argparse.Namespace) -> str:
    from polyscan.session import Engine

    c = args.command
    if c == "detect":
        return infer.to_yaml(infer.detect(args.path, args.source or "files", args.table))
    if c == "probe":
        auth = {"type": "bearer", "token_env": args.bearer_env} if args.bearer_env else None
        return infer.to_yaml(infer.probe(args.url, args.source or "api", args.table, auth))
    if c == "init":
        text = init()
        if args.output:
            with open(args.output, "w") as f:
                f.write(text)
        return text
    config = Config.from_path(args.config)
    if c == "validate":
        return f"ok: {len(config.sources)} sources, {len(config.table_names())} tables"
    if c == "inspect":
        return inspect_text(config)
    if c == "attach":
        return attach_script(config, args.schema)
    engine = Engine(config)
    if c == "index":
        return "\n".join(f"{r['file']}: {r['decision']}, {r['chunks']} chunks, {r['rows']} rows" for r in engine.index(args.table, args.rebuild))
    sql = args.sql
    if sql.startswith("@"):
        with open(sql[1:]) as f:
            sql = f.read()
    if c == "explain":
        return engine.explain(sql)
    df = engine.query(sql)
    return grid(df.columns, [tuple(r) for r in df.collect()])


def main(argv: list[str] | None = None) -> int:
    try:
        print(run(parser().parse_args(argv)))
    except (PolyscanError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
