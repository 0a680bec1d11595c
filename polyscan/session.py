"""The engine: configured sources and providers as tables `source.table` of a Spark session."""

from __future__ import annotations

import asyncio
import io
import os
import re
import threading
from collections.abc import Callable
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from polyscan.config import Config
from polyscan.errors import UnknownTable
from polyscan.plans import inspect
from polyscan.sources.base import Hints, Scan, source_class
from polyscan.sources.excel import excel_scan
from polyscan.sources.graphql import graphql_scan
from polyscan.sources.ldap import ldap_scan
from polyscan.sources.postgres import postgres_scan
from polyscan.sources.programmatic import RowProvider, StaticProvider, provider_scan
from polyscan.sources.rest import rest_scan
from polyscan.sources.rows_file import rows_file_scan

SCANS = {"rest": rest_scan, "rows_file": rows_file_scan, "excel": excel_scan, "graphql": graphql_scan, "postgres": postgres_scan, "ldap": ldap_scan}
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
}


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the engine counts on."""
    b = SparkSession.builder.master(master).appName("polyscan").config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8)).config("spark.ui.enabled", "false")
    for k, v in {**CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


class Engine:
    """Tables are bound when a query names them, and only those; each query is planned once with what it asks for."""

    def __init__(self, config: Config | None = None, spark: SparkSession | None = None):
        self.config, self._spark = config, spark
        self._providers: dict[str, Any] = {}
        self._scans: dict[str, Scan] = {}
        self._parquet: set[str] = set()
        self._names: dict[str, str] = {}
        self._lock, self._count = threading.RLock(), 0

    @classmethod
    def from_yaml(cls, text: str, spark: SparkSession | None = None) -> Engine:
        return cls(Config.from_yaml(text), spark)

    @classmethod
    def from_path(cls, path: str | Path, spark: SparkSession | None = None) -> Engine:
        return cls(Config.from_path(path), spark)

    @classmethod
    def empty(cls, spark: SparkSession | None = None) -> Engine:
        return cls(None, spark)

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.getActiveSession() or build_session()
        for k in ("spark.sql.session.timeZone", "spark.sql.ansi.doubleQuotedIdentifiers", "spark.sql.python.filterPushdown.enabled"):
            if self._spark.conf.get(k, None) != CONF[k]:
                self._spark.conf.set(k, CONF[k])
        return self._spark

    # --- tables

    def register_provider(self, name: str, provider: Any) -> None:
        """A programmatic table `name` (source.table, or one name alone)."""
        self._providers[name] = provider
        self._scans.pop(name, None)

    def register_batches(self, name: str, batches: list[pa.RecordBatch], schema: pa.Schema | None = None) -> None:
        self.register_provider(name, StaticProvider(batches, schema))

    def table(self, name: str, schema, batch_size: int = 8192) -> Callable:
        """Decorator: a generator (or async generator) function of rows becomes the table `name`."""

        def keep(fn):
            self.register_provider(name, RowProvider(fn, schema, batch_size))
            return fn

        return keep

    def registered_tables(self) -> list[str]:
        return sorted({*(self.config.table_names() if self.config else ()), *self._providers})

    def scan(self, name: str) -> Scan:
        """The scan of a table, made at its first use. Parquet tables are Spark's own and have none."""
        if name not in self._scans:
            if name in self._providers:
                self._scans[name] = provider_scan(name, self._providers[name])
            else:
                source, table = self._configured(name)
                if source.kind == "parquet":
                    raise UnknownTable(f"{name} is read by Spark itself")
                self._scans[name] = SCANS[source.kind](name, source.settings, table)
        return self._scans[name]

    def _configured(self, name: str):
        source, _, table = name.partition(".")
        found = self.config.sources.get(source) if self.config else None
        if found is None or table not in found.tables:
            raise UnknownTable(f"unknown table {name}")
        return found, found.tables[table]

    def _create(self, name: str, scan: Scan) -> None:
        """CREATE TABLE name over a data source class of its own."""
        parts = name.split(".")
        if len(parts) > 2:
            raise UnknownTable(f"{name}: names have one or two parts; a third needs a catalog plugin")
        self._count += 1
        cls = "src_" + re.sub(r"\W", "_", name) + f"_{id(self) % 10**8}_{self._count}"
        quoted = ".".join(f"`{p}`" for p in parts)
        self._share_secrets(scan)
        self.spark.dataSource.register(source_class(cls, scan))
        if len(parts) == 2:
            self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{parts[0]}`")
        self.spark.sql(f"DROP TABLE IF EXISTS {quoted}")
        self.spark.sql(f"CREATE TABLE {quoted} USING {cls}")
        self._names[cls] = name
        self._names[f"{'default.' if len(parts) == 1 else ''}{name}"] = name

    def _share_secrets(self, scan: Scan) -> None:
        """Gives Python workers the environment variables that a source's authentication names. Options and plans never hold their values."""
        auth = (getattr(scan, "source", None) or {}).get("auth") or {}
        for key, name in auth.items():
            if key.endswith("_env") and name in os.environ:
                self.spark.sparkContext.environment[name] = os.environ[name]

    def bind(self, name: str) -> None:
        """Makes a table known to Spark."""
        if name not in self._providers:
            source, table = self._configured(name)
            if source.kind == "parquet":
                s, t = name.split(".", 1)
                self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{s}`")
                if name not in self._parquet:
                    self.spark.sql(f"DROP TABLE IF EXISTS `{s}`.`{t}`")
                    self._create_parquet(s, t, table["path"])
                    self._parquet.add(name)
                return
        self._create(name, self.scan(name))

    def _create_parquet(self, schema: str, table: str, path: str) -> None:
        if not re.search(r"[*?\[]", path):
            self.spark.sql(f"CREATE TABLE `{schema}`.`{table}` USING parquet LOCATION '{_quoted(os.path.abspath(path) if '://' not in path and not path.startswith('/') else path)}'")
            return
        # a table's location is a folder: a glob becomes a view over Spark's reader
        view = f"{schema}__{table}"
        self.spark.read.parquet(path).createOrReplaceTempView(view)
        frame = self.spark.table(view)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
        files = frame.inputFiles()
        folder, names = os.path.dirname(files[0]), {os.path.basename(f) for f in files}
        if len({os.path.dirname(f) for f in files}) == 1:
            pattern = "{" + ",".join(sorted(names)) + "}"
            self.spark.sql(f"CREATE TABLE `{schema}`.`{table}` ({columns}) USING parquet OPTIONS (path '{_quoted(folder)}', pathGlobFilter '{_quoted(pattern)}')")
        else:
            self.spark.sql(f"CREATE TABLE `{schema}`.`{table}` ({columns}) USING parquet OPTIONS (path '{_quoted(path)}')")

    def referenced(self, sql: str) -> list[str]:
        """The tables of ours that a statement names, subqueries included."""
        known = set(self.registered_tables())
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        found: set[str] = set()

        def walk_plan(p):
            if p.getClass().getSimpleName() == "UnresolvedRelation":
                ids = p.multipartIdentifier()
                name = ".".join(ids.apply(i) for i in range(ids.length()))
                if name in known:
                    found.add(name)
                elif ids.length() > 2 and ".".join(name.split(".")[-2:]) in known:
                    raise UnknownTable(f"{name}: names have one or two parts; a third needs a catalog plugin")
            for c in [*inspect._seq(p.children()), *(x for x in inspect._seq(p.innerChildren()) if inspect.is_plan(x))]:
                walk_plan(c)
            for e in inspect._seq(p.expressions()):
                for sub in inspect.subplans(e):
                    walk_plan(sub)

        walk_plan(plan)
        # a name inside a subquery that the walk can't reach is found by its text: binding a table too many does no harm
        return sorted(found | {n for n in known if re.search(rf"(?<![\w.`]){re.escape(n)}(?![\w`])", sql)})

    # --- queries

    def query(self, sql: str) -> DataFrame:
        """A lazy DataFrame; the scans know the columns, limit and OR filters that this statement needs."""
        with self._lock:
            tables = self.referenced(sql)
            for t in tables:
                self.bind(t)
                if t in self._scans:
                    self._scans[t].prepare(self.spark)
            df = self.spark.sql(sql)
            ours = [t for t in tables if t not in self._parquet]
            found = self._hints(df) if ours else {}
            if not any(self._gains(t, h) for t, h in found.items()):
                return df
            for t, h in found.items():
                self._create(t, self.scan(t).bound((), h))
            df = self.spark.sql(sql)
            for t in found:
                self._create(t, self.scan(t))
            return df

    def _hints(self, df: DataFrame) -> dict[str, Hints]:
        """For a table that a statement scans more than once only the columns are of use, those of all its scans."""
        by: dict[str, list[Hints]] = {}
        for u in inspect.uses(df, self._names):
            by.setdefault(u.table, []).append(inspect.hints(u))
        return {t: h[0] if len(h) == 1 else Hints(tuple(sorted({c for x in h for c in x.columns}))) for t, h in by.items()}

    def _gains(self, table: str, h: Hints) -> bool:
        scan = self.scan(table)
        return h.limit is not None or any(scan.accepts(f) for f in h.filters) or set(h.columns) != set(scan.schema.names)

    def query_arrow(self, sql: str) -> list[pa.RecordBatch]:
        return self.query(sql).toArrow().to_batches()

    async def query_async(self, sql: str) -> list[pa.RecordBatch]:
        return await asyncio.to_thread(self.query_arrow, sql)

    def query_ipc(self, sql: str) -> bytes:
        """The result as an Arrow IPC stream, for hosts of other languages."""
        table, sink = self.query(sql).toArrow(), io.BytesIO()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        return sink.getvalue()

    def explain(self, sql: str) -> str:
        """The statement, the optimised plan, what each table is asked for, and the conditions left to Spark."""
        df = self.query(sql)
        lines = [f"SQL: {sql}", "", "Optimized logical plan:"]
        lines += [f"  {x}" for x in df._jdf.queryExecution().optimizedPlan().toString().rstrip().split("\n")]
        lines += ["", "Tables:"]
        residual: list[str] = []
        with self._lock:
            tables = self.referenced(sql)
            for t in tables:
                self.bind(t)
            plain = self.spark.sql(sql)
            for u in inspect.uses(plain, self._names):
                scan = self.scan(u.table)
                # Conditions that a scan takes exactly have left the plan; the others are still there
                taken = [f for f in map(inspect.simple, u.conditions) if f is not None]
                taken += [f for f in _exact_filters(plain, u.table) if f not in taken]
                bound = scan.bound([f for f in taken if f.op != "is_not_null" or scan.exact(f)], inspect.hints(u))
                bound.filters = tuple(dict.fromkeys(bound.filters))
                lines += [f"- {u.table}", f"  provider: {scan.kind}", *(f"  {x}" for x in bound.describe())]
                residual += [e.toString() for e in u.conditions]
        for t in tables:
            if t in self._parquet:
                lines += [f"- {t}", "  provider: parquet", "  pushdown: by Spark"]
        lines += ["", "Residual local filters:", *([f"  - {r}" for r in dict.fromkeys(residual)] or ["  none"])]
        return "\n".join(lines)

    def attach(self, schema: str | None = None) -> list[str]:
        """Makes all tables known to Spark; with a schema also a view source_table in it for each. Their names."""
        names = self.registered_tables()
        for n in names:
            self.bind(n)
        if schema:
            self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
            for n in names:
                self.spark.sql(f"CREATE OR REPLACE VIEW `{schema}`.`{n.replace('.', '_')}` AS SELECT * FROM {'.'.join(f'`{p}`' for p in n.split('.'))}")
        return names

    def index(self, name: str, rebuild: bool = False) -> list[dict[str, Any]]:
        """Brings the sidecars of a line-file table up to date: per file what was done, chunks and rows."""
        from polyscan.sources.index import refresh

        scan = self.scan(name)
        if scan.kind != "rows_file":
            raise UnknownTable(f"{name} is no rows_file table")
        out = []
        for path in scan.files():
            index, did = refresh(scan.table, path, rebuild)
            out.append({"file": path, "decision": did, "chunks": len(index.chunks), "rows": index.rows})
        return out


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def _exact_filters(df: DataFrame, table: str):
    """Filters that left the plan for the scan: Spark's analysed plan still has them."""
    out = []

    def walk(node):
        if node.getClass().getSimpleName() == "Filter":
            for e in inspect.conjuncts(node.condition()):
                f = inspect.simple(e)
                if f is not None:
                    out.append(f)
        for c in inspect._seq(node.children()):
            walk(c)

    walk(df._jdf.queryExecution().analyzed())
    return out

