"""Table functions for SQL: rest_table(url, config => yaml) and rows_file_table(path, config => yaml).

Their columns come from the configuration, read when a query is analysed. A REST call without one gives the rows of
`$.data[*]` as JSON text in `value`.
"""

from __future__ import annotations

from urllib.parse import urlsplit

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from polyscan.config import Config
from polyscan.errors import ConfigError


def rest_scan_of(url: str, config: str | None):
    """The scan of a URL; config: the YAML of one table, optionally with auth and runtime beside its keys."""
    from polyscan.sources.rest import rest_scan

    u = urlsplit(url)
    spec = yaml.safe_load(config) if config else {"root": "$.data[*]", "columns": {"value": {"path": "$", "type": "json"}}}
    if not isinstance(spec, dict):
        raise ConfigError("config must be a mapping")
    source = {"type": "rest", "base_url": f"{u.scheme}://{u.netloc}", **{k: spec.pop(k) for k in ("auth", "runtime") if k in spec}}
    spec.setdefault("root", "$.data[*]")
    spec["endpoint"] = {"method": "GET", "path": (u.path or "/") + (f"?{u.query}" if u.query else "")}
    table = Config.from_dict({"version": 1, "sources": {"url": source | {"tables": {"t": spec}}}}).sources["url"]
    return rest_scan(url, table.settings, table.tables["t"])


def rows_file_scan_of(path: str, config: str):
    from polyscan.sources.rows_file import rows_file_scan

    spec = yaml.safe_load(config or "")
    if not isinstance(spec, dict):
        raise ConfigError("rows_file_table needs a config")
    spec = {**spec, "glob" if any(c in path for c in "*?[") else "path": path}
    table = Config.from_dict({"version": 1, "sources": {"files": {"type": "rows_file", "tables": {"t": spec}}}}).sources["files"]
    return rows_file_scan(path, {}, table.tables["t"])


def _value(a: AnalyzeArgument | None):
    if a is None:
        return None
    if not a.isConstantExpression:
        raise ConfigError("arguments must be constants")
    return a.value


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


class RestTable:
    @staticmethod
    def analyze(url: AnalyzeArgument, config: AnalyzeArgument = None) -> AnalyzeResult:
        return AnalyzeResult(T.StructType(rest_scan_of(_value(url), _value(config)).schema.fields))

    def eval(self, url: str, config: str = None):
        yield from _rows(rest_scan_of(url, config).read(None))


class RowsFileTable:
    """Files are read whole, without an index, as nothing is ruled out.

    Spark holds all rows of one call in a worker's memory; the path may be a column, so that many files take a call each (LATERAL).
    """

    @staticmethod
    def analyze(path: AnalyzeArgument, config: AnalyzeArgument) -> AnalyzeResult:
        at = path.value if path.isConstantExpression else "of each row"
        return AnalyzeResult(T.StructType(rows_file_scan_of(at, _value(config)).schema.fields))

    def eval(self, path: str, config: str):
        yield from _rows(rows_file_scan_of(path, config).whole())


def register(spark: SparkSession) -> None:
    """Makes rest_table and rows_file_table known to SQL; `epoch` is seconds since 1970 as a double."""
    spark.udtf.register("rest_table", udtf(RestTable))
    spark.udtf.register("rows_file_table", udtf(RowsFileTable))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION epoch(ts TIMESTAMP) RETURNS DOUBLE RETURN unix_micros(ts) / 1e6")


