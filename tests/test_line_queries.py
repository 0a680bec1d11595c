"""Queries that write line files: by the executors, without the rows in the driver, in several files, with odd values."""

import datetime as dt
import json

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from polyscan import registry
from polyscan.plans import sourced
from polyscan.sources import index, rows_file


def value(v):
    return repr(round(v, 6)) if isinstance(v, float) else v.isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.fixture
def small_files(monkeypatch):
    """Files of 300 lines; the rows may not come to the driver."""
    monkeypatch.setattr(sourced, "FILE_ROWS", 300)
    monkeypatch.setattr(sourced, "rows_of", lambda sf_dir, name, *a: pytest.fail(f"the rows of {name} in the driver"))


def check(spark, sf_dir, name):
    """Holds a query's rows against its SQL."""
    df, con = registry.QUERIES[name](spark, sf_dir), duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS FROM read_parquet('{sf_dir}/events.parquet')")
    r = con.execute(registry.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(tuple(map(value, x)) for x in df.select(names).collect()) == sorted(tuple(map(value, x)) for x in r.fetchall())


def odd_events(folder, kinds, n=1000):
    """n events, the kinds in turn, with whole numbers, large and small values, nulls among them, and times with and without a fraction."""
    at, values = dt.datetime(2024, 2, 28, 23, 59, 58), [1.0, 12345678.5, -2.5e-7, None, 0.1]
    rows = [{"event_id": 7 * i, "ts": at + dt.timedelta(seconds=i, microseconds=100 * (i % 3)), "user_id": i % 11, "event_type": kinds[i % len(kinds)], "value": values[i % 5], "props": "{}"} for i in range(n)]
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    pq.write_table(pa.Table.from_pylist(rows, schema), f"{folder}/events.parquet")
    return str(folder)


ODD = {"jsonl": ['a"b', "c\\d", "e, f", "}", "ü\u2028", "line\nend", "", None], "csv": ['a"b', "c\\d", "e, f", " g ", "ü\u2028", "line\nend", "\"", None], "logfmt": ['a"b', "c\\d", "e= f", "\\\"", "ü", "", None], "regex": ['a"b', "c\\d", "e, f", "[g", "ü", ""]}


@pytest.mark.parametrize("fmt", sorted(ODD))
def test_formats(spark, sf_dir, tmp_path, small_files, fmt):
    check(spark, sf_dir, f"src_{fmt}")
    check(spark, odd_events(tmp_path, ODD[fmt]), f"src_{fmt}")


def test_syslog(spark, sf_dir, tmp_path, small_files):
    check(spark, sf_dir, "src_syslog")
    check(spark, odd_events(tmp_path, ['a"b', "c\\d", "[e]", "<f>", "ü", None]), "src_syslog")


def test_glob_pruned(spark, sf_dir, tmp_path, small_files, monkeypatch):
    """Files in order of time, so that most are skipped whole."""
    made = []
    monkeypatch.setattr(sourced, "write_lines", lambda *a, write=sourced.write_lines: made.append(write(*a)) or made[-1])
    check(spark, sf_dir, "src_glob_pruned")
    table = {"glob": made[0], "parser": {"format": "jsonl", "columns": [{"name": "ts", "path": "$.ts", "type": "timestamp"}]}, "indexed_columns": [{"name": "ts", "kind": "zone_map"}]}
    ranges = [c["stats"]["ts"]["range"] for p in rows_file.rows_file_scan("t", {}, table).files() for c in index.refresh(table, p)[0].chunks]
    assert len(ranges) >= 5 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    check(spark, odd_events(tmp_path, ['a"b', "c\\d", "ü", None]), "src_glob_pruned")


def test_stream_tail(spark, sf_dir, tmp_path, small_files):
    check(spark, sf_dir, "stream_tail")
    check(spark, odd_events(tmp_path, ODD["jsonl"]), "stream_tail")


def test_udtf_rows_file(spark, sf_dir, tmp_path, small_files):
    """The files are read once, without an index."""
    check(spark, sf_dir, "udtf_rows_file")
    check(spark, odd_events(tmp_path, ODD["jsonl"]), "udtf_rows_file")
    table = sourced.events_table(sf_dir, "jsonl", spark)
    config = json.dumps({"parser": table["parser"]})
    got = spark.sql(f"SELECT event_id, ts, user_id, event_type, value FROM rows_file_table('{table['glob']}', config => '{config}')")
    want = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "value")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    scan = rows_file.rows_file_scan("t", {}, table)
    assert all(map(index.late, scan.files()))


def test_executors_index_several_files(spark, sf_dir, small_files):
    table = sourced.events_table(sf_dir, "jsonl", spark)
    scan = rows_file.rows_file_scan("t", {}, table)
    assert len(scan.files()) >= 3 and all(map(index.late, scan.files()))
    scan.prepare(spark)
    assert [index.refresh(table, p)[1] for p in scan.files()] == ["reused"] * len(scan.files())
    with open(scan.files()[0], "a") as f:
        f.write('{"event_id": 1}\n')
    assert index.late(scan.files()[0])
    scan.prepare(spark)
    assert index.refresh(table, scan.files()[0])[1] == "extended"
