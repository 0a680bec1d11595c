"""The line-file queries and fn_cast_case read every row; chunks are skipped by a range relative to the table."""

import datetime as dt

import duckdb
import pyarrow.parquet as pq
import pytest

from polyscan import registry
from polyscan.filters import SimpleFilter
from polyscan.plans import sourced
from polyscan.sources.rows_file import rows_file_scan

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("fmt", ["jsonl", "csv", "logfmt", "regex"])
def test_line_files_whole(spark, fmt):
    rows = pq.read_table(f"{SF_DIR}/events.parquet").to_pylist()
    got = {r.event_type: (r.n, r.first_id, r.total) for r in registry.QUERIES[f"src_{fmt}"](spark, SF_DIR).collect()}
    for kind in {r["event_type"] for r in rows}:
        own = [r for r in rows if r["event_type"] == kind]
        assert got[kind][:2] == (len(own), min(r["event_id"] for r in own))
        assert got[kind][2] == pytest.approx(sum(r["value"] for r in own), abs=0.02)
    assert sum(n for n, _, _ in got.values()) == len(rows)


def test_federated_and_casts_whole(spark):
    con = duckdb.connect()
    for t in ("customer", "events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    got = registry.QUERIES["federated_3way"](spark, SF_DIR).collect()
    n, total = con.execute("SELECT count(DISTINCT c_custkey), sum(value) FROM customer JOIN events ON user_id = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders)").fetchone()
    assert sum(r.n for r in got) == n and sum(r.total for r in got) == pytest.approx(total, abs=0.01 * n)
    assert registry.QUERIES["fn_cast_case"](spark, SF_DIR).count() == pq.read_metadata(f"{SF_DIR}/lineitem.parquet").num_rows


def test_a_range_of_the_table_skips_chunks():
    rows = pq.read_table(f"{SF_DIR}/events.parquet").to_pylist()
    scan = rows_file_scan("t", {}, sourced.events_table(SF_DIR, "jsonl"))
    last = max(r["event_id"] for r in rows)
    total, kept = scan.bound([SimpleFilter("event_id", ">", last - len(rows) // 20)]).skipping()
    assert total == -(-len(rows) // 1000) and kept < total
    assert scan.bound([SimpleFilter("ts", ">", max(r["ts"] for r in rows).replace(tzinfo=dt.timezone.utc))]).skipping()[1] <= 1
