"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Each query runs once unmeasured (code is compiled, the index built) and RUNS times measured; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from polyscan import registry
from polyscan.filters import SimpleFilter
from polyscan.session import build_session
from polyscan.sources.rows_file import rows_file_scan

RUNS = 3
QUERIES = ("agg_basic", "scan_filter_project", "join_3way", "join_theta_interval", "join_asof", "window_rank", "agg_cube", "cte_chain", "topk_nulls_last", "src_parquet")


def log_file(n: int = 50_000) -> dict:
    """A log of n JSON lines in chunks of 1,000 rows, with zone maps and Bloom filters."""
    path = f"{tempfile.mkdtemp()}/log.jsonl"
    with open(path, "w") as f:
        for i in range(n):
            f.write(json.dumps({"id": i, "service": ("api", "web", "db", "job")[i % 4], "trace_id": f"trace-{i:08d}", "msg": f"request {i} done"}) + "\n")
    columns = [{"name": c, "path": f"$.{c}", "type": "int64" if c == "id" else "string"} for c in ("id", "service", "trace_id", "msg")]
    return {"path": path, "chunk_rows": 1000, "parser": {"format": "jsonl", "columns": columns}, "indexed_columns": [{"name": "id", "kind": "zone_map"}, {"name": "trace_id", "kind": "bloom"}, {"name": "service", "kind": "bloom"}]}


def scans(table: dict) -> dict[str, tuple[float, str]]:
    """Seconds and chunks of the indexed scans, without SQL."""
    f, out = SimpleFilter, {}
    cases = {"index_range_1pct": [f("id", ">=", 20_000), f("id", "<", 20_500)], "index_bloom_absent": [f("trace_id", "=", "trace-99999999")], "index_bloom_present": [f("trace_id", "=", "trace-00031337")], "index_in_list": [f("service", "in", ("api", "web", "db"))], "index_full_scan": []}
    for name, filters in cases.items():
        scan = rows_file_scan("log", {}, table).bound(filters)
        scan.skipping()
        times = []
        for _ in range(RUNS):
            began = time.perf_counter()
            for p in scan.partitions():
                for _ in scan.read(p):
                    pass
            times.append(time.perf_counter() - began)
        total, kept = scan.skipping()
        out[name] = (statistics.median(times), f"{kept}/{total}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))
    out = os.dup(1)
    os.dup2(2, 1)  # whatever Spark prints goes to stderr
    spark = build_session(f"local[{cpus}]", spark__driver__memory="12g", spark__sql__shuffle__partitions=cpus, spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir=tempfile.mkdtemp())
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in QUERIES:
        times = []
        for k in range(RUNS + 1):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    from polyscan.session import Engine

    table = log_file()
    engine = Engine.from_yaml(json.dumps({"version": 1, "sources": {"files": {"type": "rows_file", "tables": {"log": table}}}}), spark)
    for name, sql in {"sql_point_range": "SELECT count(*) AS n FROM files.log WHERE id BETWEEN 20000 AND 20100", "sql_bloom_absent": "SELECT count(*) AS n FROM files.log WHERE trace_id = 'none'"}.items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            engine.query(sql).collect()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    chunks = {}
    for name, (seconds, kept) in scans(table).items():
        took[name], chunks[name] = round(seconds, 5), kept
    spark.stop()
    line = {"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "chunks": chunks, "cpus": cpus}
    os.write(out, (json.dumps(line) + "\n").encode())
    sys.stdout.flush()


if __name__ == "__main__":
    main()
