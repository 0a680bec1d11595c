import json
import math
import os
import random
import threading

from polyscan.filters import SimpleFilter, matches
from polyscan.sources import index as ix
from polyscan.sources import rows_file

COLUMNS = [{"name": "id", "path": "$.id", "type": "int64"}, {"name": "level", "path": "$.level", "type": "string"}, {"name": "x", "path": "$.x", "type": "float64"}, {"name": "trace_id", "path": "$.trace_id", "type": "string"}, {"name": "ts", "path": "$.ts", "type": "timestamp"}]


def table(path, chunk=500, **change):
    return {"path": str(path), "chunk_rows": chunk, "parser": {"format": "jsonl", "columns": COLUMNS}, "indexed_columns": [{"name": "id", "kind": "zone_map"}, {"name": "x", "kind": "zone_map"}, {"name": "level", "kind": "zone_map_and_bloom"}, {"name": "trace_id", "kind": "bloom"}, {"name": "ts", "kind": "zone_map"}]} | change


def write(path, n, start=0, mode="w"):
    with open(path, mode) as f:
        for i in range(start, start + n):
            s = 1777852800 + i
            row = {"id": i, "level": ["ERROR", "WARN", "INFO", "INFO", "INFO"][i % 5], "x": i / 7 if i % 11 else None, "trace_id": f"trace-{i:08d}", "ts": f"2026-05-{4 + i // 86400:02d}T{i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z"}
            f.write(json.dumps(row) + "\n")
            del s


def skipping(t, *filters):
    return rows_file.rows_file_scan("t", {}, t).bound(filters).skipping()


def rows(t, *filters):
    scan = rows_file.rows_file_scan("t", {}, t).bound(filters)
    return [r for p in scan.partitions() for b in scan.read(p) for r in b.to_pylist()]


def test_zone_maps_and_blooms_skip(tmp_path):
    t = table(tmp_path / "a.jsonl")
    write(t["path"], 10_000)
    f = SimpleFilter
    assert skipping(t) == (20, 20)
    assert skipping(t, f("id", ">=", 5000), f("id", "<", 5100)) == (20, 1)
    assert skipping(t, f("id", "in", (1, 2, 9999))) == (20, 2)
    assert skipping(t, f("trace_id", "=", "trace-99999999"))[1] <= 2
    assert 1 <= skipping(t, f("trace_id", "=", "trace-00005042"))[1] <= 3
    assert 3 <= skipping(t, f("trace_id", "in", ("trace-00000100", "trace-00005000", "trace-00009999")))[1] <= 5
    import datetime as dt

    assert skipping(t, f("ts", ">=", dt.datetime(2026, 5, 4, 2, 40, tzinfo=dt.timezone.utc)))[1] == 1
    assert len([r for r in rows(t, f("id", ">=", 5000), f("id", "<", 5100)) if 5000 <= r["id"] < 5100]) == 100


def test_pruned_scans_agree_with_full_scans(tmp_path):
    t = table(tmp_path / "a.jsonl", 97)
    write(t["path"], 1500)
    everything, rng = rows(t), random.Random(3)
    for _ in range(150):
        column = rng.choice(["id", "x", "level", "trace_id"])
        value = {"id": rng.randrange(-5, 1600), "x": rng.uniform(-5, 230), "level": rng.choice(["ERROR", "WARN", "INFO", "A", "z"]), "trace_id": f"trace-{rng.randrange(1700):08d}"}
        op = rng.choice(["=", "!=", "<", "<=", ">", ">=", "in", "is_null", "is_not_null"])
        f = SimpleFilter(column, op, (value[column],) if op == "in" else value[column] if not op.startswith("is") else None)
        want = [r for r in everything if matches(f, r[column])]
        assert [r for r in rows(t, f) if matches(f, r[column])] == want, f


def test_decisions(tmp_path):
    t = table(tmp_path / "a.jsonl", 100)
    p = t["path"]
    write(p, 1000)
    did = lambda table=t, **k: ix.refresh(table, p, **k)
    assert did()[1] == "built" and did()[1] == "reused"
    write(p, 500, 1000, "a")
    index, how = did()
    assert how == "extended" and index.rows == 1500 and len(index.chunks) == 15
    assert len(rows(t)) == 1500 and did()[1] == "reused"
    assert did(rebuild=True)[1] == "rebuilt"
    with open(p, "r+") as f:  # an edit in place of equal size
        f.seek(7)
        f.write("9")
    assert did()[1] == "rebuilt"
    os.truncate(p, os.path.getsize(p) // 2)
    assert did()[1] == "rebuilt"
    os.rename(p, p + ".old")
    write(p, 300)
    assert did()[1] == "rebuilt"
    other = table(p, 100, indexed_columns=[{"name": "level", "kind": "bloom"}])
    assert did(other)[1] == "rebuilt" and did(table(p, 50))[1] == "rebuilt"
    assert ix.refresh(table(p, 50), p)[0].rows == 300


def test_partial_last_line_is_read_again_when_it_grows(tmp_path):
    t = table(tmp_path / "a.csv", 10, parser={"format": "csv", "columns": [{"name": "id", "source": {"name": "id"}, "type": "int64"}, {"name": "s", "source": {"name": "s"}, "type": "string"}]}, indexed_columns=[{"name": "id", "kind": "zone_map"}])
    with open(t["path"], "w") as f:
        f.write("id,s\n" + "".join(f'{i},"a\nb {i}"\n' for i in range(25)) + "2")
    assert [r["id"] for r in rows(t)] == [*range(25), 2]
    with open(t["path"], "a") as f:
        f.write("5,x\n")
    got = rows(t)
    assert [r["id"] for r in got] == list(range(26)) and got[3]["s"] == "a\nb 3"


def test_nan_is_above_every_number():
    s = ix.column_stats([1.0, math.nan], "float64", "zone_map")
    assert ix.may_match(s, SimpleFilter("x", ">", 5.0), "float64") and not ix.may_match(s, SimpleFilter("x", "<", 0.0), "float64")
    nothing = ix.column_stats([None, None], "int64", "zone_map")
    assert not ix.may_match(nothing, SimpleFilter("x", "!=", 5), "int64") and ix.may_match(nothing, SimpleFilter("x", "is_null"), "int64")


def test_bloom_false_positives():
    b = ix.Bloom.sized(1000)
    for i in range(1000):
        b.add(f"k{i}".encode())
    assert all(b.may_hold(f"k{i}".encode()) for i in range(1000))
    assert sum(b.may_hold(f"no{i}".encode()) for i in range(10_000)) <= 500


def test_glob_and_concurrent_writer(tmp_path):
    for i in range(3):
        with open(tmp_path / f"{i}.jsonl", "w") as f:
            f.writelines(json.dumps({"id": i * 1000 + j}) + "\n" for j in range(100))
    t = table("", 30, glob=str(tmp_path / "*.jsonl"))
    t.pop("path")
    scan = rows_file.rows_file_scan("t", {}, t)
    assert len(scan.files()) == 3 and len(rows(t)) == 300
    parts = scan.partitions()
    w = threading.Thread(target=lambda: write(tmp_path / "1.jsonl", 1000, 0, "a"))
    w.start()
    got = [r for p in parts for b in scan.read(p) for r in b.to_pylist()]
    w.join()
    assert len(got) == 300  # byte ranges are those of planning
    assert len(rows(t)) == 1300
