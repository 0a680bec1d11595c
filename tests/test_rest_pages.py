"""The pages of the REST queries' customers, asked for without a server or a port."""

import json
from types import SimpleNamespace
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from polyscan.filters import SimpleFilter
from polyscan.plans import sourced, stubs
from polyscan.sources import rest

KINDS = ("page", "offset", "cursor", "link")
BOTH = SimpleFilter("c_mktsegment", "in", ("BUILDING", "MACHINERY"))


def scan_of(monkeypatch, sf_dir, kind, asked):
    """The queries' scan, whose client asks the answer function itself."""
    answers = []
    monkeypatch.setattr(stubs, "serve_http", lambda answer: answers.append(answer) or ("http://none", [], None))

    class Client:
        def __init__(self, auth, runtime):
            pass

        def get(self, url):
            u = urlsplit(url)
            params = {k: v[-1] for k, v in parse_qs(u.query).items()}
            asked.append(params)
            _, headers, value = answers[-1]("GET", u.path, params, None, {})
            return SimpleNamespace(url=url, headers={k.lower(): v for k, v in headers.items()}, json=lambda: json.loads(json.dumps(value)))

    monkeypatch.setattr(rest, "Client", Client)
    source = sourced.customers_source(sf_dir, kind)
    return rest.rest_scan("crm.customers", source, source["tables"]["customers"])


@pytest.mark.parametrize("kind", KINDS)
def test_every_row_of_several_row_groups(monkeypatch, tmp_path, kind):
    table = pq.read_table("/root/testdata/sf0.1/customer.parquet")
    pq.write_table(table, f"{tmp_path}/customer.parquet", row_group_size=997)
    monkeypatch.setattr(sourced, "rows_of", lambda *a: pytest.fail("all rows in the driver"))
    for filters in ((), (BOTH,)):
        asked = []
        scan = scan_of(monkeypatch, tmp_path, kind, asked).bound(filters)
        got = pa.Table.from_batches(scan.read(None)).to_pylist()
        want = [r for r in table.to_pylist() if not filters or r["c_mktsegment"] in BOTH.value]
        assert sorted(got, key=lambda r: r["c_custkey"]) == want
        assert len(asked) <= -(-len(want) // 400) + 1 and all(("c_mktsegment" in a) == bool(filters) for a in asked)


def test_a_filter_is_evaluated_once_a_row_group(monkeypatch, tmp_path):
    pq.write_table(pq.read_table("/root/testdata/sf0.1/customer.parquet"), f"{tmp_path}/customer.parquet", row_group_size=5000)
    calls, plain = [], stubs.ParquetRows._pass
    monkeypatch.setattr(stubs.ParquetRows, "_pass", staticmethod(lambda *a: calls.append(1) or plain(*a)))
    asked = []
    list(scan_of(monkeypatch, tmp_path, "link", asked).bound([BOTH]).read(None))
    assert len(asked) == 15 and len(calls) == 2 * 3  # counted, and read


def test_pages_follow_the_rows():
    """At 60 times sf0.1 there are 2,250 pages of 400, more than a source's default lets pass."""
    assert sourced.page_limit(15_000) == 1000 and sourced.page_limit(900_000) >= 2251 and sourced.page_limit(901_001) >= 2254


def test_more_pages_than_the_default(monkeypatch):
    monkeypatch.setattr(sourced, "CUSTOMER_PAGE", 10)
    asked = []
    batches = list(scan_of(monkeypatch, "/root/testdata/sf0.1", "page", asked).read(None))
    assert sum(b.num_rows for b in batches) == 15_000 and len(asked) == 1501


def test_filters_on_numbers_and_empty_tables(tmp_path):
    t = pa.table({"k": [1, 2, None, 2], "s": ["a", "b", "b", None]})
    pq.write_table(t, f"{tmp_path}/t.parquet", row_group_size=2)
    pq.write_table(t.slice(0, 0), f"{tmp_path}/none.parquet")
    for rows in (t.to_pylist(), stubs.ParquetRows(f"{tmp_path}/t.parquet")):
        ask = lambda **p: stubs.paged(rows, 1)("GET", "/cursor", p, None, {})[2]  # noqa: B023, E731
        assert ask(k="2") == {"data": [{"k": 2, "s": "b"}], "next": "1"} and ask(k="2", cursor="1") == {"data": [{"k": 2, "s": None}], "next": None}
        assert ask(s="b", cursor="1")["data"] == [{"k": None, "s": "b"}] and ask(k="9")["data"] == []
    assert stubs.paged(stubs.ParquetRows(f"{tmp_path}/none.parquet"))("GET", "/page", {}, None, {})[2]["data"] == []
