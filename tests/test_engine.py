import asyncio
import json
import threading
import time

import pyarrow as pa
import pytest
import yaml

from polyscan import cli, infer
from polyscan.errors import ConfigError, DecodeError, HttpStatusError, PageLimitReached, RateLimited, RequestTimeout, SourceError, UnknownTable, UnsupportedSource
from polyscan.filters import SimpleFilter
from polyscan.plans import stubs
from polyscan.session import Engine
from polyscan.sources import excel, rest
from polyscan.sources.http import Client, HttpCache, credentials, join, next_link

PEOPLE = [{"id": 1, "name": "Mario", "status": "active", "tags": ["alpha", "beta"]}, {"id": 2, "name": "Anna", "status": "active", "tags": []}, {"id": 3, "name": "Luca", "status": None}, {"id": 4, "name": "Giulia", "status": "active"}]


def people(**change):
    return {"endpoint": {"method": "GET", "path": "/all"}, "root": "$.data[*]", "columns": {"id": {"path": "$.id", "type": "int64"}, "name": {"path": "$.name", "type": "string"}, "status": {"path": "$.status", "type": "string"}, "first_tag": {"path": "$.tags[0]", "type": "string"}}, "pushdown": {"filters": {"status": {"param": "status", "operators": ["=", "IN"]}}, "limit": {"param": "limit", "max": 100}, "projection": {"param": "fields", "style": "comma_separated"}}} | change


def engine(spark, **sources):
    return Engine.from_yaml(yaml.safe_dump({"version": 1, "sources": sources}), spark)


def crm(base, **change):
    runtime = change.pop("runtime", None)
    return {"type": "rest", "base_url": base, "tables": {"customers": people(**change)}} | ({"runtime": runtime} if runtime else {})


def plain_server(rows=PEOPLE, status=200, headers=None, delay=0):
    state = {"left": status if isinstance(status, list) else None}

    def answer(method, path, params, body, h):
        time.sleep(delay)
        code = state["left"].pop(0) if state["left"] else 200 if isinstance(status, list) else status
        return code, headers or {}, {"data": rows}

    return stubs.serve_http(answer)


def test_residual_filters_keep_answers_right(spark):
    """The server ignores every parameter; the answers are SQL's all the same, and the parameters were sent."""
    base, log, _ = plain_server()
    e = engine(spark, crm=crm(base))
    assert e.registered_tables() == ["crm.customers"]
    assert e.query("SELECT count(*) AS n FROM crm.customers").first().n == 4
    assert [r.id for r in e.query("SELECT id FROM crm.customers WHERE status = 'active' ORDER BY id").collect()] == [1, 2, 4]
    assert log[-1][2]["status"] == "active" and set(log[-1][2]["fields"].split(",")) == {"id", "status"}
    assert [r.id for r in e.query("SELECT id FROM crm.customers WHERE status <> 'x' OR id = 3 ORDER BY id").collect()] == [1, 2, 3, 4]
    assert e.query("SELECT * FROM crm.customers").columns == ["first_tag", "id", "name", "status"]
    assert e.query("SELECT first_tag FROM crm.customers WHERE id = 1").first()[0] == "alpha"
    assert len(e.query("SELECT id FROM crm.customers LIMIT 2").collect()) == 2 and log[-1][2].get("limit") == "2"
    two = e.query("SELECT a.name, b.status FROM crm.customers a JOIN crm.customers b ON a.id = b.id WHERE a.status IS NULL").collect()
    assert [tuple(r) for r in two] == [("Luca", None)]
    assert e.query("SELECT id FROM crm.customers WHERE status = 'active' OR status = 'gone'").count() == 3
    with pytest.raises(Exception):
        e.query("SELECT * FROM crm.nothing")


def test_explain(spark):
    base, _, _ = plain_server()
    e = engine(spark, crm=crm(base))
    text = e.explain("SELECT id, name FROM crm.customers LIMIT 10")
    for part in ("SQL: SELECT", "Optimized logical plan:", "- crm.customers", "provider: rest", "projection: id, name", "pushed limit: 10", "http plan: GET /all?fields=id,name&limit=10", "Residual local filters:\n  none"):
        assert part in text, text
    text = e.explain("SELECT id FROM crm.customers WHERE status = 'active' AND upper(name) = 'MARIO'")
    assert "pushed filters: status = active" in text and "upper(name" in text.split("Residual")[1]


def test_request_plans():
    t = people(endpoint={"method": "GET", "path": "/customers"})
    f = SimpleFilter
    p = rest.plan_request(t, [f("status", "=", "active"), f("status", "=", "b"), f("id", ">", 3)], ["id", "status"], 50)
    assert p.render() == "GET /customers?fields=id,status&limit=50&status=active"
    assert p.residual == [f("status", "=", "b"), f("id", ">", 3)]
    assert "limit" not in rest.plan_request(t, [], None, 250).params  # capped at 100, and no pages bring the rest
    assert rest.plan_request(t | {"pagination": {"type": "offset"}}, [], None, 250).params["limit"] == "100"
    assert rest.plan_request(t, [f("status", "in", ("a", "b,c"))]).pushed == []
    assert rest.plan_request(t, [f("status", "in", ("a", "b"))]).params["status"] == "a,b"


@pytest.mark.parametrize("kind", ["page", "offset", "cursor", "link"])
def test_paging_reads_everything_from_a_server_with_small_pages(kind):
    rows = [{"id": i} for i in range(23)]
    base, log, _ = stubs.serve_http(stubs.paged(rows, 5))
    pages = {"page": {"type": "page", "page_param": "page", "size_param": "limit"}, "offset": {"type": "offset", "offset_param": "offset", "limit_param": "limit"}, "cursor": {"type": "cursor", "cursor_param": "cursor", "cursor_path": "$.next"}, "link": {"type": "link_header"}}[kind]
    plan = rest.RequestPlan(f"/{kind}", {}, [], [])
    got = [r["id"] for p in rest.pages(Client(None, None), base, plan, pages, "$.data[*]", None, 50) for r in p]
    assert got == list(range(23))
    n = len(log)
    got = [r for p in rest.pages(Client(None, None), base, plan, pages, "$.data[*]", 6, 50) for r in p]
    assert len(got) >= 6 and len(log) - n == 2
    with pytest.raises(PageLimitReached):
        list(rest.pages(Client(None, None), base, plan, pages, "$.data[*]", None, 2))


def test_http_errors_and_retries(monkeypatch):
    base, log, _ = plain_server(status=[503, 200])
    assert Client(None, {"retry": {"max_attempts": 2, "backoff_ms": 1}}).get(f"{base}/x").status == 200 and len(log) == 2
    base, log, _ = plain_server(status=429)
    with pytest.raises(RateLimited):
        Client(None, {"retry": {"max_attempts": 2, "backoff_ms": 1}}).get(f"{base}/x")
    assert len(log) == 2
    base, log, _ = plain_server(status=404)
    with pytest.raises(HttpStatusError):
        Client(None, {"retry": {"max_attempts": 3, "backoff_ms": 1}}).get(f"{base}/x")
    assert len(log) == 1
    base, _, _ = plain_server(delay=0.5)
    with pytest.raises(RequestTimeout):
        Client(None, {"timeout_ms": 50}).get(f"{base}/x")
    base, _, _ = stubs.serve_http(lambda *a: (200, {}, b"no json"))
    with pytest.raises(DecodeError):
        Client(None, None).get(f"{base}/x").json()
    monkeypatch.setenv("TOKEN", "s3")
    assert credentials({"type": "bearer", "token_env": "TOKEN"}) == ({"Authorization": "Bearer s3"}, {})
    assert credentials({"type": "api_key", "in": "query", "name": "k", "value_env": "TOKEN"}) == ({}, {"k": "s3"})
    assert credentials({"type": "basic", "username_env": "TOKEN", "password_env": "TOKEN"})[0]["Authorization"] == "Basic czM6czM="
    with pytest.raises(ConfigError):
        credentials({"type": "bearer", "token_env": "NO_SUCH_VARIABLE"})
    assert join("http://h/api", "/x") == "http://h/api/x"
    assert next_link('<http://h/a?p=2>; rel="next", <http://h/z>; rel="last"', "next", "http://h/") == "http://h/a?p=2"


def test_cache_fetches_once(tmp_path):
    base, log, _ = plain_server(delay=0.15)
    runtime = {"cache": {"ttl_seconds": 60, "folder": str(tmp_path / "c")}}
    threads = [threading.Thread(target=lambda: Client(None, runtime).get(f"{base}/x")) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(log) == 1
    Client(None, {"cache": {"ttl_seconds": 0, "folder": str(tmp_path / "d")}}).get(f"{base}/x")
    Client(None, {"cache": {"ttl_seconds": 0, "folder": str(tmp_path / "d")}}).get(f"{base}/x")
    assert len(log) == 3
    small = HttpCache(60, 2, str(tmp_path / "e"))
    for k in range(4):
        small.get(str(k), lambda: Client(None, None).get(f"{base}/x"))
    assert len([p for p in (tmp_path / "e").iterdir() if "." not in p.name]) == 2


def test_graphql(spark):
    def answer(method, path, params, body, headers):
        rows = [{"login": "mario", "status": "active"}, {"login": "anna", "status": "active"}] if body["variables"] == {"statusVar": "active"} else [{"login": "fallback", "status": "?"}]
        return 200, {}, {"data": {"users": rows}}

    base, log, _ = stubs.serve_http(answer)
    t = {"query": "query($statusVar: String) { users(status: $statusVar) { login status } }", "root": "$.data.users[*]", "columns": {"login": {"path": "$.login", "type": "string"}, "status": {"path": "$.status", "type": "string"}}, "pushdown": {"variables": {"status": "statusVar", "month": "month"}}}
    e = engine(spark, api={"type": "graphql", "endpoint": f"{base}/graphql", "tables": {"users": t}})
    assert sorted(r.login for r in e.query("SELECT login FROM api.users WHERE status = 'active'").collect()) == ["anna", "mario"]
    assert e.query("SELECT count(*) AS n FROM api.users").first().n == 1
    assert "variables: statusVar=active" in e.explain("SELECT login FROM api.users WHERE status = 'active'")
    base, _, _ = stubs.serve_http(lambda *a: (200, {}, {"errors": [{"message": "bad field"}]}))
    e = engine(spark, api={"type": "graphql", "endpoint": base, "tables": {"users": t}})
    with pytest.raises(Exception, match="bad field"):
        e.query("SELECT * FROM api.users").collect()
    assert SourceError


def test_excel(spark, tmp_path):
    import datetime as dt

    p = str(tmp_path / "b.xlsx")
    rows = [["id", "status", "name", "when", "ok"], *[[i + 1, s, n, dt.date(2026, 1, i + 1), i % 2 == 0] for i, (s, n) in enumerate([("active", "mario"), ("off", "anna"), ("active", "luca"), (None, "ugo"), ("active", "giulia")])]]
    excel.write_workbook(p, {"people": rows, "more": [[1.5, None, "x"], [12500.0]]})
    e = engine(spark, x={"type": "excel", "tables": {"people": {"path": p}, "more": {"path": p, "sheet": "more", "has_header": False}}})
    assert sorted(r.name for r in e.query("SELECT name FROM x.people WHERE status = 'active'").collect()) == ["giulia", "luca", "mario"]
    assert [r.name for r in e.query("SELECT name FROM x.people WHERE status <> 'active'").collect()] == ["anna"]
    assert e.query("SELECT * FROM x.people WHERE id = '1'").first().asDict() == {"id": "1", "status": "active", "name": "mario", "when": "2026-01-01", "ok": "true"}
    assert [tuple(r) for r in e.query("SELECT * FROM x.more").collect()] == [("1.5", None, "x"), ("12500", None, None)]
    with pytest.raises(UnsupportedSource):
        excel.Workbook("old.xls")


def test_postgres(spark):
    data = [(1, "Ann", "t", "10.50", "2026-01-02 03:04:05+00"), (2, None, "f", None, None)]
    names = ["id", "name", "ok", "amount", "at"]

    def answer(sql):
        if "missing" in sql:
            return names, []
        wanted = [c.strip('"') for c in sql.split("FROM")[0].removeprefix("SELECT ").strip().split(", ")]
        wanted = names if wanted == ["*"] else wanted
        return [w if w != "1" else "?column?" for w in wanted], [] if "LIMIT 0" in sql else [[dict(zip(names, r)).get(w, 1) for w in wanted] for r in data]

    url, log, _ = stubs.serve_postgres(list(zip(names, (23, 25, 16, 1700, 1184))), answer)
    e = engine(spark, pg={"type": "postgres", "connection": url, "tables": {"t": {"relation": "public.t"}}})
    assert [str(t) for _, t in e.query("SELECT * FROM pg.t").dtypes] == ["bigint", "string", "boolean", "decimal(38,10)", "timestamp"]
    r = e.query("SELECT * FROM pg.t WHERE id = 1").collect()[0]
    assert (r.name, r.ok, float(r.amount), r.at.year) == ("Ann", True, 10.5, 2026)
    assert e.query("SELECT count(*) AS n FROM pg.t").first().n == 2
    e.query("SELECT name FROM pg.t WHERE name >= 'A' AND ok LIMIT 5").collect()
    assert any('"name" >= \'A\'' in s for s in log)
    text = e.explain("SELECT id FROM pg.t WHERE id >= 100 LIMIT 50")
    assert 'sql: SELECT "id" FROM public.t WHERE' in text and "LIMIT 50" in text, text


def test_ldap(spark, monkeypatch):
    monkeypatch.setenv("LDAP_PASSWORD", "x")
    users = ["alice", "bob", "carol", "dave", "erin", "frank"]
    entries = [(f"uid={u},ou=users,dc=example,dc=org", {"objectClass": ["inetOrgPerson"], "uid": [u], "cn": [u.title()], "mail": [f"{u}@x.com"] + ([f"{u}@y.com"] if u == "bob" else [])}) for u in users]
    entries = [(dn, {k.lower(): v for k, v in a.items()}) for dn, a in entries]
    url, _, _ = stubs.serve_ldap(entries)
    t = {"base_dn": "ou=users,dc=example,dc=org", "scope": "sub", "filter": "(objectClass=inetOrgPerson)", "attributes": {"uid": {"ldap": "uid"}, "cn": {"ldap": "cn"}, "mail": {"ldap": "mail"}, "mails": {"ldap": "mail", "type": "list"}, "dn": {"ldap": "__dn__"}}, "pushdown": {"attributes": {"uid": "uid"}}}
    e = engine(spark, dir={"type": "ldap", "url": url, "auth": {"type": "simple", "bind_dn": "cn=admin", "password_env": "LDAP_PASSWORD"}, "tables": {"users": t}})
    assert e.query("SELECT count(*) AS n FROM dir.users").first().n == 6
    assert [r.dn for r in e.query("SELECT dn FROM dir.users WHERE uid = 'alice'").collect()] == ["uid=alice,ou=users,dc=example,dc=org"]
    assert e.query("SELECT uid FROM dir.users WHERE uid IN ('alice', 'bob', 'frank')").count() == 3
    assert [r.uid for r in e.query("SELECT uid FROM dir.users ORDER BY uid LIMIT 3").collect()] == users[:3]
    r = e.query("SELECT mail, mails FROM dir.users WHERE uid = 'bob'").first()
    assert (r.mail, r.mails) == ("bob@x.com, bob@y.com", ["bob@x.com", "bob@y.com"])
    assert "(&(objectClass=inetOrgPerson)(uid=alice))" in e.explain("SELECT dn FROM dir.users WHERE uid = 'alice'")


class Numbers:
    def __init__(self, log):
        self.log = log

    def schema(self):
        return pa.schema([("n", pa.int64()), ("status", pa.string())])

    def capabilities(self):
        return {"projection": False, "limit": True, "filters": {"n": [">=", "<"]}}

    def scan(self, request):
        low, high = 0, 1_000_000
        for f in request["filters"]:
            low = max(low, f["value"]) if f["operator"] == ">=" else low
            high = min(high, f["value"]) if f["operator"] == "<" else high
        with open(self.log, "a") as out:
            out.write(json.dumps({"request": request, "walked": high - low}) + "\n")
        for at in range(low, high, 1000):
            ids = list(range(at, min(high, at + 1000)))
            yield pa.record_batch({"n": pa.array(ids), "status": pa.array(["even" if i % 2 == 0 else "odd" for i in ids])})


def test_programmatic(spark, tmp_path):
    e = Engine.empty(spark)
    log = tmp_path / "log"
    e.register_provider("app.nums", Numbers(str(log)))
    assert e.query("SELECT count(*) AS n FROM app.nums WHERE n >= 100 AND n < 110 AND status = 'even'").first().n == 5
    seen = [json.loads(x) for x in log.read_text().splitlines()]
    assert seen[-1]["walked"] <= 10 and {f["operator"] for f in seen[-1]["request"]["filters"]} == {">=", "<"}
    text = e.explain("SELECT n FROM app.nums WHERE n >= 5 LIMIT 3")
    assert "provider: programmatic" in text and "capabilities: projection=false, limit=true, filters=[n:>=|<]" in text

    @e.table("rows.letters", pa.schema([("k", pa.int64()), ("c", pa.string())]), batch_size=2)
    async def letters():
        for i, c in enumerate("abcde"):
            yield {"k": i, "c": c}

    assert [r.c for r in e.query("SELECT c FROM rows.letters WHERE k >= 2 ORDER BY k").collect()] == list("cde")

    class Fails(Numbers):
        def scan(self, request):
            yield pa.record_batch({"n": pa.array([1]), "status": pa.array(["x"])})
            raise RuntimeError("late")

    e.register_provider("app.late", Fails(str(log)))
    assert len(e.query("SELECT n FROM app.late LIMIT 1").collect()) == 1
    assert e.registered_tables() == ["app.late", "app.nums", "rows.letters"]
    assert asyncio.run(e.query_async("SELECT 1 AS one"))[0].to_pydict() == {"one": [1]}
    assert pa.ipc.open_stream(e.query_ipc("SELECT 1 AS one")).read_all().num_rows == 1
    assert e.attach("views") and spark.sql("SELECT count(*) AS n FROM views.rows_letters").first().n == 5
    with pytest.raises(UnknownTable):
        e.scan("no.table")


def test_infer_and_cli(spark, tmp_path, capsys, monkeypatch):
    p = tmp_path / "ev.jsonl"
    p.write_text("".join(json.dumps({"id": i, "trace_id": f"t{i}", "x": i / 2, "at": "2026-01-01T00:00:00+01:00"}) + "\n" for i in range(20)))
    c = infer.detect(str(p))
    t = c["sources"]["files"]["tables"]["ev"]
    assert [x["type"] for x in t["parser"]["columns"]] == ["int64", "string", "float64", "timestamp"]
    assert {i["name"]: i["kind"] for i in t["indexed_columns"]} == {"id": "zone_map", "trace_id": "bloom", "x": "zone_map", "at": "zone_map"}
    (tmp_path / "a.tsv").write_text("a\tb\n1\tx\n2\ty\n")
    assert infer.detect(str(tmp_path / "a.tsv"))["sources"]["files"]["tables"]["a"]["parser"]["delimiter"] == "\t"
    assert infer.detect(str(tmp_path / "a.tsv"))
    got = infer.describe("http://h/v1/things?x=1", [{"a": 1}, {"a": 2.5, "b c": None}], {}, "api", None)
    assert got["sources"]["api"]["tables"]["things"]["root"] == "$[*]" and got["sources"]["api"]["tables"]["things"]["columns"]["b_c"]["path"] == "$['b c']"
    assert infer.describe("http://h/x", {"results": []}, {}, "api", None)["sources"]["api"]["tables"]["x"]["root"] == "$.results[*]"
    y = tmp_path / "c.yaml"
    y.write_text(infer.to_yaml(c))
    assert cli.main(["validate", str(y)]) == 0 and "1 tables" in capsys.readouterr().out
    assert cli.main(["inspect", str(y)]) == 0 and "trace_id: string" in capsys.readouterr().out
    assert cli.main(["attach", str(y)]) == 0 and "files_ev" in capsys.readouterr().out
    assert cli.main(["index", str(y), "files.ev"]) == 0 and "built" in capsys.readouterr().out
    assert cli.main(["query", str(y), "SELECT count(*) AS n FROM files.ev WHERE id < 5"]) == 0 and "| 5 |" in capsys.readouterr().out
    assert cli.main(["explain", str(y), "SELECT id FROM files.ev"]) == 0 and "provider: rows_file" in capsys.readouterr().out
    assert cli.main(["validate", str(tmp_path / "none.yaml")]) == 1 and "error:" in capsys.readouterr().err
    answers = iter(["file", str(p), "s", "t"])
    assert "rows_file" in cli.init(lambda _: next(answers))
