import datetime as dt

import pytest
import yaml

from polyscan import jsonpath, types
from polyscan.config import Config
from polyscan.errors import ConfigError, DecodeError
from polyscan.filters import SimpleFilter, plain, sql_literal
from polyscan.sources import ldap, parsers, postgres

REST = {"type": "rest", "base_url": "https://api.example.com", "tables": {"customers": {"endpoint": {"method": "GET", "path": "/customers"}, "root": "$.data[*]", "columns": {"id": {"path": "$.id", "type": "int64"}}}}}


def load(source, name="crm"):
    return Config.from_yaml(yaml.safe_dump({"version": 1, "sources": {name: source}}))


def table(**change):
    return {**REST, "tables": {"customers": {**REST["tables"]["customers"], **change}}}


def lines(**change):
    t = {"path": "/a.log", "parser": {"format": "jsonl", "columns": [{"name": "id", "path": "$.id", "type": "int64"}]}} | change
    return {"type": "rows_file", "tables": {"t": {k: v for k, v in t.items() if v is not None}}}


@pytest.mark.parametrize(
    "source, message",
    [
        (table(columns={"id": {"path": "not-a-valid-path", "type": "int64"}}), "column `crm.customers.id` has invalid JSONPath"),
        (table(root="data[*]"), "invalid root JSONPath"),
        (table(endpoint={"method": "POST", "path": "/x"}), "GET"),
        (table(columns={}), "at least one column"),
        (table(columns={"id": {"path": "$.id", "type": "int9"}}), "unknown type"),
        (table(pushdown={"filters": {"id": {"operators": ["="]}}}), "requires `param`"),
        (table(pushdown={"filters": {"id": {"param": "x", "operators": []}}}), "at least one operator"),
        (table(pagination={"type": "page", "page_param": "p"}), "size_param"),
        ({**REST, "base_url": " "}, "base_url"),
        ({**REST, "auth": {"type": "bearer"}}, "token_env"),
        ({**REST, "tables": {}}, "at least one table"),
        (lines(glob="/b*.log"), "cannot define both"),
        (lines(path=None), "must define `path` or `glob`"),
        (lines(parser={"format": "jsonl", "columns": [{"name": "id", "path": "not_a_path", "type": "int64"}]}), "invalid JSONPath"),
        (lines(parser={"format": "regex", "pattern": "(", "columns": [{"name": "a", "group": "a", "type": "string"}]}), "invalid pattern"),
        (lines(parser={"format": "regex", "pattern": "x", "columns": [{"name": "a", "group": "a", "type": "string"}]}), "no group"),
        (lines(indexed_columns=[{"name": "zz", "kind": "bloom"}]), "is no column"),
        ({"type": "ldap", "url": "http://x", "tables": {"u": {"base_dn": "dc=x", "attributes": {"a": {"ldap": "a"}}}}}, "ldap://"),
        ({"type": "tape", "tables": {"t": {}}}, "unknown type"),
    ],
)
def test_config_rejects(source, message):
    with pytest.raises(ConfigError, match=message.replace("(", r"\(")):
        load(source)


def test_config_accepts():
    with pytest.raises(ConfigError, match="version"):
        Config.from_yaml("version: 2\nsources: {a: {}}")
    with pytest.raises(ConfigError, match="at least one source"):
        Config.from_yaml("version: 1\nsources: {}")
    with pytest.raises(ConfigError, match="parse"):
        Config.from_yaml("a: [")
    push = {"filters": {"id": {"param": "id", "operators": ["="]}}, "limit": {"param": "limit", "max": 100}, "projection": {"param": "fields", "style": "comma_separated"}}
    assert load(table(pushdown=push)).table_names() == ["crm.customers"]
    csv = {"format": "csv", "delimiter": ",", "has_header": True, "columns": [{"name": "id", "source": {"name": "order_id"}, "type": "int64"}, {"name": "total", "source": {"index": 4}, "type": "float64"}]}
    assert load(lines(path=None, glob="/data/sales-*.csv", parser=csv)).sources["crm"].tables["t"]["glob"] == "/data/sales-*.csv"


DOC = {"a": {"b": [{"c": 1}, {"c": 2}, {"d": 3}]}, "tags": ["x", "y", "z"], "odd name": 5, "n": None}


@pytest.mark.parametrize(
    "path, want",
    [("$", [DOC]), ("$.a.b[*].c", [1, 2]), ("$.tags[0]", ["x"]), ("$.tags[-1]", ["z"]), ("$.tags[5]", []), ("$['odd name']", [5]), ('$["odd name"]', [5]), ("$.tags[0:2]", ["x", "y"]), ("$.tags[::-1]", ["z", "y", "x"]), ("$.tags[0,2]", ["x", "z"]), ("$..c", [1, 2]), ("$.a.b[*]['c','d']", [1, 2, 3]), ("$.n", [None]), ("$.a.*", [DOC["a"]["b"]])],
)
def test_jsonpath(path, want):
    assert jsonpath.find(path, DOC) == want
    assert jsonpath.first(path, DOC, "none") == (want[0] if want else "none")


@pytest.mark.parametrize("path", ["a", "", "$.", "$[", "$[?(@.x)]", "$.a[", "$x", "$['a"])
def test_jsonpath_rejects(path):
    with pytest.raises(jsonpath.JsonPathError):
        jsonpath.parse(path)


def test_types_are_strict():
    j = types.from_json
    assert [j(v, "int64") for v in (3, 3.0, "3", True, 2**63, None)] == [3, None, None, None, None, None]
    assert [j(v, "float64") for v in (3, 3.5, "3", True)] == [3.0, 3.5, None, None]
    assert [j(v, "boolean") for v in (True, "true", 1)] == [True, None, None]
    assert [j(v, "string") for v in ("x", 1, {"a": 1}, None)] == ["x", "1", '{"a":1}', None]
    assert [j(v, "date") for v in ("2026-04-30", "2026-4-30", "2026-02-30")] == [dt.date(2026, 4, 30), None, None]
    assert j("2026-04-30T10:30:00+02:00", "timestamp") == dt.datetime(2026, 4, 30, 8, 30, tzinfo=dt.timezone.utc)
    assert j("2026-04-30T10:35:42.1234567Z", "timestamp").microsecond == 123456
    assert [j(v, "timestamp") for v in ("2026-04-30", "x", 5)] == [None] * 3
    assert str(j(1.5, "decimal")) == "1.5000000000" and j("x", "decimal") is None
    assert j([1, "a", None], "list") == ["1", "a", None] and j("a", "list") is None
    t = types.from_text
    assert [t(v, "int64") for v in ("12", " 3", "1_0", "1.0", "9223372036854775808")] == [12, None, None, None, None]
    assert [t(v, "float64") for v in ("1e3", "1_0", ".5", "x")] == [1000.0, None, 0.5, None]


def columns(fmt, cols, data, start=0, **spec):
    return parsers.make({"format": fmt, "columns": cols, **spec}).parse(data, start)


def test_jsonl():
    cols = [{"name": "id", "path": "$.id", "type": "int64"}, {"name": "tag", "path": "$.t[0]", "type": "string"}]
    assert columns("jsonl", cols, b'{"id":1,"t":["a"]}\n\n{"id":"x","t":null}\n') == {"id": [1, None], "tag": ["a", None]}
    with pytest.raises(DecodeError):
        columns("jsonl", cols, b"{oops\n")


def test_csv_header_belongs_to_the_first_chunk_only():
    cols = [{"name": "user_id", "source": {"name": "id"}, "type": "int64"}, {"name": "label", "source": {"index": 1}, "type": "string"}, {"name": "value", "source": {"name": "score"}, "type": "float64"}]
    p = parsers.make({"format": "csv", "columns": cols})
    p.header = ["id", "name", "score"]
    assert p.parse(b'id,name,score\n1,alpha,3.14\n2,"be,ta",\n', 0) == {"user_id": [1, 2], "label": ["alpha", "be,ta"], "value": [3.14, None]}
    assert p.parse(b"3,gamma,1\n4\n", 500) == {"user_id": [3, 4], "label": ["gamma", None], "value": [1.0, None]}


def test_logfmt_regex_syslog():
    cols = [{"name": n, "key": n, "type": t} for n, t in (("level", "string"), ("msg", "string"), ("user_id", "int64"))]
    assert columns("logfmt", cols, 'level=info msg="hello wörld" user_id=42 extra=ignored\nmsg="a \\"quoted\\" b" user_id=7 user_id=8 flag\n'.encode()) == {"level": ["info", None], "msg": ["hello wörld", 'a "quoted" b'], "user_id": [42, 7]}
    cols = [{"name": "ip", "group": "ip", "type": "string"}, {"name": "n", "group": "n", "type": "int64"}]
    assert columns("regex", cols, b"x 10.0.0.1 - 77 y\nno\n", pattern=r"(?P<ip>\d+\.\d+\.\d+\.\d+) - (?P<n>\d+)") == {"ip": ["10.0.0.1", None], "n": [77, None]}
    names = ["priority", "facility", "severity", "version", "timestamp", "hostname", "app_name", "proc_id", "msg_id", "structured_data", "message"]
    kinds = {"priority": "int64", "facility": "int64", "severity": "int64", "version": "int64", "timestamp": "timestamp"}
    cols = [{"name": n, "field": n, "type": kinds.get(n, "string")} for n in names]
    line = '<165>1 2003-10-11T22:14:15.003Z host.example evntslog - ID47 [exampleSDID@32473 iut="3" e="a]\\]b"] ﻿An event'
    got = columns("syslog", cols, (line + "\nnot syslog\n").encode())
    assert [got[n][0] for n in names] == [165, 20, 5, 1, dt.datetime(2003, 10, 11, 22, 14, 15, 3000, dt.timezone.utc), "host.example", "evntslog", None, "ID47", '[exampleSDID@32473 iut="3" e="a]\\]b"]', "An event"]
    assert all(got[n][1] is None for n in names)


def test_postgres_sql_and_addresses():
    f = SimpleFilter
    sql = postgres.select("public.users", None, [f("status", "=", "active"), f("id", ">=", 100), f("k", "in", ("a", "b'c")), f("z", "is_null"), f('o"d', "!=", True)], 50)
    assert sql == """SELECT * FROM public.users WHERE "status" = 'active' AND "id" >= 100 AND "k" IN ('a', 'b''c') AND "z" IS NULL AND "o""d" <> TRUE LIMIT 50"""
    assert postgres.select("t", []) == "SELECT 1 FROM t"
    assert postgres.address("postgres://u:p%40@h:6000/d?sslmode=disable") == {"host": "h", "port": 6000, "user": "u", "password": "p@", "sslmode": "disable", "dbname": "d"}
    assert postgres.address("host=h user=u dbname=d")["port"] == 5432
    assert [postgres.parse(v, k) for v, k in (("t", "boolean"), ("1.50", "decimal"), ("2026-01-02 03:04:05.5+00", "timestamp"), (None, "int64"))][0] is True
    assert postgres.parse("2026-01-02 03:04:05.5+01", "timestamp") == dt.datetime(2026, 1, 2, 2, 4, 5, 500000, dt.timezone.utc)


def test_scram_agrees_with_the_published_exchange():
    s = postgres.Scram(b"pencil", "rOprNGfwEbeRWgbNEkqO")
    s.bare = "n=user,r=rOprNGfwEbeRWgbNEkqO"
    final = s.proof("r=rOprNGfwEbeRWgbNEkqO%hvYDpWUa2RaTCAfuxFIlj)hNlF$k0,s=W22ZaJ0SNY7soEsUEjb6gQ==,i=4096")
    assert final.endswith("p=dHzbZapWIk4jUhN+Ute9ytag9zjfMHgsqmmiz7AndVQ=")
    s.verify("v=6rriTRBi23WpRR/wtup+mMhUZUn/dB5nLTJRsjl95G4=")


def test_ldap_filters():
    f = SimpleFilter
    a = ldap.assertion
    assert ldap.compose("(objectClass=inetOrgPerson)", [a("uid", f("uid", "=", "mario"))]) == "(&(objectClass=inetOrgPerson)(uid=mario))"
    assert ldap.compose("(objectClass=inetOrgPerson)", [a("mail", f("mail", "in", ("a@x.com", "b@x.com")))]) == "(&(objectClass=inetOrgPerson)(|(mail=a@x.com)(mail=b@x.com)))"
    assert ldap.escape("evil*)(cn=*") == r"evil\2a\29\28cn=\2a" and ldap.escape("è") == r"\c3\a8"
    assert ldap.compose(None, []) == "(objectClass=*)"
    assert a("bad(name", f("x", "=", "1")) is None
    assert a("a", f("a", "!=", "v")) == "(&(a=*)(!(a=v)))" and a("a", f("a", "is_null")) == "(!(a=*))"
    for text in ("(a=*)", "(a=b*c*d)", "(&(a=1)(!(b<=2)))", r"(cn=\c3\a8)"):
        assert ldap.encode_filter(text)
    with pytest.raises(DecodeError):
        ldap.encode_filter("(a=b")


def test_literals():
    at = dt.datetime(2026, 1, 2, 3, 4, 5, 600000, dt.timezone.utc)
    assert plain(at) == "2026-01-02T03:04:05.600000Z" and plain(True) == "true" and plain(12) == "12"
    assert sql_literal("o'x") == "'o''x'" and sql_literal(1.5) == "1.5" and sql_literal(None) == "NULL"


def test_arrow_reads_lines_as_the_parser_does():
    from polyscan import types
    from polyscan.sources import parsers

    kinds = {"i": "int64", "f": "float64", "s": "string", "b": "boolean", "t": "timestamp"}
    parser = parsers.make({"format": "jsonl", "columns": [{"name": k, "path": f"$.{k}", "type": v} for k, v in kinds.items()]})
    schema = parsers.line_schema(parser.spec)
    plain = b'{"i":1,"f":2,"s":"\\u00e9\\n","b":true,"t":"2024-01-02T03:04:05.5Z","x":[1]}\n{"s":null,"i":-9223372036854775808}\r\n{}\n'
    assert parser._plain(plain, schema) == types.batch(parser.parse(plain), schema)
    odd = [b'{"i":1.0}\n', b'{"i":"1"}\n', b'{"s":5}\n', b'{"i":1,"i":2}\n', b'{"i":9223372036854775808}\n', b'{"f":"x"}\n', b'{"b":0}\n', b'{"t":"2024-01-02T03:04:60Z"}\n', b'{"t":"2024-02-30T00:00:00Z"}\n', b'{"t":"2024-01-02T03:04:05+01:00"}\n', b'{"t":7}\n', b'{"s":"\xff"}\n', b"\n\n", b'{"i":1}\n\n', b"[1]\n", b'{"i":1}\n{"i":', b"  ", b'{"s":{"a":1}}\n', b'{"s":"a"}']
    for data in odd:
        assert parser.batch(data, 0, schema) == types.batch(parser.parse(data), schema), data
    for bad in (b'{"i":1}{"i":2}\n', b"{\n", b'{"i":1}\nx\n{"i":2}\n'):
        with pytest.raises(parsers.DecodeError):
            parser.batch(bad, 0, schema)
