"""PostgreSQL tables: a SELECT built from the pushed parts, over a small client of the wire protocol (version 3).

JDBC does the same where a driver's jar is at hand; see `jdbc_table`. The client knows clear-text, MD5 and SCRAM-SHA-256
passwords and the simple query protocol, whose values are text and are parsed by their column's type.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import hmac
import os
import re
import socket
import ssl
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import types as T

from polyscan import types
from polyscan.errors import SourceError
from polyscan.filters import SimpleFilter, sql_literal
from polyscan.sources.base import BATCH, Scan

#: PostgreSQL type numbers (pg_type.oid) with a Spark type of their own; all others are text.
OIDS = {16: "boolean", 20: "int64", 21: "int64", 23: "int64", 26: "int64", 700: "float64", 701: "float64", 1082: "date", 1114: "timestamp", 1184: "timestamp", 1700: "decimal"}


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def predicate(f: SimpleFilter) -> str:
    """A filter as SQL."""
    if f.op == "is_null":
        return f"{quote(f.column)} IS NULL"
    if f.op == "is_not_null":
        return f"{quote(f.column)} IS NOT NULL"
    if f.op == "in":
        return f"{quote(f.column)} IN ({', '.join(map(sql_literal, f.value))})"
    return f"{quote(f.column)} {'<>' if f.op == '!=' else f.op} {sql_literal(f.value)}"


def select(relation: str, columns=None, filters=(), limit: int | None = None) -> str:
    """columns: None for all, empty for a count of rows alone."""
    what = "*" if columns is None else ", ".join(map(quote, columns)) or "1"
    where = " AND ".join(map(predicate, filters))
    return f"SELECT {what} FROM {relation}" + (f" WHERE {where}" if where else "") + (f" LIMIT {limit}" if limit is not None else "")


def address(connection: str) -> dict[str, Any]:
    """A postgres:// URL or key=value text as host, port, user, password, dbname, sslmode."""
    out = {"host": "localhost", "port": "5432", "user": os.environ.get("PGUSER", "postgres"), "password": os.environ.get("PGPASSWORD", ""), "sslmode": "prefer"}
    if "://" in connection:
        u = urlsplit(connection)
        found = {"host": u.hostname, "port": u.port, "user": unquote(u.username or ""), "password": unquote(u.password or ""), "dbname": u.path.lstrip("/")}
        found |= {k: v[-1] for k, v in parse_qs(u.query).items()}
    else:
        found = {k: (a or b).replace("\\'", "'") for k, a, b in re.findall(r"(\w+)\s*=\s*(?:'((?:[^'\\]|\\.)*)'|(\S+))", connection)}
    out |= {k: str(v) for k, v in found.items() if v}
    return out | {"port": int(out["port"]), "dbname": out.get("dbname") or out["user"]}


class Connection:
    """One session; query() yields the column types, then rows of text."""

    def __init__(self, connection: str, timeout: float = 30.0):
        a = address(connection)
        self.sock = socket.create_connection((a["host"], a["port"]), timeout)
        if a["sslmode"] in ("require", "verify-ca", "verify-full"):
            self.sock.sendall(struct.pack("!II", 8, 80877103))
            if self.sock.recv(1) != b"S":
                raise SourceError("the server has no TLS")
            context = ssl.create_default_context()
            if a["sslmode"] != "verify-full":
                context.check_hostname = False
            if a["sslmode"] == "require":
                context.verify_mode = ssl.CERT_NONE
            self.sock = context.wrap_socket(self.sock, server_hostname=a["host"])
        self.file = self.sock.makefile("rb")
        body = struct.pack("!I", 196608) + b"".join(x.encode() + b"\0" for kv in {"user": a["user"], "database": a["dbname"], "client_encoding": "UTF8", "TimeZone": "UTC", "DateStyle": "ISO"}.items() for x in kv) + b"\0"
        self.sock.sendall(struct.pack("!I", len(body) + 4) + body)
        self._login(a)

    def _send(self, kind: bytes, body: bytes) -> None:
        self.sock.sendall(kind + struct.pack("!I", len(body) + 4) + body)

    def _receive(self) -> tuple[bytes, bytes]:
        head = self.file.read(5)
        if len(head) < 5:
            raise SourceError("the server closed the connection")
        body = self.file.read(struct.unpack("!I", head[1:])[0] - 4)
        if head[:1] == b"E":
            parts = {x[:1]: x[1:].decode("utf-8", "replace") for x in body.split(b"\0") if x}
            raise SourceError(f"PostgreSQL: {parts.get(b'M', 'error')} ({parts.get(b'C', '')})")
        return head[:1], body

    def _login(self, a: dict) -> None:
        scram = None
        while True:
            kind, body = self._receive()
            if kind == b"Z":
                return
            if kind != b"R":
                continue
            code = struct.unpack("!I", body[:4])[0]
            password = a["password"].encode()
            if code == 3:
                self._send(b"p", password + b"\0")
            elif code == 5:
                inner = hashlib.md5(password + a["user"].encode()).hexdigest().encode()
                self._send(b"p", b"md5" + hashlib.md5(inner + body[4:8]).hexdigest().encode() + b"\0")
            elif code == 10:
                scram = Scram(password)
                first = scram.first().encode()
                self._send(b"p", b"SCRAM-SHA-256\0" + struct.pack("!I", len(first)) + first)
            elif code == 11:
                self._send(b"p", scram.proof(body[4:].decode()).encode())
            elif code == 12:
                scram.verify(body[4:].decode())
            elif code != 0:
                raise SourceError(f"unsupported authentication {code}")

    def query(self, sql: str) -> Iterator[Any]:
        self._send(b"Q", sql.encode() + b"\0")
        while True:
            kind, body = self._receive()
            if kind == b"T":
                columns, at = [], 2
                for _ in range(struct.unpack("!H", body[:2])[0]):
                    end = body.index(b"\0", at)
                    columns.append((body[at:end].decode(), struct.unpack("!I", body[end + 7 : end + 11])[0]))
                    at = end + 19
                yield columns
            elif kind == b"D":
                row, at = [], 2
                for _ in range(struct.unpack("!H", body[:2])[0]):
                    n = struct.unpack("!i", body[at : at + 4])[0]
                    at += 4
                    row.append(None if n < 0 else body[at : at + n].decode())
                    at += max(n, 0)
                yield row
            elif kind == b"Z":
                return

    def close(self) -> None:
        with contextlib.suppress(OSError):
            self._send(b"X", b"")
            self.sock.close()


class Scram:
    """SCRAM-SHA-256 (RFC 7677), without channel binding."""

    def __init__(self, password: bytes, nonce: str | None = None):
        self.password = password
        self.bare = f"n=,r={nonce or base64.b64encode(os.urandom(18)).decode()}"

    def first(self) -> str:
        return f"n,,{self.bare}"

    def proof(self, server_first: str) -> str:
        found = dict(x.split("=", 1) for x in server_first.split(","))
        if not found["r"].startswith(self.bare.split("r=")[1]):
            raise SourceError("the server's nonce is not ours")
        salted = hashlib.pbkdf2_hmac("sha256", self.password, base64.b64decode(found["s"]), int(found["i"]))
        mac = lambda key, text: hmac.digest(key, text, "sha256")
        client = mac(salted, b"Client Key")
        without = f"c=biws,r={found['r']}"
        text = f"{self.bare},{server_first},{without}".encode()
        self.expected = base64.b64encode(mac(mac(salted, b"Server Key"), text)).decode()
        signature = mac(hashlib.sha256(client).digest(), text)
        return f"{without},p={base64.b64encode(bytes(a ^ b for a, b in zip(client, signature))).decode()}"

    def verify(self, server_final: str) -> None:
        if dict(x.split("=", 1) for x in server_final.split(",")).get("v") != self.expected:
            raise SourceError("the server does not know the password")


def parse(text: str | None, kind: str):
    """A value of the text format."""
    if text is None:
        return None
    if kind == "boolean":
        return text == "t"
    if kind == "timestamp":
        t = text.replace(" ", "T")
        if re.search(r"[+-]\d\d$", t):
            t += ":00"
        elif not re.search(r"([+-]\d\d:\d\d|Z)$", t):
            t += "Z"
        return types.timestamp(t)
    return types.from_text(text, kind)


@dataclass
class PostgresScan(Scan):
    source: dict[str, Any] = field(default_factory=dict)
    table: dict[str, Any] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)

    kind = "postgres"

    def accepts(self, f: SimpleFilter) -> bool:
        values = f.value if f.op == "in" else (f.value,)
        return f.op in ("is_null", "is_not_null") or (bool(values) and all(isinstance(v, (bool, int, float, str)) or hasattr(v, "isoformat") for v in values))

    def exact(self, f: SimpleFilter) -> bool:
        """Order of text depends on the server's collation, and NaN and text types on theirs: those are looked at again here."""
        kind = self.kinds.get(f.column)
        return f.op in ("is_null", "is_not_null") or kind in ("int64", "boolean") or (kind == "string" and f.op in ("=", "!=", "in"))

    def sql(self) -> str:
        columns = None if self.hints.columns is None else [c for c in self.schema.names if c in self.wanted()]
        return select(self.table["relation"], columns, self.filters, self.hints.limit)

    def read(self, part) -> Iterator[pa.RecordBatch]:
        c = Connection(self.source["connection"])
        try:
            answer = c.query(self.sql())
            names = [n for n, _ in next(answer)]
            held: list[list] = []
            for row in answer:
                held.append(row)
                if len(held) >= BATCH:
                    yield self._batch(names, held)
                    held = []
            if held:
                yield self._batch(names, held)
        finally:
            c.close()

    def _batch(self, names: list[str], rows: list[list]) -> pa.RecordBatch:
        columns = dict(zip(names, map(list, zip(*rows))))
        return types.batch({n: [parse(v, self.kinds[n]) for v in columns[n]] if n in columns else [None] * len(rows) for n in self.schema.names}, self.schema)

    def describe(self) -> list[str]:
        return [*super().describe(), f"sql: {self.sql()}"]


def postgres_scan(name: str, source: dict, table: dict) -> PostgresScan:
    """Asks the server for the columns; called only when a query names the table."""
    c = Connection(source["connection"])
    try:
        columns = next(c.query(select(table["relation"], None, (), 0)))
    finally:
        c.close()
    kinds = {n: OIDS.get(oid, "string") for n, oid in columns}
    schema = T.StructType([T.StructField(n, types.spark_type(k)) for n, k in kinds.items()])
    return PostgresScan(name, schema, source=source, table=table, kinds=kinds)


def jdbc_table(spark, source: dict, table: dict):
    """The table through Spark's JDBC source, which pushes filters, columns and limits itself; needs the driver's jar."""
    a = address(source["connection"])
    reader = spark.read.format("jdbc").option("url", f"jdbc:postgresql://{a['host']}:{a['port']}/{a['dbname']}").option("dbtable", table["relation"])
    return reader.option("user", a["user"]).option("password", a["password"]).option("driver", "org.postgresql.Driver").load()
