"""LDAP tables: a search filter from the pushed parts, over a small client of the protocol (version 3, RFC 4511)."""

from __future__ import annotations

import re
import socket
import ssl
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import types as T

from polyscan import types
from polyscan.errors import DecodeError, SourceError
from polyscan.filters import SimpleFilter, plain
from polyscan.sources.base import BATCH, Scan
from polyscan.sources.http import secret

DN = "__dn__"
EVERYTHING = "(objectClass=*)"
SCOPES = {"base": 0, "one": 1, "sub": 2}
PAGE = 500
PAGED = "1.2.840.113556.1.4.319"


def escape(value: str) -> str:
    """A value in a filter (RFC 4515): reserved and non-ASCII bytes as \\xx."""
    return "".join(f"\\{b:02x}" if b in b"*()\\\0" or b >= 0x80 else chr(b) for b in value.encode())


def assertion(attribute: str, f: SimpleFilter) -> str | None:
    """A filter over one attribute; None if it has no form here."""
    if not re.fullmatch(r"[A-Za-z0-9.;_-]+", attribute):
        return None
    some = f"({attribute}=*)"
    if f.op == "is_not_null":
        return some
    if f.op == "is_null":
        return f"(!{some})"
    if f.op == "in":
        return f"(|{''.join(f'({attribute}={escape(plain(v))})' for v in f.value)})" if f.value else None
    v = escape(plain(f.value))
    if f.op == "!=":
        return f"(&{some}(!({attribute}={v})))"  # a missing value is not unequal
    return {"=": f"({attribute}={v})", "<=": f"({attribute}<={v})", ">=": f"({attribute}>={v})", "<": f"(&({attribute}<={v})(!({attribute}={v})))", ">": f"(&({attribute}>={v})(!({attribute}={v})))"}[f.op]


def compose(base: str | None, parts: list[str]) -> str:
    base = base or EVERYTHING
    return f"(&{base}{''.join(parts)})" if parts else base


# --- BER: a tag byte, a length, the content


def tlv(tag: int, content: bytes) -> bytes:
    n = len(content)
    if n < 128:
        return bytes([tag, n]) + content
    size = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag, 0x80 | len(size)]) + size + content


def integer(n: int, tag: int = 2) -> bytes:
    return tlv(tag, n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True))


def text(s: str | bytes, tag: int = 4) -> bytes:
    return tlv(tag, s if isinstance(s, bytes) else s.encode())


def elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        yield tag, data[at : at + n]
        at += n


def _unescape(value: str) -> bytes:
    out, i = bytearray(), 0
    while i < len(value):
        if value[i] == "\\":
            out.append(int(value[i + 1 : i + 3], 16))
            i += 3
        else:
            out += value[i].encode()
            i += 1
    return bytes(out)


def encode_filter(s: str) -> bytes:
    """The text of a search filter in BER."""
    out, at = _filter(s.strip(), 0)
    if at != len(s.strip()):
        raise DecodeError(f"bad LDAP filter {s!r}")
    return out


def _filter(s: str, at: int) -> tuple[bytes, int]:
    if s[at : at + 1] != "(":
        raise DecodeError(f"bad LDAP filter {s!r}")
    c = s[at + 1 : at + 2]
    if c and c in "&|!":
        parts, i = [], at + 2
        while s[i : i + 1] == "(":
            part, i = _filter(s, i)
            parts.append(part)
        if s[i : i + 1] != ")" or not parts or (c == "!" and len(parts) > 1):
            raise DecodeError(f"bad LDAP filter {s!r}")
        return tlv({"&": 0xA0, "|": 0xA1, "!": 0xA2}[c], b"".join(parts)), i + 1
    end = s.find(")", at)
    m = re.fullmatch(r"([A-Za-z0-9.;_-]+)(=|>=|<=|~=)(.*)", s[at + 1 : end], re.S) if end > 0 else None
    if not m:
        raise DecodeError(f"bad LDAP filter {s!r}")
    attribute, op, value = m.groups()
    if op == "=" and value == "*":
        return text(attribute, 0x87), end + 1
    if op == "=" and "*" in value:
        first, *middle, last = value.split("*")
        parts = ([text(_unescape(first), 0x80)] if first else []) + [text(_unescape(x), 0x81) for x in middle if x] + ([text(_unescape(last), 0x82)] if last else [])
        return tlv(0xA4, text(attribute) + tlv(0x30, b"".join(parts))), end + 1
    return tlv({"=": 0xA3, ">=": 0xA5, "<=": 0xA6, "~=": 0xA8}[op], text(attribute) + text(_unescape(value))), end + 1


class Connection:
    def __init__(self, url: str, auth: dict | None = None, timeout: float = 30.0):
        u = urlsplit(url)
        secure = u.scheme == "ldaps"
        self.sock = socket.create_connection((u.hostname, u.port or (636 if secure else 389)), timeout)
        if secure:
            self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=u.hostname)
        self.file, self.number = self.sock.makefile("rb"), 0
        simple = (auth or {}).get("type") == "simple"
        dn, password = (auth["bind_dn"], secret(auth["password_env"])) if simple else ("", "")
        self._send(tlv(0x60, integer(3) + text(dn) + text(password, 0x80)))
        self._result(self._receive()[1][1])

    def _send(self, op: bytes, controls: bytes = b"") -> None:
        self.number += 1
        self.sock.sendall(tlv(0x30, integer(self.number) + op + (tlv(0xA0, controls) if controls else b"")))

    def _receive(self) -> list[tuple[int, bytes]]:
        head = self.file.read(2)
        if len(head) < 2:
            raise SourceError("the directory closed the connection")
        n = head[1]
        if n & 0x80:
            n = int.from_bytes(self.file.read(n & 0x7F), "big")
        return list(elements(self.file.read(n)))

    @staticmethod
    def _result(body: bytes) -> None:
        code, _, message = [c for _, c in elements(body)][:3]
        n = int.from_bytes(code, "big")
        if n not in (0, 4):  # 4: the size limit asked for was reached
            raise SourceError(f"LDAP result {n}: {message.decode('utf-8', 'replace')}")

    def search(self, base: str, scope: str, filter_: str, attributes: list[str], limit: int = 0) -> Iterator[tuple[str, dict[str, list[str]]]]:
        """(dn, attributes) of each entry, fetched in pages."""
        cookie = b""
        while True:
            op = text(base) + integer(SCOPES[scope], 10) + integer(0, 10) + integer(limit) + integer(0) + tlv(1, b"\0") + encode_filter(filter_) + tlv(0x30, b"".join(text(a) for a in attributes or ["1.1"]))
            control = tlv(0x30, text(PAGED) + text(tlv(0x30, integer(PAGE) + text(cookie))))
            self._send(tlv(0x63, op), control)
            cookie = b""
            while True:
                message = self._receive()
                tag, body = message[1]
                if tag == 0x64:
                    dn, found = [c for _, c in elements(body)]
                    entry = {}
                    for _, a in elements(found):
                        name, values = [c for _, c in elements(a)]
                        entry[name.decode().lower()] = [v.decode("utf-8", "replace") for _, v in elements(values)]
                    yield dn.decode("utf-8", "replace"), entry
                elif tag == 0x65:
                    self._result(body)
                    for _, controls in message[2:]:
                        for _, c in elements(controls):
                            fields = [x for _, x in elements(c)]
                            if fields[0] == PAGED.encode():
                                cookie = [x for _, x in elements(next(x for _, x in elements(fields[-1])))][1]
                    break
            if not cookie:
                return

    def close(self) -> None:
        try:
            self._send(b"\x42\x00")
            self.sock.close()
        except OSError:
            pass


@dataclass
class LdapScan(Scan):
    """A column of several values is joined by ', ', or with type list an array; filters on the server match any value,
    those above the scan the joined one."""

    source: dict[str, Any] = field(default_factory=dict)
    table: dict[str, Any] = field(default_factory=dict)

    kind = "ldap"

    def pushable(self) -> dict[str, str]:
        return (self.table.get("pushdown") or {}).get("attributes") or {}

    def accepts(self, f: SimpleFilter) -> bool:
        values = f.value if f.op == "in" else (f.value,)
        return f.column in self.pushable() and (f.op in ("is_null", "is_not_null") or all(isinstance(v, (str, int)) and not isinstance(v, bool) for v in values)) and assertion(self.pushable()[f.column], f) is not None

    def filter(self) -> str:
        return compose(self.table.get("filter"), [assertion(self.pushable()[f.column], f) for f in self.filters])

    def read(self, part) -> Iterator[pa.RecordBatch]:
        columns = self.table["attributes"]
        asked = sorted({a["ldap"] for c, a in columns.items() if c in self.wanted() and a["ldap"] != DN})
        c = Connection(self.source["url"], self.source.get("auth"))
        try:
            held: list[tuple] = []
            for entry in c.search(self.table["base_dn"], self.table.get("scope", "sub"), self.filter(), asked, self.hints.limit or 0):
                held.append(entry)
                if len(held) >= BATCH:
                    yield self._batch(held)
                    held = []
            if held:
                yield self._batch(held)
        finally:
            c.close()

    def _batch(self, entries: list[tuple]) -> pa.RecordBatch:
        out = {}
        for n in self.schema.names:
            a = self.table["attributes"][n]
            if a["ldap"] == DN:
                out[n] = [dn for dn, _ in entries]
                continue
            values = [e.get(a["ldap"].lower()) for _, e in entries]
            if a["type"] == "list":
                out[n] = values
            else:
                out[n] = [None if not v else types.from_text(", ".join(v), a["type"]) for v in values]
        return types.batch(out, self.schema)

    def describe(self) -> list[str]:
        return [*super().describe(), f"ldap filter: {self.filter()}"]


def ldap_scan(name: str, source: dict, table: dict) -> LdapScan:
    fields = [T.StructField(n, types.spark_type(table["attributes"][n]["type"] if table["attributes"][n]["type"] != "struct" else "string")) for n in sorted(table["attributes"])]
    return LdapScan(name, T.StructType(fields), source=source, table=table)
