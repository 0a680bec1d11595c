"""Excel workbooks (.xlsx) with the standard library: a sheet as a table of text columns, and a small writer."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import types as T

from polyscan import types
from polyscan.errors import DecodeError, UnsupportedSource
from polyscan.filters import SimpleFilter, matches
from polyscan.sources.base import BATCH, Scan

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats that the standard fixes as dates, times or both.
BUILT_IN_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_DATE_PART = re.compile(r"[dmyhs]", re.I)
_QUIET = re.compile(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', re.I)


def number_text(x: float) -> str:
    """A number as short text: no point for a whole one."""
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def serial_text(x: float, from_1904: bool) -> str:
    """A serial date: a day, a day and time, or below one day a time."""
    base = dt.datetime(1904, 1, 1) if from_1904 else dt.datetime(1899, 12, 30)
    at = base + dt.timedelta(microseconds=round(x * 86_400_000) * 1000)
    if 0 <= x < 1:
        return at.strftime("%H:%M:%S")
    return at.strftime("%Y-%m-%d") if x == int(x) else at.strftime("%Y-%m-%d %H:%M:%S")


class Workbook:
    def __init__(self, path: str):
        if path.lower().endswith(".xls"):
            raise UnsupportedSource(f"{path}: the binary .xls format can't be read; save it as .xlsx")
        try:
            self.zip = zipfile.ZipFile(path)
        except zipfile.BadZipFile as e:
            raise DecodeError(f"{path} is no .xlsx workbook") from e
        book = self._xml("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        target = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {s.get("name"): target(links[s.get(f"{LINK}id")]) for s in book.iter(f"{MAIN}sheet")}
        props = book.find(f"{MAIN}workbookPr")
        self.from_1904 = props is not None and props.get("date1904") in ("1", "true")
        names = set(self.zip.namelist())
        self.shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in self._xml("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = self._xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): bool(_DATE_PART.search(_QUIET.sub("", f.get("formatCode", "")))) for f in styles.iter(f"{MAIN}numFmt")}
            formats = styles.find(f"{MAIN}cellXfs")
            for x in formats if formats is not None else ():
                n = int(x.get("numFmtId", "0"))
                self.dates.append(own.get(n, n in BUILT_IN_DATES))

    def _xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _cell(self, c) -> str | None:
        kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        if kind == "b":
            return "true" if v.text == "1" else "false"
        if kind in ("str", "d"):
            return v.text
        if kind == "e":
            return None
        x, style = float(v.text), int(c.get("s", "0"))
        return serial_text(x, self.from_1904) if style < len(self.dates) and self.dates[style] else number_text(x)

    def rows(self, sheet: str | None) -> Iterator[list[str | None]]:
        """Rows of cells as text, from the first used column and row on."""
        name = sheet if sheet is not None else next(iter(self.sheets), None)
        if name not in self.sheets:
            raise DecodeError(f"the workbook has no sheet `{name}`; it has {', '.join(self.sheets)}")
        with self.zip.open(self.sheets[name]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                out: list[str | None] = []
                for c in row.iter(f"{MAIN}c"):
                    at = len(out)
                    if c.get("r"):
                        at = 0
                        for ch in re.match(r"[A-Z]+", c.get("r"))[0]:
                            at = at * 26 + ord(ch) - 64
                        at -= 1
                    out += [None] * (at - len(out))
                    out.append(self._cell(c))
                row.clear()
                yield out


def sheet_schema(table: dict[str, Any]) -> T.StructType:
    rows = Workbook(table["path"]).rows(table.get("sheet"))
    first = next(rows, [])
    if not table.get("has_header", True):
        return T.StructType([T.StructField(f"column_{k}", T.StringType()) for k in range(len(first))])
    names, seen = [], {}
    for k, n in enumerate(first):
        n = n if n not in (None, "") else f"column_{k}"
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


@dataclass
class ExcelScan(Scan):
    """All columns are text and compare as text; numeric work needs a CAST."""

    table: dict[str, Any] = field(default_factory=dict)

    kind = "excel"

    def accepts(self, f: SimpleFilter) -> bool:
        return f.op in ("is_null", "is_not_null") or isinstance(f.value, str) or (f.op == "in" and all(isinstance(v, str) for v in f.value))

    def exact(self, f: SimpleFilter) -> bool:
        """The reader itself compares, with SQL's unknown: equality needs no second look."""
        return f.op in ("=", "in", "is_null", "is_not_null")

    def read(self, part) -> Iterator[pa.RecordBatch]:
        rows = Workbook(self.table["path"]).rows(self.table.get("sheet"))
        if self.table.get("has_header", True):
            next(rows, None)
        names = self.schema.names
        tests = [(names.index(f.column), f) for f in self.filters]
        held: list[list] = []
        for row in rows:
            row = (row + [None] * len(names))[: len(names)]
            if any(x is not None for x in row) and all(matches(f, row[k]) for k, f in tests):
                held.append(row)
            if len(held) >= BATCH:
                yield types.batch(dict(zip(names, map(list, zip(*held)))), self.schema)
                held = []
        if held:
            yield types.batch(dict(zip(names, map(list, zip(*held)))), self.schema)


def excel_scan(name: str, source: dict, table: dict) -> ExcelScan:
    return ExcelScan(name, sheet_schema(table), table=table)


def write_workbook(path: str, sheets: dict[str, list[list[Any]]]) -> None:
    """A workbook of rows of None, bool, numbers, dates and text."""

    def cell(at: str, v: Any) -> str:
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (dt.date, dt.datetime)):
            d = v if isinstance(v, dt.datetime) else dt.datetime(v.year, v.month, v.day)
            n = (d - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)
            return f'<c r="{at}" s="{2 if isinstance(v, dt.datetime) else 1}"><v>{n!r}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    def column(k: int) -> str:
        out = ""
        k += 1
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    main = MAIN.strip("{}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{LINK.strip("{}")}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{LINK.strip("{}")}"><sheets>' + "".join(f'<sheet name="{escape(s)}" sheetId="{k + 1}" r:id="r{k + 1}"/>' for k, s in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k + 1}" Type="x" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(n)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        for k, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{i + 1}">' + "".join(cell(f"{column(j)}{i + 1}", v) for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
