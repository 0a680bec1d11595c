"""Main text of web pages by nearest-URL page differencing.

A page is cut into blocks of text, its lines. Pages are ordered by host and URL path, and each page is aligned with
its neighbours of the same host, two on each side that are not its copies, by the longest common subsequence of their lines: shared lines are the
site's template and are deleted. What a site fills in anew for each page (menus of other links, rotating adverts)
no neighbour shares, so the markup also counts: elements that are navigation, headers, footers, sidebars, forms, notices,
adverts or comments by name, role or class are dropped, as are blocks of links outside an article.

Two departures keep articles whole. A line inside an explicit article (article, main, itemprop articleBody) is deleted
only if two neighbours share it, since quoted passages recur in articles of one host; and a neighbour that
shares most of a page in lines as long as the rest is a copy of the page, not its template: it is not subtracted, and the
next page takes its place.

The neighbour is found on short rows of line hashes, range-partitioned over all hosts, so that a host of a third of all
pages is spread over tasks; the first and last two rows of every partition meet in a second small step.

Defined results: null or empty html and pages without main text give an empty string and 0; a null or
malformed url belongs to host '' and is handled like any; repeated rows give equal results; other columns
are not read. Pages of any length are taken whole; equal urls are in the order of a hash of the row; an empty table gives none.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyscan.llm.common import shared_table

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTAINERS = {"html", "body", "head", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "figure", "blockquote", "details", "dialog", "menu", "svg", "object", "select", "button", "center", "fieldset", "span", "td", "li", "p", "search"}
DROPPED = {"head", "nav", "footer", "aside", "form", "dialog", "menu", "svg", "object", "select", "button", "search", "header"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "status"}
#: Parts of class and id names that mark what is not the article.
MARKS = {"ad", "ads", "adbox", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "announcement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "feedback", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "privacy", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "trending", "widget", "widgets"}
TALK = {"comment", "comments", "commentlist", "reply", "replies", "respond", "disqus"}
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A neighbour that shares this part of the page's own text is its copy.
COPY = 0.6


class Block:
    __slots__ = ("text", "dropped", "main", "linked")

    def __init__(self, text, dropped, main, linked):
        self.text, self.dropped, self.main, self.linked = text, dropped, main, linked


def _kind(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """(dropped, main) of an element; inside: it stands in an article."""
    dropped = tag in DROPPED and not (tag == "header" and inside)
    main = tag in ("article", "main")
    if "=" not in attributes and "hidden" not in attributes:
        return dropped, main
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    names = {x.lower() for x in NAME.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    if role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        dropped = True
    if role == "main" or found.get("itemprop", "").lower() == "articlebody":
        main = True
    if tag not in ("html", "body") and names & (TALK if main else MARKS - {"header"} if inside else MARKS):
        dropped = True
    return dropped, main and not dropped


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, each with what the markup says about it."""
    out: list[Block] = []
    page = page or ""
    last_quote = page.rfind('"')
    stack: list[tuple[str, bool, bool]] = []
    count: Counter[str] = Counter()  # of open elements by name
    dropped = main = False
    buffer: list[str] = []
    linked = plain = links = 0
    at = 0

    def flush():
        nonlocal linked, plain
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                out.append(Block(text, dropped, main, linked > plain))
            buffer.clear()
        linked = plain = 0

    def close(k):
        count.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def take(text):
        nonlocal linked, plain
        buffer.append(text)
        if links:
            linked += len(text)
        else:
            plain += len(text.strip())

    while True:
        found = TAG.search(page, at)
        if found is None:
            if at < len(page):
                take(page[at:])
            break
        if found.start() > at:
            take(page[at : found.start()])
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), found.group(1) == "/", found.group(3)
        if not closing and attributes.count('"') % 2:  # a '>' inside quotes
            end = page.find(">", page.find('"', at) + 1) if at <= last_quote else -1
            if end >= 0:
                attributes += ">" + page[at:end]
                at = end + 1
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag not in ("noscript",):
                flush()
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag == "br":
            take(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag not in CONTAINERS or tag in VOID or attributes.endswith("/"):
            continue
        if closing:
            if not count[tag]:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag == "span" and (stack[k][1] != (stack[k - 1][1] if k else False)):
                        flush()
                    close(k)
                    break
        else:
            if tag in ("p", "li", "td") and count[tag]:  # an open one ends here, unless a list or table stands between
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if stack[k][0] not in ("span", "p"):
                        break
                dropped, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            own, article = _kind(tag, attributes, main)
            if own and not dropped and tag == "span":
                flush()
            stack.append((tag, dropped or own, (main or article) and not own))
            count[tag] += 1
        dropped, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    flush()
    return out


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; ('', the text) if it has none."""
    try:
        u = urlsplit(url or "")
        return (u.hostname or "").removeprefix("www."), u.path or "/"
    except ValueError:
        return "", url or ""


def common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of a and b as pairs of places.

    By Hunt and Szymanski, whose steps are the places where a line of a is in b; by rows of bits, each line of a against all
    of b at once, where repeated lines make these more than the rows.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict = {}
    for j in range(len(y) - 1, -1, -1):
        places.setdefault(y[j], []).append(j)
    steps = sum(len(places.get(v, ())) for v in x)
    middle = _by_rows(x, y, places) if steps > 8 * (len(x) + len(y)) else _by_places(x, places)
    return [(i, i) for i in range(head)] + [(i + head, j + head) for i, j in middle] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _by_places(x: list, places: dict) -> list[tuple[int, int]]:
    ends, last = [], []
    for i, v in enumerate(x):
        for j in places.get(v, ()):
            k = bisect_left(ends, j)
            link = (i, j, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[k], last[k] = j, link
    out, link = [], last[-1] if last else None
    while link:
        out.append((link[0], link[1]))
        link = link[2]
    return out[::-1]


def _by_rows(x: list, y: list, places: dict) -> list[tuple[int, int]]:
    """Bit j of a row is 0 where the subsequence grows with y[j]."""
    masks = {v: sum(1 << j for j in at) if len(at) < 64 else int("".join("1" if w == v else "0" for w in reversed(y)), 2) for v, at in places.items()}
    full = (1 << len(y)) - 1
    row, rows = full, []
    for v in x:
        met = row & masks.get(v, 0)
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    out, i, j = [], len(x), len(y)
    bits = [format(r, f"0{len(y)}b")[::-1] for r in rows] if len(x) * len(y) < 1 << 26 else None
    zero = (lambda i, j: bits[i][j] == "0") if bits else (lambda i, j: not rows[i] >> j & 1)
    while i and j:
        if not zero(i - 1, j - 1):
            j -= 1
        elif i > 1 and zero(i - 2, j - 1):
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def shared_lines(a: dict, b: dict) -> tuple[list[int], list[int], bool]:
    """Places of the template's lines in two neighbouring pages, none where one is a copy of the other, and whether one is.

    A page is {"lines": hashes, "sizes": characters, negative where the markup drops the line anyway}. Copies share most of a page, and
    in lines as long as those that they don't share; a template may be most of a page too, but its lines are short beside an article's.
    """
    pairs = common(a["lines"], b["lines"])
    out = []
    for side, page in ((0, a), (1, b)):
        kept = [s for s in page["sizes"] if s > 0]
        shared = [page["sizes"][p[side]] for p in pairs if page["sizes"][p[side]] > 0]
        own, most = sum(kept), sum(shared)
        rest = (own - most) / max(1, len(kept) - len(shared))
        if own and most >= COPY * own and most / len(shared) >= rest / 2 and len(page["lines"]) > 1:
            return [], [], True
        out.append([p[side] for p in pairs if page["sizes"][p[side]] > 0])
    return out[0], out[1], False


LINES = "host string, path string, key long, lines array<long>, sizes array<int>"
STEP = "pid int, edge int, host string, key long, other long, lines array<long>, sizes array<int>, gone array<int>"
_STEP = pa.schema([("pid", pa.int32()), ("edge", pa.int32()), ("host", pa.string()), ("key", pa.int64()), ("other", pa.int64()), ("lines", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("gone", pa.list_(pa.int32()))])


def _lines(batches):
    for batch in batches:
        keys, urls, pages = (batch.column(i).to_pylist() for i in range(3))
        places, found = [place(u) for u in urls], [blocks(p) for p in pages]
        hashes = [np.array([xxhash.xxh64_intdigest(b.text.encode("utf-8", "surrogatepass")) for b in bs], np.uint64).view(np.int64) for bs in found]
        sizes = [np.array([-len(b.text) if b.dropped else len(b.text) for b in bs], np.int32) for bs in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in places], pa.string()), pa.array([p[1] for p in places], pa.string()), pa.array(keys, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))],
            ["host", "path", "key", "lines", "sizes"],
        )


def _neighbours(batches):
    """Rows in order -> lines to delete (edge 0), and the first (1, 2) and last (3, 4) two rows of the partition.

    A page is aligned with the two nearest before it that are not copies of it or of each other. Copies at the head of a host wait for the
    first page that is none.
    """
    pid, before, waiting, ends, n = TaskContext.get().partitionId(), [], [], [], 0

    def row(page, edge, gone=(), other=None):
        return {"pid": pid, "edge": edge, "host": page["host"], "key": page["key"], "other": other, "lines": page["lines"] if edge else [], "sizes": page["sizes"] if edge else [], "gone": list(gone)}

    for batch in batches:
        out = []
        for page in batch.to_pylist():
            if n < 2:
                out.append(row(page, n + 1))
            if before and before[-1]["host"] != page["host"]:
                before, waiting = [], []
            copy_of = None
            for k, near in enumerate(before):
                a, b, copy = shared_lines(near, page)
                copy_of = k if copy else copy_of
                out += [row(p, 0, g, q["key"]) for p, q, g in ((near, page, a), (page, near, b)) if g]
            if copy_of is None:
                for old in waiting:
                    a, _, copy = shared_lines(old, page)
                    out += [row(old, 0, a, page["key"])] if a else []
                waiting = []
            elif len(before) == 1:
                waiting.append(before[0])
            if copy_of is not None:
                del before[copy_of]
            before = [*before[-1:], page]
            ends = [*ends[-1:], page]
            n += 1
        if out:
            yield pa.RecordBatch.from_pylist(out, _STEP)
    last = ends[-(n - 2) :] if n > 2 else []
    if last:
        yield pa.RecordBatch.from_pylist([row(page, 5 - len(last) + k) for k, page in enumerate(last)], _STEP)


_GONE = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("gone", pa.list_(pa.int32()))])


def _edges(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            a, b = ({"lines": r[f"lines{k}"], "sizes": r[f"sizes{k}"]} for k in (1, 2))
            keys = r["key1"], r["key2"]
            out += [{"key": k, "other": o, "gone": g} for k, o, g in zip(keys, keys[::-1], shared_lines(a, b)[:2]) if g]
        yield pa.RecordBatch.from_pylist(out, _GONE)


def template_lines(spark: SparkSession, keyed: DataFrame, url: str, page: str) -> DataFrame:
    """keyed (__key, url, page) -> (__key, gone, sure): the places of the lines that one and that several near pages of the host share."""
    lines = shared_table(spark, keyed.select("__key", url, page).mapInArrow(_lines, LINES), "lines")  # else the range partition parses twice
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = lines.repartitionByRange(parts, "host", "path", "key").sortWithinPartitions("host", "path", "key").mapInArrow(_neighbours, STEP)
    steps = shared_table(spark, steps, "neighbours")
    # Four rows a partition at most: the last two of one and the first two of the next
    order = Window.orderBy("pid", "edge")
    ends = steps.where("edge > 0")
    gone = steps.where("edge = 0").select("key", "other", "gone")
    for ahead in (1, 2):
        pairs = ends.select("pid", "host", F.col("key").alias("key1"), F.col("lines").alias("lines1"), F.col("sizes").alias("sizes1"), *[F.lead(c, ahead).over(order).alias(n) for c, n in (("pid", "p2"), ("host", "h2"), ("key", "key2"), ("lines", "lines2"), ("sizes", "sizes2"))])
        pairs = pairs.where("p2 > pid AND host = h2").select("key1", "lines1", "sizes1", "key2", "lines2", "sizes2")
        gone = gone.unionByName(pairs.mapInArrow(_edges, "key long, other long, gone array<int>"))
    single = gone.select(F.col("key").alias("__key"), "other", F.explode("gone").alias("g")).distinct().groupBy("__key", "g").agg(F.count("*").alias("n"))
    return single.groupBy("__key").agg(F.collect_list("g").alias("gone"), F.collect_list(F.when(F.col("n") > 1, F.col("g"))).alias("sure"))


def main_text(page: str | None, gone=(), sure=()) -> str:
    """The page's main text: in an explicit article all lines but those in sure, elsewhere all but those in gone and blocks of links."""
    gone, sure = set(gone), set(sure)
    kept = [b for k, b in enumerate(blocks(page)) if not b.dropped and (k not in sure if b.main else k not in gone and not b.linked)]
    return "\n".join(b.text for b in kept)


def extract(spark: SparkSession, pages: DataFrame, url: str = "url", page: str = "html", keep=("page_id", "url")) -> DataFrame:
    """The kept columns with text and n_chars."""
    chosen = pages.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(url).alias("__url"), F.col(page).alias("__html"))
    keyed = chosen.withColumn("__key", F.xxhash64(*chosen.columns))
    gone = template_lines(spark, keyed, "__url", "__html")
    joined = keyed.join(gone, "__key", "left").select(*[f"__k{i}" for i in range(len(keep))], "__html", "gone", "sure")

    def run(batches):
        for batch in batches:
            n = len(keep)
            texts = [main_text(h, g or (), sure or ()) for h, g, sure in zip(*(batch.column(n + k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {joined.schema[f'__k{i}'].dataType.simpleString()}" for i, c in enumerate(keep))
    return joined.mapInArrow(run, f"{kinds}, text string, n_chars long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
