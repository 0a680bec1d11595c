import random
import time

from polyscan.llm import html

LONG = "A sentence of the article that is long enough to be read. "


def page(body, nav="Home About Contact"):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{nav}</nav>{body}<footer>&copy; us</footer></body></html>"


def test_markup_rules():
    t = html.main_text
    assert t(None) == t("") == t("<html></html>") == ""
    assert t(page("<article><h1>One &amp; two</h1><p>a  b\n c<br>d<p>e <b>f</b>g</article>")) == "One & two\na b c d\ne fg"
    assert t(page('<div class="cookie-notice">We use</div><div id="sidebar">x</div><main><p>Body</p><div class="comments"><p>Nice!</p></div></main>')) == "Body"
    assert t(page('<form><input><p>Mail</p></form><aside>a</aside><div class="AdBox">b</div><p>Text &lt;p&gt; 1 &lt; 2</p><script>var a="</p>"; if (a<b) {}</script>')) == "Text <p> 1 < 2"
    assert t("<article><p>x</p></article><article class='comment'><p>y</p></article>") == "x"
    assert t("<article><header><h1>Head</h1></header><p>x</p><footer>by me</footer></article>") == "Head\nx"
    assert t("<p>Broken <b>markup <p>two<!-- never closed") == "Broken markup\ntwo"
    assert t("<ul><li><a href=x>Link one</a><li><a href=y>Link two</a></ul><p>Words with <a href=z>a link</a> inside.</p>") == "Words with a link inside."
    assert t('<div title="a > b"><p>quoted</p></div>') == "quoted"


def brute_lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        got = html.common(a, b)
        assert len(got) == brute_lcs(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_common_with_many_repeated_lines():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randrange(2) for _ in range(rng.randrange(60))] for _ in range(2))
        places = {v: [j for j in reversed(range(len(b))) if b[j] == v] for v in set(b)}
        for got in (html._by_rows(a, b, places) if a and b else [], html._by_places(a, places)) if a and b else ():
            assert len(got) == brute_lcs(a, b) and all(a[i] == b[j] for i, j in got)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    began = time.process_time()
    a, b = ([rng.randrange(3) for _ in range(8000)] for _ in range(2))
    assert len(html.common(a, b)) > 5000
    assert html.main_text("<span>x" * 20_000 + "</div></li>" * 20_000 + "<p>y" * 20_000).count("y") == 20_000
    assert time.process_time() - began < 20


def test_copies_are_passed_over_and_a_template_may_be_most_of_a_page(spark):
    top = "".join(f"<div>Item {k} of menu</div>" for k in range(12))

    def site(i, text):
        return f"<body>{top}<div>{text}</div><div>Imprint and rights</div></body>"

    same = "".join(f"</div><div>{LONG * 3}{k} of the copied story" for k in range(9))
    rows = [(i, f"https://a.example/{i}", site(i, f"{LONG}of story number {i}, short as it is")) for i in range(5)]
    rows += [(10 + i, f"https://c.example/a{i}", site(i, f"{LONG * 2}Copy number {i}" + same)) for i in range(6)]
    rows += [(30, "https://c.example/b", site(9, f"{LONG * 4}of its own"))]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = {r.page_id: r.text for r in html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i in range(5):
        assert got[i] == f"{LONG}of story number {i}, short as it is"
    for i in range(6):
        assert got[10 + i].startswith(f"{LONG * 2}Copy number {i}\n") and got[10 + i].count("copied story") == 9 and "Imprint" not in got[10 + i], i
    assert got[30] == f"{LONG * 4}of its own"


def test_differencing_removes_what_neighbours_share(spark):
    def site(i):
        own = "".join(f"<div>{LONG * 3}{k} of page {i}</div>" for k in range(4))
        return f"<body><div>Our great site</div><div>Weather today</div>{own}<div>All rights are ours</div></body>"

    rows = [(i, f"https://a.example/x/{i:03d}", site(i), 1) for i in range(40)]
    rows += [(100 + i, f"https://b.example/y/{i}", "<p>Our great site</p><p>A page of its own</p>", 2) for i in range(2)]  # copies of each other
    rows += [(200, None, None, 3), (201, "http://[bad", "<p>Lone</p>", 3), (0, "https://a.example/x/000", site(0), 1), (300, "https://c.example/", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    out = html.extract(spark, pages)
    got = {}
    for r in out.collect():
        got.setdefault(r.page_id, set()).add((r.text, r.n_chars))
    for i in range(40):
        want = "\n".join(f"{LONG * 3}{k} of page {i}" for k in range(4))
        assert got[i] == {(want, len(want))}, i
    assert got[100] == {("Our great site\nA page of its own", 32)}
    assert got[200] == {("", 0)} and got[201] == {("Lone", 4)} and got[300] == {("", 0)}
    assert out.count() == len(rows) and html.extract(spark, pages.limit(0)).count() == 0


def test_articles_keep_shared_lines(spark, sf_dir):
    for r in html.op4(spark, sf_dir).collect():
        assert r.n_chars == len(r.text) and "\n\n" not in r.text


def test_differencing_decides_in_articles_too(spark):
    def site(i):
        own = "".join(f"<p>{LONG * 2}{k} of page {i}</p>" for k in range(2))
        quoted = "<p>A passage quoted on two pages.</p>" if i in (3, 4) else ""
        return f"<body><article><p>Our great site</p>{own}{quoted}<p>Read us daily</p></article><p>Below the article {i}</p></body>"

    teaser = [(50 + i, f"https://t.example/{i}", f"<article><p>Teaser {i}</p></article><div>{LONG * 3}body {i}</div>") for i in range(3)]
    pages = spark.createDataFrame([(i, f"https://a.example/x/{i:03d}", site(i)) for i in range(9)] + teaser, "page_id long, url string, html string")
    for parts in (1, 4):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {r.page_id: r.text.split("\n") for r in html.extract(spark, pages).collect()}
        for i in range(9):
            quoted = ["A passage quoted on two pages."] if i in (3, 4) else []
            assert got[i] == [f"{LONG * 2}{k} of page {i}" for k in range(2)] + quoted + [f"Below the article {i}"], (i, parts)
        for i in range(3):
            assert got[50 + i] == [f"Teaser {i}", f"{LONG * 3}body {i}"]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_long_attribute_does_not_leak():
    assert html.main_text(f'<div data-x="{"a > b, " * 2000}"><p>Words</p></div>') == "Words"
    assert html.main_text('<div title="never > closed><p>Words</p></div>') == "closed>\nWords"
