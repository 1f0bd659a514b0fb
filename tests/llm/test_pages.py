"""Operators 1 and 3."""

import base64
import hashlib
import itertools
import random

import pytest

from loomgraph.llm import html_mincut, warc
from loomgraph.llm.shared import shared_path


def brute_cut(odds, edges):
    best = min(itertools.product((False, True), repeat=len(odds)), key=lambda s: (cost(odds, edges, s), sum(s)))
    return cost(odds, edges, best)


def cost(odds, edges, side):
    return sum(abs(o) for o, s in zip(odds, side) if (o > 0) != s and o) + sum(w for i, j, w in edges if side[i] != side[j])


def test_min_cut_is_minimal():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 9)
        odds = [round(r.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(i, j, round(r.uniform(0, 3), 2)) for i, j in itertools.combinations(range(n), 2) if r.random() < 0.5]
        assert cost(odds, edges, html_mincut.min_cut(odds, edges)) == pytest.approx(brute_cut(odds, edges))


PAGE = """<!doctype html><html><head><title>T &amp; x</title><style>p{}</style></head><body class="no-sidebar">
<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><!-- ad --><div class="ad">Buy <b>now</b>, it is cheap.</div>
<article><h1>Head&shy;line &lt;1&gt;</h1><p>First para<b>graph</b>,
   with   text.<p><b>Open bold<br><p>Second &eacute; one.</p><div class="cookie-notice">We use cookies, all right?</div><script>var t="</p>";</script>
<section id="comments"><p>I like this article, really, it is good.</p></section></article>
<aside><p>Other articles, that you may like, are here.</p></aside><form><p>Name, please:</p><input></form><footer>&copy; x, y.</footer></body></html>"""


def test_main_text():
    assert html_mincut.main_text(PAGE) == "Head\xadline <1> First paragraph, with text. Open bold Second é one."
    assert html_mincut.main_text(None) == html_mincut.main_text("") == html_mincut.main_text("<p>") == ""
    assert html_mincut.main_text("<article><p>Cut o&am") == "Cut o&am"
    assert html_mincut.main_text("<article><p>Cut <b") == "Cut"
    long = "<article>" + "<p>word, word. </p>" * 20000
    assert html_mincut.main_text(long) == " ".join(["word, word."] * 20000)


def test_extract_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    n = len(html_mincut.main_text(PAGE))
    got = html_mincut.extract(pages).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", n), (1, "u", n), (2, None, 0), (None, "v", 0)]
    assert html_mincut.extract(pages.limit(0)).count() == 0
    weights = html_mincut.fit(pages)  # two pages: near the prior weights
    assert max(abs(a - b) for a, b in zip(weights, html_mincut.PRIOR)) < 1
    assert html_mincut.fit(pages.limit(0)) == html_mincut.PRIOR
    assert html_mincut.calibrate(pages, weights) == html_mincut.calibrate(pages.limit(0), weights) == html_mincut.SMOOTH


def test_what_is_shown_counts():
    page = "<main><p>Let <math><mi>x</mi><annotation>TeX</annotation></math> be one, an <object>old</object> thing.</p><noscript>Turn it on, please.</noscript><svg><text>icon</text></svg></main>"
    assert html_mincut.main_text(page) == "Let x be one, an old thing."


def test_states_of_a_page_are_no_names():
    page = '<div class="page has-comments with-sidebar"><p>A text of some words, and more of them.</p></div>'
    assert html_mincut.main_text(page) == "A text of some words, and more of them."


@pytest.mark.parametrize(
    "page, text",
    [
        # no semantic markup at all: link lists, short labels and copyright lines go
        ('<div><a href="/a">Home</a></div><div><a href="/b">News</a></div><div><h2>A title of a text</h2><p>The first sentence, with a comma, is here. It goes on.</p><p>And then another one, as long as the first.</p></div><div>© 2020 x</div>', "A title of a text The first sentence, with a comma, is here. It goes on. And then another one, as long as the first."),
        # names instead of elements
        ('<div class="top-menu">One | Two</div><div id="main-content"><p>Here it says, at length, what is the matter.</p><p>Short one</p><p>It goes on, and on, with more words to read.</p></div><div class="comment-list"><p>I do not think so, as I said before, and will again.</p></div>', "Here it says, at length, what is the matter. Short one It goes on, and on, with more words to read."),
        # a list in the text stays, a list of links beside it goes
        ("<article><p>What is needed, in this order:</p><ul><li>flour and water</li><li>salt</li></ul><p>Mix it all, then wait for an hour.</p></article><aside><ul><li><a href=x>More of it</a></li></ul></aside>", "What is needed, in this order: flour and water salt Mix it all, then wait for an hour."),
        ("<article><header><h1>The title</h1><p>By someone</p></header><p>The text, as it stands, has one paragraph.</p><footer>Tags: a, b, c.</footer></article>", "The title The text, as it stands, has one paragraph."),
    ],
    ids=["nothing named", "names", "lists", "header"],
)
def test_main_text_of_other_pages(page, text):
    assert html_mincut.main_text(page) == text


def test_the_cut_decides():
    """Blocks that by themselves look like boilerplate are content among content, and the other way round."""
    page = "<div>" + "".join(f"<p>{t}</p>" for t in ("A long first paragraph, of many words, that says what it is about.", "two words", "A long last paragraph, of many words, that says how it ends.")) + "</div>"
    blocks, side = html_mincut.label(page)
    odds = html_mincut.log_odds(blocks, html_mincut.PRIOR)
    assert odds[1] < 0 and side == [True, True, True]
    page = '<ul><li><a href="/a">Home</a></li><li>And more, here.</li><li><a href="/b">News</a></li><li><a href="/c">Jobs</a></li></ul>'
    blocks, side = html_mincut.label(page)
    assert html_mincut.log_odds(blocks, html_mincut.PRIOR)[1] > 0 and not any(side)


def test_fit_stays_finite_and_learns_shape():
    page = "<nav><ul>" + "<li><a href=x>Go</a></li>" * 6 + "</ul></nav><article>" + "<p>Some words, and some more, of a text. And then some.</p>" * 6 + "</article><footer>© us, 2020</footer>"
    weights = html_mincut.fit_weights(html_mincut.fit_rows(html_mincut.blocks_of(page)) * 200)
    assert max(map(abs, weights)) < 15
    bare = page.replace("<nav>", "<div>").replace("</nav>", "</div>").replace("article>", "div>").replace("footer>", "div>")
    assert html_mincut.main_text(bare, weights) == " ".join(["Some words, and some more, of a text. And then some."] * 6)


def bare_page(r):
    """An article with headings, remarks of two words and lists between its paragraphs, beside link lists that hold a sentence or two."""
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(6, 14))) + r.choice([".", ", " + word() + "."])
    paragraph = lambda: f"<p>{' '.join(sentence() for _ in range(r.randint(2, 4)))}</p>"
    short = lambda: f"<p>{word()} {word()}</p>"
    article = "".join(r.choice([paragraph, paragraph, paragraph, short])() for _ in range(r.randint(6, 14)))
    link = lambda: f"<li><a href=/{word()}>{word()}</a></li>"
    said = lambda: f"<li>{sentence()}</li>"
    menu = lambda: "<ul>" + "".join(said() if r.random() < 0.15 else link() for _ in range(r.randint(5, 12))) + "</ul>"
    return f"<nav>{menu()}</nav><article><h1>{word()} {word()}</h1>{article}</article><aside>{menu()}</aside><footer>© {word()}</footer>"


def test_the_cut_betters_pages_that_name_nothing(spark):
    """On pages read without their containers' names, the cut errs clearly less than each block's own odds."""
    r = random.Random(11)
    pages = [bare_page(r) for _ in range(120)]
    frame = spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    weights = html_mincut.fit(frame)
    smooth = html_mincut.calibrate(frame, weights)
    other = [html_mincut.blocks_of(bare_page(r)) for _ in range(120)]
    alone, cut = (sum(x) for x in zip(*(html_mincut.bare_errors(b, weights, (0.0, smooth)) for b in other)))
    assert smooth > 0 and cut < 0.6 * alone


def cpu_ratio(run, small, large):
    """CPU time of the large input against that of the small one, the best of three each."""
    import time

    def took(x):
        times = []
        for _ in range(3):
            began = time.process_time()
            run(x)
            times.append(time.process_time() - began)
        return max(min(times), 1e-3)

    run(small)
    return took(large) / took(small)


LONG_PAGES = {
    "open": lambda n: "<div>a b" * n,
    "nested": lambda n: "<div>" * n + "<p>x y, z.</p>" + "</div>" * n,
    "unmatched": lambda n: "<div>" * n + "</x>" * n,
    "wide": lambda n: "<p>word</p>" * n,
    "pairs": lambda n: "<div><p>word, word</p></div>" * n,
    "links across blocks": lambda n: "<a><div>" + "<i>" * n + "</a>" * n,
    "items over open links": lambda n: "<ul>" + "<a>" * n + "<li>x</li>" * n,
    "open inline elements": lambda n: "<ul>" + "<i>" * n + "<li></li>" * n,
    "crossed": lambda n: "<b><i>" * n + "</b></i>" * n,
}


@pytest.mark.parametrize("name", LONG_PAGES)
def test_many_elements_take_linear_time(name):
    page = LONG_PAGES[name]
    assert cpu_ratio(html_mincut.main_text, page(4000), page(32_000)) < 24  # 8 if linear, 64 if quadratic


def test_a_page_of_a_megabyte(spark):
    page = "<a><div>" + "<i>" * 150_000 + "</a>" * 150_000 + "<article><p>It says, at last, what it is about, and then ends.</p></article>"
    assert len(page) > 1_000_000
    assert html_mincut.main_text(page) == "It says, at last, what it is about, and then ends."


def test_flow_of_many_nodes():
    import time

    r = random.Random(5)
    n = 20_000
    odds = [r.uniform(-1, 1) for _ in range(n)]
    edges = [(k - 1, k, r.uniform(0, 2)) for k in range(1, n)] + [(k - 7, k, r.uniform(0, 1)) for k in range(7, n, 5)]
    began = time.process_time()
    side = html_mincut.min_cut(odds, edges)
    assert time.process_time() - began < 30
    # no single node nor pair of neighbours betters the cut
    near = [[] for _ in range(n)]
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
    for i in range(n):
        own = (odds[i] if side[i] else -odds[i]) - sum(w if side[i] != side[j] else -w for j, w in near[i])
        assert own >= -1e-9


@pytest.mark.parametrize("minimum", [0, 5])
def test_warc_round_trip(spark, minimum):
    htmls = ["same text", "same text", "other é", None, "", "same text", "x" * 300_000, "abc", "abc"]
    ids = [5, 9, 2, 7, 3, None, 11, 4, 6]
    rows = [(i, None if k == 2 else "http://a b/\n", h, "z") for k, (i, h) in enumerate(zip(ids, htmls))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    folder = shared_path(spark, "w")
    files = warc.write_pages(pages, folder, min_revisit_bytes=minimum)
    got = {(r.page_id, r.payload_digest): r for r in warc.read_archives(spark, folder, "full", split_bytes=200).collect()}
    assert len(got) == len(ids) == sum(n for _, n in files)
    for i, h in zip(ids, htmls):
        raw = (h or "").encode()
        r = got[i, base64.b32encode(hashlib.sha1(raw).digest()).decode()]
        twins = [j for j, g in zip(ids, htmls) if (g or "") == (h or "") and j is not None]
        first = max(twins) if len(raw) >= minimum else i
        assert (r.payload_bytes, r.http_status) == (len(raw), 200)
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert r.payload == (bytearray(raw) if first == i else None)
    few = warc.read_archives(spark, folder).where("record_type = 'revisit' AND page_id = 3")
    assert few.count() == (1 if minimum == 0 else 0)
    assert warc.write_pages(pages.limit(0), shared_path(spark, "w")) == []


def test_reader_skips_what_filters_reject(tmp_path, monkeypatch):
    record = lambda kind, k: warc._member(warc._record(kind, k, "u", b"payload" * 50_000, warc.digest_of(b"payload" * 50_000), 1, "d"), 1)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(record("response" if k == 3 else "revisit", k) for k in range(6)))
    reader = warc.WarcReader({"path": str(tmp_path), "payload": "full"})

    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response")])) == []
    seen = []
    monkeypatch.setattr(warc, "digest_of", lambda p: seen.append(len(p)) or base64.b32encode(hashlib.sha1(p).digest()).decode())
    (batch,) = [b for p in reader.partitions() for b in reader.read(p)]
    assert batch.column("page_id").to_pylist() == [3] and seen == [350_000]


def test_record_types_are_pushed_into_the_scans(spark):
    pages = spark.createDataFrame([(k, "u", f"text {k // 2}") for k in range(20)], "page_id long, url string, html string")
    folder = shared_path(spark, "w")
    files = warc.write_pages(pages, folder)
    records = warc.verified_records(spark, folder)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan warc") == 2 and "Filter " not in plan
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in records.collect()) == sorted((k, "response" if k % 2 else "revisit", None if k % 2 else k + 1) for k in range(20))
    # a file that no task has answered for is not read
    with open(files[0][0].removeprefix("file:"), "rb") as a, open(f"{folder.removeprefix('file:')}/part-lost.warc.gz", "wb") as b:
        b.write(a.read())
    assert warc.read_archives(spark, folder).count() == 20
    empty = shared_path(spark, "w")
    warc.write_pages(pages.limit(0), empty)
    assert warc.verified_records(spark, empty).count() == 0
