import html
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripwire.llm import html_wrappers as H
from tripwire.llm.queries import QUERIES

from .conftest import SF


def alone(page):
    """Extraction with a wrapper inferred from the page itself."""
    return H.extract(page, H.judged(H.wrapper_of(page), 1))


def brute(page):
    """The article element of the test pages, cut out by hand."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    text = re.sub(r"</?b>|<b\Z", "", m[1]) if m else ""
    return " ".join(html.unescape(re.sub(r"<[a-z/][^>]*(>|\Z)", " ", text)).split())


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_whole_table(spark, limit):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = H.main_text(pages, broadcast_bytes=limit).collect()
    assert len(rows) == pages.count()
    for r in rows:
        assert r.main_text == brute(r.html)


def test_query_columns(spark):
    rows = QUERIES["op3_html_wrappers"](spark, SF).collect()
    pages = pd.read_parquet(f"{SF}/pages.parquet").set_index("page_id")
    assert rows[0].__fields__ == ["page_id", "url", "text", "n_chars"] and len(rows) == len(pages)
    assert all(r.n_chars == len(r.text) and r.url == pages.url[r.page_id] for r in rows)


def test_tokens_and_blocks():
    assert H.parse("<p>a<b>b</b> c<br>d<p>e &amp; f") == [
        ["e", "p", [["t", "T", "ab c d", 6]]], ["e", "p", [["t", "T", "e & f", 5]]]]
    assert H.parse("<ul><li>x<ul><li>y</ul><li>z</ul>t") == [
        ["e", "ul", [["e", "li", [["t", "T", "x", 1], ["e", "ul", [["e", "li", [["t", "T", "y", 1]]]]]]],
                     ["e", "li", [["t", "T", "z", 1]]]]], ["t", "T", "t", 1]]
    assert H.parse("<!-- <p>no</p> --><script>var t='<p>';</script><style>p{}</style><p>a<!-- x") == [["e", "p", [["t", "T", "a", 1]]]]
    assert H.parse("<li><a href='>'>x</a>") == [["e", "li", [["t", "L", "x", 1]]]]
    assert H.parse("a < b &lt;p&gt; &#233;&nbsp;&copy") == [["t", "T", "a < b <p> é ©", 13]]
    assert H.parse("</p></div>x<div class='b a9' id=a10 hidden>") == [["t", "T", "x", 1], ["e", "div @hidden .a0 .b", []]]
    assert H.parse(None) == H.parse("") == []


def wrap(*pages):
    w = H.wrapper_of(pages[0])
    for p in pages[1:]:
        w = H.align(w, H.wrapper_of(p))
    return w


def test_slots_optionals_and_repeats():
    assert H.expression(wrap("<p>a</p>", "<p>a</p>")) == "<p>a</p>"
    assert H.expression(wrap("<p>a</p>", "<p>b</p>")) == "<p>#text</p>"
    assert H.expression(wrap("<ul><li>a<li>b</ul>", "<ul><li>c</ul>")) == "<ul>(<li>#text</li>)+</ul>"
    assert H.expression(wrap("<ul><li>c</ul>", "<ul><li>a<li>b</ul>")) == "<ul>(<li>#text</li>)+</ul>"
    assert H.expression(wrap("<div><h1>t</h1><p>x</p></div>", "<div><p>x</p></div>")) == "<div>(<h1>t</h1>)?<p>x</p></div>"
    assert H.expression(wrap("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>e<dd>f</dl>")) == "<dl>(<dt>#text</dt><dd>#text</dd>)+</dl>"


def random_page(rnd, depth=3):
    def element(d):
        name = rnd.choice(["div", "section", "ul", "h2", "p"])
        if name == "ul":
            return "<ul>" + "".join(f"<li>{rnd.choice('abc')}" for _ in range(rnd.randint(1, 4))) + "</ul>"
        inner = rnd.choice("xyz") if d == 0 or name in ("h2", "p") else "".join(element(d - 1) for _ in range(rnd.randint(0, 4)))
        return f"<{name}{rnd.choice(['', ' class=k' + rnd.choice('ab')])}>{inner}</{name}>"

    return "".join(element(depth) for _ in range(rnd.randint(1, 3)))


def test_a_wrapper_generates_all_its_pages():
    rnd = random.Random(11)
    for _ in range(60):
        pages = [random_page(rnd) for _ in range(rnd.randint(1, 7))]
        w = wrap(*pages)
        assert all(H.accepts(w, H.parse(p)) for p in pages)
        half = H.align(wrap(*pages[:3]), wrap(*pages[3:])) if len(pages) > 3 else w
        assert all(H.accepts(half, H.parse(p)) for p in pages)


def test_wrappers_stay_bounded():
    rnd = random.Random(12)
    names = "p ul h2 h3 blockquote table pre figure".split()
    w = None
    for _ in range(200):
        page = "<article>" + "".join(f"<{n}>{rnd.random()}</{n}>" for n in rnd.choices(names, k=rnd.randint(1, 60))) + "</article>"
        w = H.wrapper_of(page) if w is None else H.align(w, H.wrapper_of(page))
        assert H.accepts(w, H.parse(page))
    assert len(H.slots_of(w)) <= 2 * H.MANY
    w = wrap(*[f"<div><i></i><p class='q{chr(97 + i % 26)}{chr(97 + i // 26)}'>{i}</p></div>" for i in range(300)])
    assert len(H.slots_of(w)) <= 2 * H.KEYS


BOILER = [
    '<div id="cookie-notice">accept</div><header><a href="/">home</a><h1>site</h1></header>{}<footer>f</footer>',
    "<nav><a href=x>one</a></nav><aside>more</aside>{}<form>mail <input><button>go</button></form>",
    '<div class="adBox ad">buy</div><ul class="main-menu"><li>m</ul>{}<div class="sidebar_right">s</div><section id="comments"><article class="comment">nice</article></section>',
    '<div role="navigation">n</div><div hidden>h</div><div style="display: none">d</div>{}<div class="related-posts">r</div>',
]


@pytest.mark.parametrize("frame", BOILER)
@pytest.mark.parametrize("body", [
    "<article><h1>Title</h1><p>One <a href=x>two</a> &eacute;.</p><p>Three</article>",
    "<main><h1>Title</h1><p>One <b>two</b> é.<p>Three</main>",
    '<div class="with-sidebar"><div class="entry-content"><h1>Title</h1>One two é.<br><div>Three</div></div></div>',
    '<div class="post"><h1>Title</h1><p>One two é.</p><div class="share">tweet</div><p>Three</p><div class="comment-list"><p>bad</p></div></div>',
    "<article><header><h1>Title</h1><p>by me</p></header>One two é.<p>Three</p><div class=advert>x</div></article>",
])
def test_article_without_the_rest(frame, body):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body class='has-sidebar'>{frame.format(body)}</body></html>"
    assert alone(page) == "Title One two é. Three"


def test_pages_without_containers(make_pages):
    rows = [f"<body><div>Welcome to the site</div><p>text {i} of this page</p><p><a href=x>link {i}</a></p></body>" for i in range(4)]
    got = [r.main_text for r in H.main_text(make_pages(rows)).orderBy("page_id").collect()]
    assert got == [f"text {i} of this page" for i in range(4)]


def test_two_kinds_of_pages_on_a_host(make_pages):
    rows = ["<nav>n</nav><article>a</article><p>out</p>"] * 3 + ["<nav>n</nav><main>m</main>", "<article></article><p>out</p>"]
    got = [r.main_text for r in H.main_text(make_pages(rows)).orderBy("page_id").collect()]
    assert got == ["a", "a", "a", "m", ""]


@pytest.fixture
def make_pages(spark):
    def make(rows, urls=None):
        return spark.createDataFrame([(i, (urls or ["http://h.org/x"] * len(rows))[i], t) for i, t in enumerate(rows)], "page_id long, url string, html string")

    return make


def test_edges(make_pages):
    long = "<article>" + "".join(f"<p>block {i}</p>" for i in range(30_000)) + "</article>"
    deep = "<nav>n</nav><article>" + "<div><p>a" * 3000 + "</p></div>" * 3000 + "<p>end</p></article><footer>f</footer>"
    assert alone(deep) == " ".join(["a"] * 3000 + ["end"])
    wide = "<article>" + "".join(f"<p class=c{chr(97 + i % 23)}{chr(97 + i // 23 % 23)}>w{i}</p><ul><li>x<li>y</ul>" for i in range(4000)) + "</article>"
    assert alone(wide).split()[-3:] == ["w3999", "x", "y"]
    rows = [None, "", "plain text", "<article>x", "<article>x", "<p", long, "<" * 5000, "<a" + " b='" * 3000, "<div>" * 400 + "deep"]
    urls = [None, "", "no host", "http://A.org", "http://a.org", "https://a.org/1", "https://b.org?x", None, None, None]
    for limit in (32 << 20, 0):
        pages = make_pages(rows, urls).withColumn("host", F.lit("clash")).withColumn("slots", F.lit(1))
        out = H.main_text(pages, broadcast_bytes=limit)
        assert out.columns == pages.columns + ["main_text"]
        got = {r.page_id: r.main_text for r in out.collect()}
        assert len(got) == len(rows)
        assert [got[i] for i in (0, 1, 2, 3, 4, 5)] == ["", "", "plain text", "x", "x", ""]
        assert got[6].split(" block ")[-1] == "29999" and got[9] == "deep"
    assert H.main_text(make_pages([])).count() == 0


def test_hosts(spark):
    df = spark.createDataFrame([("http://A.b/c",), ("https://a.B:80?x",), ("x",), (None,)], "url string")
    assert [r[0] for r in df.select(H.host_of()).collect()] == ["a.b", "a.b:80", "", ""]


def test_many_hosts_in_a_task(spark):
    pages = spark.range(60).selectExpr("concat('h', id % 7) as host", "concat('<p>', id, '</p>') as html").coalesce(1)
    assert H.partial_wrappers(pages, most=3).count() > 7
    found = {r.host: (r.pages, r.wrapper) for r in H.wrappers(pages).collect()}
    assert len(found) == 7 and sum(n for n, _ in found.values()) == 60


@pytest.mark.parametrize("icon", ['<svg class="i"/>', "<svg class=i/>", "<svg/>", "<svg a='>' />", "<svg-icon></svg-icon>", "<svg-icon/>",
                                  "<title-bar></title-bar>", "<template-part></template-part>", "<svg><title>t</title><path d='M0'/></svg>",
                                  "<SVG viewBox='0 0 1 1'><use href='#x'/></SVG >", "<script-x></script-x>"])
def test_icons_and_custom_elements_drop_nothing_else(icon):
    page = f"<article><p>a {icon} b</p><p>c</p></article><footer>f</footer>"
    assert alone(page) == "a b c"
    assert alone(f"<article><p>a</p>{icon}<svg>x</svg><p>b</p></article>") == "a b"
    assert alone(f"<nav>n</nav>{icon}<main><p>a</p></main>") == "a"
    assert alone("<article>a<title>b</article>") == "a" and alone("<article>a<svg") == "a"


def test_all_class_words_are_judged():
    utilities = "bg-white border flex font-sans gap-0 items-center mb-0 p-0"
    assert alone(f"<div class='{utilities} sidebar'><p>s</p></div><div class='{utilities} story'><p>a</p></div><p>out</p>") == "a"
    assert H.tag_key("div", f' class="{utilities} x y sidebar z"').split(" ")[-1] == ".sidebar"


def test_shortened_tokens_are_judged_alike():
    rnd = random.Random(13)
    words = sorted(H.JUDGED_WORDS) + ["x", "flex", "my-post-0", "pageHeader"]
    roles = sorted(H.OTHER_ROLES) + ["article", "main", "hidden", "list"]
    for _ in range(3000):
        path = tuple(" ".join([rnd.choice(["div", "p", "h1", "article", "main", "header", "nav", "body", "section"]),
                               *("@" + r for r in rnd.sample(roles, rnd.choice([0, 0, 1]))),
                               *("." + w for w in rnd.sample(words, rnd.choice([0, 1, 2])))]) for _ in range(rnd.randint(1, 4)))
        assert H.judge(path) == H.judge(tuple(map(H.brief, path))), path


def test_region_is_kept_over_many_slugs(make_pages):
    names = ["q" + chr(97 + i // 26) + chr(97 + i % 26) + "q" for i in range(150)]
    rows = [f"<p>out {i}</p><div class=post id={n}><p>text {i}</p></div><div class=share id=s{n}>tweet {i}</div>" for i, n in enumerate(names)]
    w = H.wrapper_of(rows[0])
    for n, row in enumerate(rows[1:], 2):
        w = H.align(w, H.wrapper_of(row))
        assert H.judged(w, n)["region"] == "content"  # after whatever number of pages
    assert len(H.slots_of(w)) <= 4 * H.KEYS
    assert all(H.accepts(w, H.parse(r)) for r in rows)
    got = [r.main_text for r in H.main_text(make_pages(rows)).orderBy("page_id").collect()]
    assert got == [f"text {i}" for i in range(150)]


# ---------------------------------------------------------------- constants inside the article


def planted(n, line="Subscribe to our weekly letter &amp; more", share=1.0, host="p.org"):
    """Pages of one host whose articles differ but for a line (on `share` of them) and varying parts."""
    words = [f"w{i}" for i in range(997)]
    rows = []
    for i in range(n):
        rnd = random.Random(i)
        body = " ".join(rnd.choices(words, k=30))
        extra = f"<p>{line}</p>" if i < share * n else ""
        rows.append((f"http://{host}/{i}", f"<nav>n</nav><article><h1>Title {i}</h1><p>{body}</p>{extra}<p>last {i % 3} words</p></article><footer>f</footer>",
                     f"Title {i} {body}", f"last {i % 3} words"))
    return rows


def texts(make_pages, rows, limit=32 << 20):
    df = make_pages([r[1] for r in rows], [r[0] for r in rows])
    return [r.main_text for r in H.main_text(df, broadcast_bytes=limit).orderBy("page_id").collect()]


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_the_wrapper_takes_constants_out_of_the_article(make_pages, limit):
    rows = planted(40)
    got = texts(make_pages, rows, limit)
    assert got == [f"{a} {b}" for _, _, a, b in rows]
    empty = {"region": "article", "slots": {}, "fixed": [], "pages": 0}
    assert all(H.extract(r[1], dict(empty, slots={})) != t for r, t in zip(rows, got))  # class names alone keep the line


def test_what_is_no_constant_stays(make_pages):
    line = "Subscribe to our weekly letter & more"
    few, most = planted(H.ARTICLES - 1), planted(60, share=0.85)
    assert texts(make_pages, few) == [f"{a} {line} {b}" for _, _, a, b in few]
    assert [line in t for t in texts(make_pages, most)] == [i < 51 for i in range(60)]


def test_copies_of_an_article_are_one_article(make_pages):
    rows = planted(25, share=0)
    copies = [("http://p.org/c", "<article><h1>Same</h1><p>" + "the same text again and again " * 8 + "</p><p>its end</p></article>", "", "")] * 500
    got = texts(make_pages, rows + copies)
    assert got[:25] == [f"{a} {b}" for _, _, a, b in rows]
    assert set(got[25:]) == {"Same " + ("the same text again and again " * 8).strip() + " its end"}
    assert set(texts(make_pages, copies)) == set(got[25:])


def test_a_constant_of_one_host_or_slot_stays_in_others(make_pages):
    rows = planted(30)
    other = [("http://q.org/1", "<article><p>Subscribe to our weekly letter &amp; more</p><p>x</p></article>", "", "")]
    same = [("http://p.org/q", "<article><blockquote>Subscribe to our weekly letter &amp; more</blockquote><p>x</p></article>", "", "")]
    got = texts(make_pages, rows + other + same)
    assert got[-2:] == ["Subscribe to our weekly letter & more x"] * 2 and "Subscribe" not in got[0]


def test_merge_tree_covers_all_partial_wrappers(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN_IN", 2)
    pages = spark.range(90).selectExpr("'h' as host", "concat('<div><p>', id, '</p><i', id % 9, '>x</i', id % 9, '></div>') as html").repartition(24)
    (row,) = H.wrappers(pages).collect()
    w = __import__("json").loads(row.wrapper)
    assert row.pages == 90 and all(H.accepts(w, H.parse(r.html)) for r in pages.collect())
