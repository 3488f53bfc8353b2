import random
import re
import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from waymesh.llm import html_text as H
from waymesh.llm import queries

LONG = "This sentence is long enough to be running text of an article, and it goes on for a while without any link in it."
CASES = [
    ("<p>One &amp; two&nbsp;three<br>four</p><p>five", "One & two three four five"),
    (f"<div class=menu><ul><li><a href=/>a</a><li><a href=/>b</a></ul></div><div class='post-body'><h2>Title</h2><p>{LONG}<p>More <b>bo</b>ld.</div><div id=comments><p>{LONG} I disagree.</p></div>", f"Title {LONG} More bold."),
    (f"<header><p>Site</p></header><main><article><p>{LONG}</p><aside>aside</aside><form><p>form</p><input></form><script>x = '<p>no</p>'</script><style>p{{}}</style></article></main><footer>foot</footer>", LONG),
    (f"<div class='cookie-notice'>We use cookies. {LONG}</div><div class=content>{LONG}</div><div class=ad-box>buy</div>", LONG),
    (f"<table><tr><td class=sidebar><p>{LONG} side</p><td><p>{LONG}</p></table>", LONG),
    ("", ""),
    ("<script>only()", ""),
    ("<!-- <p>hidden</p> --><p style='display: none'>no</p><p hidden>no</p><p>yes</p>", "yes"),
    (f"<article><p>{LONG}</p><ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul><ol><li>first</li><li>second <a>link</a></li></ol></article>", f"{LONG} first second link"),
    ("<p title='a > b'>quo\"ted</p><p>5 < 6 &lt; 7</p>", 'quo"ted 5 < 6 < 7'),
    ("<p>" + "word " * 30000 + "</p>", ("word " * 30000).strip()),
    ("<div " * 3 + "<p>broken</p>", None),
    ('<div class="content"><div>Short one.</div><div>Short two.</div></div>', "Short one. Short two."),
    ("<div>no full stop</div><div>none here</div><nav>a</nav>", "no full stop none here"),
    (f'<main><div class="form"><p>About the poetic form. {LONG}</p></div><p>{LONG}</p></main>', f"About the poetic form. {LONG} {LONG}"),
    (f'<main><p>{LONG}</p><div class="form"><p>Your name here.</p><input></div></main>', LONG),
    (f"<div class=content><div>Short one.</div><div><p>{LONG}</p></div></div>", f"Short one. {LONG}"),
    (f'<p>{LONG}</p><a title="open > and <p>never closed', f"{LONG} and never closed"),
    (f"<p title=it's>one</p><p data-x='a > b' y>{LONG}</p>", f"one {LONG}"),
    (f'<article><p>{LONG}</p><div class="related-work"><p>Others did {LONG}</p></div><section id="notice-of-termination"><p>Given on {LONG}</p></section><div class="comment-on-law"><p>Law {LONG}</p></div></article>', f"{LONG} Others did {LONG} Given on {LONG} Law {LONG}"),
    (f'<div id="comment-on-law"><p>{LONG}</p><p>{LONG}</p></div><div class="comment-body"><p>Reader: {LONG}</p></div>', f"{LONG} {LONG}"),
    (f'<article><p>{LONG}</p><div class="related-posts"><p>{LONG} you may like</p></div><div class="cookie_notice-text"><p>{LONG}</p></div><div id="comments-section"><p>{LONG}</p></div><div class="AdBanner2"><p>{LONG}</p></div><div class="share-the-law"><a href=/>{LONG}</a></div><div class="newsletter-of-law"><p>{LONG}</p><input></div></article>', LONG),
    (f"</body></p><p>{LONG}</p></section><!-- open", LONG),
]


@pytest.mark.parametrize("html,text", CASES)
def test_single_pages(html, text):
    got = H.extracted(html, None)
    assert text is None or got == text


@pytest.mark.parametrize(
    "html",
    ["<a" * 100_000, "<a " * 100_000 + ">", "<div>" * 100_000, "<div>x" * 50_000 + "</b>" * 50_000, "<p>" + "<span>x" * 50_000 + "<div>y" * 50_000, "<p><object>" + "<div>" * 100_000, "<a " + "x=1 " * 250_000, '<a b="x>" ' * 60_000, "<a b='>" * 60_001, "<!" * 100_000, "<" * 300_000, "<ul>" + "<li><a>x" * 60_000, "<div class='a b'>t. " * 50_000, "<article>" * 60_000, "<table>" * 60_000 + "<td>x" * 60_000, "<script>" + "</scrip" * 100_000],
)
def test_time_is_linear(html):
    begin = time.perf_counter()
    page = H.Page(html)
    best = page.best()
    page.text(best and best[0])
    assert time.perf_counter() - begin < 4


def test_votes_equal_brute_force(spark):
    rng = random.Random(4)
    shapes = ["<div class='post p{i}'><p>{t}</p></div><div class=x>{s}</div>", "<section><div>{t}</div></section><p>{s}</p>", "<main><p>{t}</p><p>{s}</p></main>"]
    pages = [(i, f"http://h{rng.randrange(5)}.example/{i}", rng.choice(shapes).format(i=i, t=LONG * rng.randint(1, 3), s="A note. " * rng.randint(1, 30))) for i in range(80)]
    votes = {}
    for _, url, html in pages:
        path, score = H.Page(html).best()
        key = url.split("/")[2]
        votes.setdefault(key, {}).setdefault(path, 0.0)
        votes[key][path] += score
    want = {h: min(v, key=lambda p: (-round(v[p], 6), p)) for h, v in votes.items()}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.host: r.path for r in H.consensus_paths(df).collect()} == want
    assert {r.page_id: r.text for r in H.extract(df).collect()} == {i: H.extracted(html, want[url.split("/")[2]]) for i, url, html in pages}


def test_hosts_vote(spark):
    side = "<div class=c{}><p>{}</p></div>"
    pages = [(i, f"http://H.example/{i}", f"<div class=post-{i}><p>{LONG * 3}</p></div>" + side.format(i, "short note")) for i in range(4)]
    pages += [(9, "https://h.EXAMPLE:80/q", f"<div class=post-9><p>{LONG}</p></div>" + side.format(9, LONG * 4)), (10, "http://other/", side.format(1, LONG)), (None, None, None), (11, "nonsense", "<p>bare</p>"), (11, "nonsense", "<p>bare</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"text": F.lit(1), "path": F.lit("x"), "host": F.lit("y")})
    got = {(r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()}
    assert (9, LONG, len(LONG)) in got and (10, LONG, len(LONG)) in got and (None, "", 0) in got and (11, "bare", 4) in got
    assert H.extract(df).count() == 9 and H.extract(df.where("false")).collect() == []


def test_articles_of_the_sample(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = queries.QUERIES["op5_html_extraction"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(unescape(re.sub(r"</?(p|br|h1)>", " ", re.sub(r"</?b>", "", article))).split())
