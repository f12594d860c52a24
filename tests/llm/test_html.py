import time
from html.parser import HTMLParser
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from probelight.llm import html_text, queries

PAGE = """<html><head><title>T</title><script>if (a < b) {}</script></head><body><div id="cookie-notice">We use cookies</div><header class="site-header"><a href="/">Home</a></header>
<div class="layout"><main><article class="post-12"><header><h1>The &amp; title</h1><p class="byline">By x</p></header><div class="content"><p>First  para <a href=x>link</a> more
text here.<p>Second&nbsp;para &lt;b&gt; <span class="ad">AD <span>x</span></span>end<br>after.<ul><li>one<li>two</ul><form><input><label>Mail</label></form><table><tr><td>c1<td>c2</table></div>
<section class="comments"><h2>Comments</h2><p>nice comment text which is quite long indeed</p></section></article></main><aside><p>side</p></aside></div><footer>foot</footer></body></html>"""
TEXT = "The & title\nFirst para link more text here.\nSecond para <b> end after.\none\ntwo\nc1\nc2"


def test_main_text_of_one_page():
    page = html_text.parse(PAGE)
    assert html_text.best_container(page).tag == "article"
    assert html_text.extract(page, None) == TEXT


def test_votes_carry_pages_of_the_host(spark):
    """A page with more prose beside its article follows its host's path; unknown hosts fall back on their own."""
    long = "Prose that belongs to nothing. " * 40
    odd = f'<html><body><article class="post-9"><p>Short story.</p></article><div class="blurb"><p>{long}</p></div></body></html>'
    plain = '<html><body><article class="post-1"><p>A story of some length, told in a few words more.</p></article></body></html>'
    rows = [(i, f"http://Host.example/{i}", plain) for i in range(20)] + [(20, "https://www.host.example:80/x", odd), (21, None, plain), (22, "bad url", None), (23, "http://h/", ""), (24, "http://z/", "<p>no end <b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("paths", F.lit(0))
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert got[20] == "Short story." and got[21].startswith("A story") and got[22] == got[23] == "" and got[24] == "no end <b"
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_pages_table(spark, sf_dir):
    rows = queries.op7_html_host_paths(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) > 0 and "<" not in r.text and "©" not in r.text for r in rows)


def text_of(html):
    return html_text.extract(html_text.parse(html), None)


def test_names_are_read_whole():
    """Parts of the article stay though one word of their class is that of a menu; marked parts go."""
    page = """<article><h1>T</h1><p>One plain paragraph of the article, long enough.</p><p class="share-price">The price rose.</p><div class="related-work"><p>Others did this before.</p></div>
    <div class="share-buttons">Tweet</div><div id="related-posts">More to read</div><p class="comment-list">no</p><p class="ad">buy</p><p>End.</p></article>"""
    assert text_of(page) == "T\nOne plain paragraph of the article, long enough.\nThe price rose.\nOthers did this before.\nEnd."


def test_wrappers_do_not_take_their_article():
    inner = "<article><p>The story of the page, with some words in it.</p></article>"
    for name in ("has-sidebar", "search-results-page", "layout no-comments-page"):
        assert text_of(f'<div class="{name}">{inner}</div>') == "The story of the page, with some words in it."
    assert text_of(f'<div id="sidebar">{inner}</div>') == "The story of the page, with some words in it."


def test_formulas_drawings_and_what_is_left_open():
    assert text_of("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></article>") == "Let x=1 be."
    assert text_of("<article><p>a <svg><title>no</title><text>no</text></svg>b</p><p>c</p></article>") == "a b\nc"
    assert text_of("<article><p>a <svg><text>no</p><p>b</p></article>") == "a\nb"
    assert text_of("<article><div>a <svg><text>no<p>b</p></div><p>c</p></article>") == "a\nb\nc"
    assert text_of("<article><p>a<select><option>no</select> b <noscript><p>no</p></noscript></p><video>no</video><p>c</p></article>") == "a b\nc"


def test_open_heads_and_open_raw_parts_hide_no_article():
    assert text_of("<html><head><title>T</title><article><h1>A</h1><p>The story.</p></article>") == "A\nThe story."
    assert text_of("<html><head><meta charset=x><title>T</title><script>x<y</script><link rel=a><p>First.</p>") == "First."
    assert text_of("<head><title>T</title></head><body><noscript><p>no</p></noscript><p>Yes.</p>") == "Yes."
    for tag in ("noscript", "iframe", "title", "textarea"):
        assert text_of(f"<body><{tag}>gone<article><p>Whole story.</p></article></body>") == "Whole story."
    assert text_of("<body><p>a</p><script>if (x) {") == "a"


def test_words_of_controls_and_of_the_articles_header():
    assert text_of("<article><p>Press <label>Save</label> now and <button>Go</button> on.</p></article>") == "Press Save now and Go on."
    assert text_of("<article><p>One.</p><button>Share</button><p><button>Like</button></p><div><label>Mail</label></div></article>") == "One."
    assert text_of('<article><p>One <button class="share-button">Share</button>two.</p></article>') == "One two."
    page = "<article><header><h1>T</h1><p>What this story is about.</p><p>By A. Writer, 3 May</p><p class='post-date'>3 May</p><span>12 min</span></header><p>Body.</p></article>"
    assert text_of(page) == "T\nWhat this story is about.\nBody."


def test_votes_against_a_count_by_hand(spark, sf_dir):
    """Over the whole table: every page's best container, counted per host by a dictionary."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ballots = {}
    for r in pages.collect():
        page = html_text.parse(r.html or "")
        best = html_text.best_container(page)
        if best.path:
            host = (urlsplit(r.url.lower()).hostname or "").removeprefix("www.") if r.url else ""
            votes = ballots.setdefault(host, {}).setdefault(best.path, [0, 0])
            votes[0] -= 1
            votes[1] -= best.score
    want = {h: [p for _, _, p in sorted((v, w, p) for p, (v, w) in paths.items())] for h, paths in ballots.items()}
    assert {r.host: r.paths for r in html_text.vote(pages).collect()} == want


def test_time_is_linear_in_the_page():
    took = []
    for n in (4000, 16000):
        page = "<body>" + "".join(f'<div class="row"><p>Text of row {i}.</p></div>' for i in range(n)) + "</body>"
        paths = ["/body/div.row"]
        start = time.process_time()
        assert html_text.extract(html_text.parse(page), paths).count("\n") == n - 1
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.2


class Slow(HTMLParser):
    """The article's blocks by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.lines, self.line, self.on, self.off = [], "", 0, 0

    def cut(self):
        if self.line.split():
            self.lines.append(" ".join(self.line.split()))
        self.line = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "form", "nav", "aside", "footer"):
            self.off += 1
        if tag == "article":
            self.on += 1
        if tag in html_text.BLOCKS:
            self.cut()
        if tag == "br":
            self.line += " "

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.cut()
        if tag in ("script", "style", "form", "nav", "aside", "footer") and self.off:
            self.off -= 1
        if tag == "article":
            self.on -= 1

    def handle_data(self, data):
        if self.on and not self.off:
            self.line += data


def test_query_against_a_slow_parser(spark, sf_dir):
    """Over the whole table: where a page's article holds no part that goes, both give the same text."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op7_html_host_paths(spark, sf_dir).collect()}
    assert set(got) == set(pages)
    compared = 0
    for i, html in pages.items():
        body = html[html.find("<article") : html.find("</article>")] if html and "<article" in html else None
        if body is None or any(x in body for x in ("<nav", "<aside", "<form", "<footer", "class=", "id=", "<script", "<header", "hidden")):
            continue
        slow = Slow()
        slow.feed(html)
        slow.cut()
        assert got[i] == "\n".join(slow.lines), i
        compared += 1
    assert compared > 0.5 * len(pages)
