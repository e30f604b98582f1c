import pytest

from tidemark.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="home has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- <p>no</p> -->
<div class="layout"><div class="ad">Buy now</div><div class="content post-%d"><h1>Title &amp; more</h1>
<p>First <b>para</b> with <a href="q>2">link</a>.<p>Second   para\n of&nbsp;text %s.<br>After break.<form><input><label>Mail</label></form>
<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><div class="cookie-notice">We use cookies</div></div>
<aside>More</aside><section id="comments"><p>A very long reader comment that goes on and on and on and on and on and on and on.</p></section></div>
<footer>&copy; me</footer>"""
TEXT = "Title & more\nFirst para with link.\nSecond para of text %s. After break.\none\ntwo\na\nb\nc"


def test_extraction_without_boilerplate():
    assert ht.extract(PAGE % (1, "x"), None) == TEXT % "x"
    assert ht.vote(PAGE % (1, "x")) == "/html/body.has-sidebar.home/div.layout/div.content.post-#"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>x", "x"),
        ("<", "<"),
        ("<!-- open", ""),
        ("&lt;b&gt; &#233;", "<b> é"),
        ("<div hidden>a</div>b", "b"),
        ("<script>x", ""),
        ("<article><h2>A<p>b<p>c</article>", "A\nb\nc"),
        ("<p>a<br>b</p>", "a b"),
        ("<div>" * 5000 + "deep", "deep"),
        ("<a href='x>y", "y"),
    ],
)
def test_odd_markup(html, want):
    assert ht.extract(html, None) == want


def test_shorter_parts_of_an_article_stay():
    long, short = "l" * 700, "s" * 150
    page = f"<body><div class=b><div class=s><p>{long}</p></div><div class=s><p>{short}</p></div></div><div class=b2><p>other</p></div>"
    assert ht.extract(page, "/html/body/div.b/div.s") == f"{long}\n{short}"
    page = f"<body><article><section class=s>{long}</section><section class=s>{short}</section></article><p>after</p>"
    for path in (ht.vote(page), None):
        assert ht.extract(page, path) == f"{long}\n{short}"
    page = f"<body><main><div class=lead>Lead</div><div class=text><p>{long}</p></div><div class=ad>Buy</div></main><div class=x>out</div>"
    assert ht.extract(page, ht.vote(page)) == f"Lead\n{long}"
    page = f"<body><main><article><p>{long}</p></article><article><p>{short}</p></article></main>"
    assert ht.extract(page, None) == long


def test_consensus_path_beats_a_pages_own_guess(spark):
    normal = "<body><div class=main-text><p>{0} body text of the page, long enough.</p></div><div class=extra><p>short</p></div>"
    odd = "<body><div class=main-text><p>Only a middling body text here.</p></div><div class=extra><p>An extra block that is somewhat longer than it.</p></div>"
    rows = [(k, "http://Host.example/p", normal.format(k), "h") for k in range(5)] + [(9, "http://host.example/q", odd, "h")]
    rows += [(10, None, "<p>alone</p>", "h"), (11, "bad url", None, None), (12, "http://user@other.example:80/x", "<main>m</main>", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r["page_id"]: r["text"] for r in ht.main_text(pages).collect()}
    assert ht.extract(odd, None).startswith("An extra")
    assert got[9] == "Only a middling body text here."
    assert (got[10], got[11], got[12]) == ("alone", "", "m")
    paths = {r["host"]: r["path"] for r in ht.winners(pages).collect()}
    assert paths["host.example"] == "/html/body/div.main-text"
    assert "other.example" in paths


def test_many_hosts_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(ht, "BROADCAST_HOSTS", 2)
    rows = [(k, f"http://h{k % 9}.example/", f"<article><p>text {k}</p></article>") for k in range(60)]
    got = ht.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(k, f"text {k}") for k in range(60)]


def test_empty_table(spark):
    assert ht.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_query(spark, sf_dir):
    rows = ht.op6_html_text(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert not any("&amp;" in r["text"] or "<p>" in r["text"] for r in rows)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><p>First of them.</p><svg width=1/><p>Second of them.</p></article>", "First of them.\nSecond of them."),
        ("<article><p>First.</p><object data=x><p>Second.</p></article>", "First.\nSecond."),
        ("<article><p>First.</p><select><p>Second.</p><video src=y><p>Third.</p></article>", "First.\nSecond.\nThird."),
        ("<article><p>First.</p><video><p>not played</p></video><p>Second.</p></article>", "First.\nSecond."),
        ("<p>Let <math><mi>x</mi></math> be.</p>", "Let x be."),
        ("<div class='social-science'><p>A text.</p></div>", "A text."),
        ("<div class='form-factor'><p>A text.</p></div>", "A text."),
        ("<div class='search-optimized post'><p>A text.</p></div>", "A text."),
        ("<div class='popular-history'><p>A text.</p></div>", "A text."),
        ("<div class='tag-list-page'><p>A text.</p></div>", "A text."),
        ("<div class='related'><p>The only text.</p></div>", "The only text."),
        ("<div class='cookie-banner'>Cookies!</div><div class=post><p>A text.</p></div><div id=siteFooter>end</div>", "A text."),
        ("<article><p>Text.</p>" + "<div>" * 220 + "<nav>Menu of all</nav>" + "</div>" * 220 + "</article>", "Text."),
        ("<div>" * 5000 + "<p>Deep text.</p>", "Deep text."),
    ],
)
def test_markup_that_once_lost_text(html, text):
    assert ht.extract(html, ht.vote(html)) == text


def test_result_equals_per_host_votes_on_the_driver(spark, sf_dir):
    """The same pages, voted and read without Spark."""
    from collections import Counter, defaultdict
    from urllib.parse import urlsplit

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    votes = defaultdict(Counter)
    for r in pages:
        path = ht.vote(r["html"] or "")
        if path is not None:
            votes[urlsplit(r["url"] or "").hostname][path] += 1
    won = {host: min(c, key=lambda p: (-c[p], p)) for host, c in votes.items()}
    want = {r["page_id"]: ht.extract(r["html"] or "", won.get(urlsplit(r["url"] or "").hostname)) for r in pages}
    got = {r["page_id"]: r["text"] for r in ht.op6_html_text(spark, sf_dir).collect()}
    assert got == want
