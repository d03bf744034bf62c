import pytest

from tallyloom.llm import templates

PAGES = "page_id long, url string, html string, text string, n_chars int"


def texts(spark, rows, **options):
    pages = spark.createDataFrame([(i, u, h, "old", -1) for i, u, h in rows], PAGES)
    return {r["page_id"]: r["text"] for r in templates.extract_text(pages, **options).collect()}


def test_recurring_subtrees_go(spark):
    """No element names its purpose; only recurrence tells the template from the text."""
    page = ("<html><body><div><p>Welcome to the site</p><ul><li>One</li><li>Two</li></ul></div><div><p>Text %d of its own</p>"
            "<p>and more %d</p></div><p>Contact us</p></body>")
    rows = [(i, f"http://a.org/{i}", page % (i, i)) for i in range(12)] + [(99, "http://b.org/1", page % (1, 1))]
    got = texts(spark, rows)
    assert got[3] == "Text 3 of its own\nand more 3"
    assert got[99] == "Welcome to the site\nOne\nTwo\nText 1 of its own\nand more 1\nContact us"


def test_shared_paragraphs_and_copies_of_articles_stay(spark):
    page = "<article><h1>T%d</h1><p>A line that all quote.</p><div><p>Share this</p></div><p>Own %d</p></article>"
    rows = [(i, "http://a.org/x", page % (i, i)) for i in range(20)] + [(50 + i, "http://c.org/x", page % (1, 1)) for i in range(30)]
    got = texts(spark, rows)
    assert got[4] == "T4\nA line that all quote.\nOwn 4"
    assert got[60] == "T1\nA line that all quote.\nShare this\nOwn 1"


@pytest.mark.parametrize("html,text", [
    ("<p>a  b\n c<br>d&nbsp;e &lt;x&gt; &#233;&amp;amp; &am</p>", "a b c d e <x> é&amp; &am"),
    ("<p>one<p>two<div>three</div>four", "one\ntwo\nthree\nfour"),
    ("<nav>n</nav><header>h</header><main><p>x</p><aside>s</aside></main><footer>f</footer>", "x"),
    ("<article><p>t</p><form><p>f</p></form><div class='reader-comments'><p>c</p></div></article><p>out</p>", "t"),
    ("<div class=\"ad\">buy</div><p>read <span class='share'>share</span>me</p>", "read me"),
    ("<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>a<b>b</b>c</p>", "abc"),
    ("<ul><li>1<li>2</ul><table><tr><td>x<td>y</table>", "1\n2\nx\ny"),
    ("<p>5 < 6 and 7 > 6</p>", "5 < 6 and 7 > 6"), ("<p title='a > b'>q</p>", "q"), ("<p>cut <b>off", "cut off"),
    ("<head><title>t</title><body>x</body>", "x"), ("</div></p>plain", "plain"), ("<article></article><p>x</p>", ""),
    (None, ""), ("", ""), ("   ", ""), ("<" * 5000, "<" * 5000), ("<a \"" * 2000, None), ("<div>" * 3000 + "deep", "deep"),
])
def test_extraction(spark, html, text):
    got = texts(spark, [(1, "http://h/", html), (1, None, html)])
    assert text is None or got[1] == text


def test_odd_rows(spark):
    assert texts(spark, []) == {}
    assert texts(spark, [(None, None, "<p>x</p>"), (2, "u", "<p>y</p>")]) == {None: "x", 2: "y"}


@pytest.mark.parametrize("html,text", [
    ("<p>a<img src=\"data:" + "x" * 100_000 + "\">b</p>", "ab"),
    ("<div class='ad' style='" + "y > " * 25_000 + "'>buy</div><p>q</p>", "q"),
    ("<p>a <img alt=\"cut>b</p><p>c</p>", "a b\nc"), ("<p title='" + "<" * 100_000 + ">x</p>", None),
])
def test_long_and_unclosed_attributes(html, text):
    got = templates.Page(html).text()
    assert text is None or got == text


@pytest.mark.parametrize("html,text", [
    ("<div class='layout has-sidebar'><article><p>t</p></article></div><p>out</p>", "t"),
    ("<div class='no-ads'><p>t</p></div>", "t"), ("<div class='with-header'><p>t</p></div>", "t"),
    ("<div class='hfeed comments-open'><p>t</p></div>", "t"),
    ("<article class='post share-enabled'><p>t</p></article><p>out</p>", "t"),
    ("<div class='social'><article><p>t</p></article></div><p>out</p>", "t"),
    ("<article class='sponsored'><p>t</p></article><p>out</p>", "t"),
    ("<div id='banner'><h1>T</h1><p>t</p></div>", "T\nt"),
    ("<p>t</p><div class='x top-banner'>b</div><div id='reader_comments'>c</div><div class='ad'>a</div>", "t"),
    ("<nav class='menu'><h1>T</h1></nav><p>t</p>", "t"),
])
def test_names_of_furniture(html, text):
    assert templates.Page(html).text() == text
