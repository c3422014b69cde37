from html.parser import HTMLParser

from cuelattice.llm.html_paths import extract, host_of, main_text
from cuelattice.llm.markup import tokens

PAGES = "page_id long, url string, html string"


def text(html):
    return main_text(html, None)[0]


def test_article_without_the_rest():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Head &amp; line</h1><span class=byline>by me</span></header><p>First   <b>bold</b>&nbsp;text<br>goes on.<p>Second &lt;p&gt; &copy; 2 &#x41;
    <div class="ad">Buy</div><ul><li>one<li>two</ul><form><input> mail me</form><aside>See also</aside>
    <section class="comments"><p>Nice article, I read all of it and have a lot to say about every part of it</p></section></article>
    <footer>&copy; me</footer></body></html>"""
    assert text(html) == "Head & line\nFirst bold text goes on.\nSecond <p> © 2 A\none\ntwo"


def test_only_what_the_contract_names_is_left_out():
    for inside in ('<div class="related-work">', '<section class="share-prices">', '<p class="search-results">', '<p class="alert-level">', '<p class="copyright-law">', '<div class="menu-item">', '<blockquote class="reply">', '<p class="byline">', '<div class="more-text">'):
        end = inside[1:].split()[0]
        assert text(f"<article><p>Before it.</p>{inside}What stands in here stays.</{end}><p>Behind it.</p></article>") == "Before it.\nWhat stands in here stays.\nBehind it.", inside
    for inside in ('<div class="ad">', '<div class="google-ad-slot">', '<ul class="menu">', '<div class="cookie-banner">', '<div class="comment-list">', '<section id="comments">', '<div class="pageSidebar2">', '<p class="notice">', '<div role="search">', '<div class="related-posts"><a href=x>One more story</a> or', '<div class="tags"><a href=y>News of today</a>'):
        end = inside[1:].split()[0]
        assert text(f"<article><p>Before it.</p>{inside} no </{end}><p>Behind it.</p></article>") == "Before it.\nBehind it.", inside


def test_names_that_speak_of_something_stay():
    for inside in ("p.comments-on-law", "div.widget-maker", "p.ad-hoc", "p.navigation-history", "div.login-story", "p.sponsored-bill", "p.skip-level", "p.about-advertising", "div.history-of-the-pager", "p.town-sidebar-story"):
        tag, name = inside.split(".")
        page = f"<article><p>Before it.</p><{tag} class={name}>What stands in here stays.</{tag}><p>Behind it.</p></article>"
        assert text(page) == "Before it.\nWhat stands in here stays.\nBehind it.", inside
    for inside in ("div.reply", "ul.replies", "div.left-sidebar", "div.ad-slot-top", "div.sidebar-inner", "div.newsletter-signup-box", "div.site-comments", "p.ad", "p.skip-link", "div.widget_text", "nav.x", "div.nav-links"):
        tag, name = inside.split(".")
        assert text(f"<article><p>Before it.</p><{tag} class={name}>no, not this</{tag}><p>Behind it.</p></article>") == "Before it.\nBehind it.", inside


def test_a_heading_beside_the_text():
    story = "A sentence that is long enough to count as one here. "
    page = "<body><div class=top><a href=/>Home</a></div>{0}<div class=content><p>{1}</p></div></body>"
    assert text(page.format("<h1>The heading</h1>", story * 3)) == f"The heading\n{(story * 3).strip()}"
    assert text(page.format("<header><h1>The site</h1></header>", story * 3)) == (story * 3).strip()
    assert text(page.format("<h1><a href=/>The site</a></h1>", story * 3)) == (story * 3).strip()
    assert text(page.format("<h1>One</h1><h1>Two</h1>", story * 3)) == (story * 3).strip()
    assert text(f"<body><h1>The site</h1><article><h1>Head</h1><p>{story}</p></article></body>") == f"Head\n{story.strip()}"
    assert text(f"<body><h1>The site</h1><article><h2>Head</h2><p>{story}</p></article></body>") == f"Head\n{story.strip()}"


def test_text_outside_the_best_container():
    story = "A sentence that is long enough to count as one here. "
    page = f"<body><div class=top><a href=/>Home</a> <a href=/n>News of today</a></div><div id=content><div class=intro>{story * 2}</div><div class=body>{story * 9}</div><div class=last>{story * 5}</div></div><div class=bottom>Terms and so on</div></body>"
    assert text(page) == "\n".join((story * n).strip() for n in (2, 9, 5))
    assert text(f"<body><div class=a><p>{story * 4}</p></div><div class=a><p>{story * 5}</p></div><ul><li><a href=x>{'link ' * 30}</a></ul></body>") == f"{(story * 4).strip()}\n{(story * 5).strip()}"
    # a host's path that holds little of a page does not hide the rest
    assert main_text(f"<div class=x>{story}</div><div class=y>{story * 9}</div>", "div.x")[0].count("A sentence") >= 9


class _Reader(HTMLParser):
    """The blocks of the article, by the library's parser: a reference for pages whose article is marked."""

    BLOCKS = set("p h1 h2 h3 li ul div article nav footer body section".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.parts, self.blocks = [], [], []

    def ends(self):
        line = " ".join("".join(self.parts).split())
        self.parts = []
        self.blocks += [line] if line else []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.ends()
        if tag == "br":
            self.parts.append(" ")
        elif tag not in ("meta", "img", "hr", "p", "b", "li"):
            self.open.append("ad" if ("class", "ad") in attrs else tag)

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.ends()
        if tag not in ("p", "b", "li") and self.open:
            self.open.pop()

    def handle_data(self, data):
        if "article" in self.open and not {"ad", "nav", "footer", "script", "style"} & set(self.open):
            self.parts.append(data)


def test_every_page_equals_a_plain_reading(spark):
    from cuelattice.llm import queries as q
    from cuelattice.llm.common import table

    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in table(spark, sf, "pages").collect()}
    for r in q.op5_html(spark, sf).collect():
        reader = _Reader()
        reader.feed(html[r.page_id])
        reader.ends()
        assert r.text == "\n".join(reader.blocks), r.page_id


def test_clashing_names(spark):
    d = spark.createDataFrame([(1, "http://x/", "<p>taken</p>", "mine")], "page_id long, url string, body string, html string")
    got = extract(d, html_col="body")
    assert got.columns == ["page_id", "url", "html", "host", "text", "path"] and got.first()[2:5] == ("mine", "x", "taken")


def test_broken_pages():
    assert text("<article><p>cut off in a wo") == "cut off in a wo"
    assert text("<article><p>cut in a tag</p><p cla") == "cut in a tag"
    assert text("<article><p>a &amp b &am") == "a & b &am"
    assert text("<article><p>x</p></arti") == "x"
    assert text("<p>1 < 2 and 3 <4</p>") == "1 < 2 and 3 <4"
    assert text("<div><script>if (a<b) {") == "" and text("no tags at all") == "no tags at all"
    assert text("<p title='a > b'>x</p><p title=\"broken>y</p>") == "x\ny"
    assert text(None) == text("") == text("<") == text("</") == text("<!-- open") == ""
    assert len(text("<div>" * 3000 + "deep" + "</div>" * 3000)) == 4
    assert list(tokens("a<!-- x > y -->b")) == [("text", "", "a"), ("text", "", "b")]


def test_the_host_decides(spark):
    # on one page the wrong container is larger; the other pages of the host outvote it
    good = "<body><div class=c12><p>{0}</p></div><div class=x7><p>{1}</p></div></body>"
    rows = [(i, f"https://www.A.example/{i}", good.format("story " * 60, "side " * 5)) for i in range(5)]
    rows.append((9, "http://a.example/9", good.format("short story", "side " * 80)))
    rows.append((10, "http://b.example/9", good.format("short story", "side " * 80)))
    got = {r.page_id: r for r in extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[9].text == "short story" and got[9].path == "/body/div.c#"
    assert got[10].text == ("side " * 80).strip() and got[10].host == "b.example"


def test_edges(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, "<p>a</p>"), (2, "http://x/", None), (3, "http://x/", ""), (None, None, None), (4, "odd url", "<p>b</p>"), (4, "odd url", "<p>b</p>"), (5, "http://x/", "<p>" + "word " * 100_000)]
    d = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("path", F.lit("clash")).withColumn("votes", F.lit(1))
    got = extract(d).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 0), (1, 1), (2, 0), (3, 0), (4, 1), (4, 1), (5, 499_999)]
    assert extract(spark.createDataFrame([], PAGES)).count() == 0


def test_host_of():
    assert [host_of(u) for u in ("https://www.Ex.org:80/a?b", "//u@h/x", "x", None)] == ["ex.org", "h", "", ""]
