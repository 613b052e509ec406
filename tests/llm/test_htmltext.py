import html
import re

from spanloom.llm import htmltext as H

SCHEMA = "page_id long, url string, html string, text string, site string"


def by_hand(page):
    """The text of pages whose article holds h1 and p alone."""
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>", "\0", re.sub(r"<br>", " ", m[1] if m else "")))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in body.split("\0")) if x)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.main_text(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == by_hand(r.html) and got[r.page_id].n_chars == len(by_hand(r.html))


def test_what_is_not_the_article():
    page = """<html><body><header>Head</header><nav><li>a</li></nav><main><article><header><h1>Title &amp; x</h1></header>
    <p>One <b>two</b><br>three<p>Four&nbsp;<a href="x">five</a>.<aside>no</aside><ul><li>i1<li>i2</ul><script>var a="</p>";</script>
    <div class="comments"><p>rude</div><form>f</form></article></main><div id="cookie-notice">c</div><!-- <p>gone</p> --><footer>z</footer>"""
    assert H.extract([H.tokens(page)]) == [["Title & x", "One two three", "Four five.", "i1", "i2"]]


def test_template_without_an_article():
    shell = "<body><div class=top>Our Site</div><div class=c><p>{}</p><p>{} more</p><p>Read on below</p></div><div class=end>All rights</div></body>"
    pages = [H.tokens(shell.format(f"text {i}", f"second {i}")) for i in range(6)]
    assert H.extract(pages) == [[f"text {i}", f"second {i} more"] for i in range(6)]
    template = H.deduce(pages)
    assert any(k[2] == "Our Site" for k in template) and not any("text" in k[2] for k in template)


def test_copies_of_one_page_keep_their_text():
    page = H.tokens("<body><nav>n</nav><article><h1>T</h1><p>Body</p></article></body>")
    assert H.extract([page] * 5) == [["T", "Body"]] * 5


def test_awkward_pages(spark):
    rows = [(1, "http://h.example/1", None, "t", "s"), (2, "http://h.example/2", "", "t", "s"), (3, None, "<p>plain", "t", "s"), (4, "x", "just text", "t", "s"),
            (None, "http://h.example/3", "<article><p>a</article>", "t", "s"), (5, "http://h.example/4", "<article>" + "<p>w w</p>" * 20_000, "t", "s"), (5, "http://h.example/4", "<div " * 50, "t", "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.page_id, r.n_chars): r.text for r in H.main_text(df).collect()}
    assert len(got) == 7 and got[3, 5] == "plain" and got[4, 9] == "just text" and got[None, 1] == "a"
    assert got[5, 20_000 * 4 - 1].count("\n") == 19_999
    assert H.main_text(df.limit(0)).count() == 0


def test_a_host_with_many_pages_is_split(spark):
    rows = [(i, "http://one.example/p", f"<nav>m</nav><article><p>text {i}</p></article>", "", "") for i in range(300)]
    got = H.main_text(spark.createDataFrame(rows, SCHEMA), group=16).collect()
    assert {r.page_id: r.text for r in got} == {i: f"text {i}" for i in range(300)}


def test_template_inside_articles():
    shell = "<nav>n</nav><article><h2>Story</h2><p>{0} is a text of its own</p><div class=x>Read our paper daily</div>{1}<p>{0} goes on after it</p><div class=y>Print</div><p>{0} end</p><div class=y>Print</div></article>"
    pages = [H.tokens(shell.format(f"t{i}", "<div class=z>Also in print</div>" * (i % 2))) for i in range(8)]
    want = [["Story", f"t{i} is a text of its own", f"t{i} goes on after it", f"t{i} end"] for i in range(8)]
    assert H.extract(pages) == want
    other = H.tokens("<article><p>a page that no template fits</p><div class=x>Read our paper daily</div></article>".replace("div class=x", "section").replace("/div", "/section"))
    assert H.extract([*pages, other]) == [*want, ["a page that no template fits", "Read our paper daily"]]
    near = [H.tokens(f"<article><h1>Edition {i}</h1><p>The same report, word for word</p></article>") for i in range(5)]
    assert H.extract(near) == [[f"Edition {i}", "The same report, word for word"] for i in range(5)]


def test_every_varying_slot_without_an_article():
    shell = "<body><div class=top>Our Site</div><div class=c><h1>Title {0}</h1><p>a {0}</p><p>b {0}</p><ul><li>item {0}</ul><p>c {0}</p><b>More</b><p>More</p><p>d {0}</p><p>More</p></div><div class=menu>m {0}</div><div class=end>All rights</div></body>"
    pages = [H.tokens(shell.format(i)) for i in range(6)]
    want = [[f"{x} {i}" for x in ("Title", "a", "b", "item", "c", "d")] for i in range(6)]
    assert H.extract(pages) == want


def test_words_and_forms_around_the_article():
    for around in ("<div class='layout has-sidebar'>", "<div class='with-menu'>", "<section id=nav-open>", "<form id=aspnet>", "<div class=sidebar>"):
        end = f"</{around[1:].split(' ')[0]}>"
        page = f"<body><div class=ad>x</div>{around}<div class=sidebar>s</div><article><header class='entry-header'><h1>T</h1></header><p>Body</p><div class=comments>rude and very long</div></article>{end}<footer>f</footer>"
        assert H.extract([H.tokens(page)]) == [["T", "Body"]], around
    bare = "<body><form class='page with-menu'><div class=menu>m</div><h1>T {0}</h1><p>Body {0}</p><div class=comments>rude {0}</div></form><form>Your mail</form>"
    pages = [H.tokens(bare.format(i)) for i in range(5)]
    assert H.extract(pages) == [[f"T {i}", f"Body {i}"] for i in range(5)] and H.extract(pages[:1]) == [["T 0", "Body 0"]]
    related = "<main><p>Short</p><div class=related><article>a teaser that is longer than the text</article></div></main>"
    assert H.extract([H.tokens(related)]) == [["Short"]]
    post = "<div class=post><p>The post itself</p></div><div class='all-comments'><article>me too</article></div>"
    assert H.extract([H.tokens(post)]) == [["The post itself"]]


def test_words_of_the_subject_are_no_side_parts():
    page = "<article><h1>T</h1><div class='social-science'>One</div><p class='ad-hoc'>Two</p><p id='social-contract'>Three</p>{}<p>Four</p></article>"
    want = ["T", "One", "Two", "Three", "Four"]
    assert H.extract([H.tokens(page.format(""))]) == [want]
    for side in ("social-links", "ad-slot-3", "ad", "reader-comments", "comment-thread", "related-reading", "share-buttons", "cookie-hint", "newsletter-box", "alert-box", "col-2 sidebar-fancy"):
        assert H.extract([H.tokens(page.format(f"<div class='{side}'>no</div>"))]) == [want], side
