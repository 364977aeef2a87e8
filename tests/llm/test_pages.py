"""Main text of pages."""

import re

import pytest

from kpiforge.llm import wrapper

SCHEMA = "page_id bigint, url string, html string, host string, fixed string, text string, slot string, shape string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)


def article(i):
    return f"""<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>if (a < b) "</p>"</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav role="navigation"><ul><li><a href=/>Home {i}</a><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h2>Title&nbsp;{i} &amp; more</h2></header><p>First <b>bold<i>er</i></b> par{i}<br>line<p>Second &lt;tag&gt;
  text <script>x()</script><!-- <p>no</p> --><aside>Aside</aside><div class='ad banner'>Buy</div><form><input>Send</form>
<table><tr><td>cell<td>next</table><section id=comments><p>Reader says</section></article><aside>Side {i}</aside><footer>&copy; foot</footer></body></html>"""


def test_article_text(spark):
    rows = [(i, f"http://a.example/{i}", article(i)) for i in range(6)]
    rows += [(10, None, None), (11, "x", ""), (12, "http://b.example/", "plain text &amp; no tags"), (13, "http://b.example/1", "<p>open <b>tag <nav>menu"),
             (14, "http://b.example/2", "<article></article><p>outside</p>"), (0, "http://a.example/0", article(0))]
    got = wrapper.extracted(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i in range(6):
        assert by_id[i].text == f"Title {i} & more First bolder par{i} line Second <tag> text cell next"
        assert by_id[i].n_chars == len(by_id[i].text) and by_id[i].url == f"http://a.example/{i}"
    assert [by_id[i].text for i in range(10, 15)] == ["", "", "plain text & no tags", "open tag", "outside"]
    assert wrapper.extracted(table(spark, [])).count() == 0


def test_template_slots_go_where_no_article_is(spark):
    def page(i, extra=""):
        return f"<body><div id=top>Our site</div>{extra}<div class=body><h1>Head {i}</h1><p>Story {i} of many</p><p>More {i * 7}</p></div><div>Contact us</div></body>"

    rows = [(i, f"http://c.example/{i}", page(i, "<div class=new><span>Fresh " + str(i) + "</span></div>" if i % 3 == 0 else "")) for i in range(12)]
    rows += [(100 + i, f"http://few.example/{i}", page(i)) for i in range(2)]
    got = {r.page_id: r.text for r in wrapper.extracted(table(spark, rows)).collect()}
    for i in range(12):
        assert got[i] == (f"Fresh {i} " if i % 3 == 0 else "") + f"Head {i} Story {i} of many More {i * 7}"
    assert got[100] == "Our site Head 0 Story 0 of many More 0 Contact us"  # two pages make no template
    copies = [(i, f"http://d.example/{i}", page(1)) for i in range(50)]
    assert {r.text for r in wrapper.extracted(table(spark, copies)).collect()} == {"Our site Head 1 Story 1 of many More 7 Contact us"}


def test_template_slots_go_inside_articles_too(spark):
    def page(i, story):
        return (f"<body><p>Site {i}</p><article><h1>Head {story}</h1><div id=post-{i}><p>Story {story} of many</p><p>Shared by all</p>"
                f"<div class=box>Written by our editors</div></div></article></body>")

    rows = [(i, f"http://e.example/{i}", page(i, i)) for i in range(20)]
    rows += [(100 + i, f"http://copy.example/{i}", page(i, 1)) for i in range(50)]  # one article on 50 different pages
    got = {r.page_id: r.text for r in wrapper.extracted(table(spark, rows)).collect()}
    for i in range(20):
        assert got[i] == f"Head {i} Story {i} of many"
    for i in range(50):
        assert got[100 + i] == "Head 1 Story 1 of many Shared by all Written by our editors"


def test_a_page_gets_the_template_of_its_own_shape(spark):
    """Every page has an id of its own above its constant texts."""
    rows = [(i, f"http://ids.example/{i}", f"<body><div id=post-{i}><h1>Head {i}</h1><div class=a>Our site</div><div class=b>Contact</div></div></body>")
            for i in range(60)]
    pages = table(spark, rows)
    got = wrapper.template(pages).groupBy("host", "inside", "shape").count().collect()
    assert len(got) == 60 and {r["count"] for r in got} == {2}
    assert {r.page_id: r.text for r in wrapper.extracted(pages).collect()} == {i: f"Head {i}" for i in range(60)}


def test_small_hosts_have_a_template_of_what_is_on_all_pages(spark):
    def page(i, more):
        return f"<body><div id=top>Our site</div><p>Story {i}</p>{more}<div id=end>Contact us</div></body>"

    rows = [(100 * n + i, f"http://n{n}.example/{i}", page(i, "<p>On most</p>" if i else "")) for n in (1, 2, 3, 4) for i in range(n)]
    got = {r.page_id: r.text for r in wrapper.extracted(table(spark, rows)).collect()}
    for n in (1, 2, 3, 4):
        for i in range(n):
            own = f"Story {i}" + (" On most" if i else "")
            assert got[100 * n + i] == (own if n > 2 else f"Our site {own} Contact us")


@pytest.mark.parametrize("html, text", [
    ("<div class='layout with-sidebar'><p>One</p><div class='elementor-element elementor-widget'><p>Two</p></div></div>", "One Two"),
    ("<div class='page sidebar'><p>Side</p><article><p>Story</p><div class=ad>Buy</div></article></div>", "Story"),
    ("<div id=widget><main><p>Story</p><div class=comments><article>Reader</article></div></main></div>", "Story"),
    ("<article>Story</article><div class=related><article>Teaser</article></div>", "Story"),
    ("<p>See</p><ul><li><a href=/1>A first reference</a></li></ul><p class='Share box'>Send it on</p>", "See A first reference"),
    ("<nav><article>Menu</article></nav><p>Text</p>", "Text"),
])
def test_whole_names_mark_and_an_article_inside_comes_back(html, text):
    assert wrapper.main_text(html, set()) == text


def test_tree_matching_is_the_best_alignment():
    a = ("#page", (("body", (("nav", ()), ("div.x", (("p", ()), ("h1", ()))), ("footer", ()))),))
    b = ("#page", (("body", (("div.ad", ()), ("div.x", (("h1", ()), ("p", ()), ("h1", ()))), ("footer", ()))),))
    pairs = dict(wrapper.aligned(a, b)[1])
    assert pairs["body", "div.x"] == ("body", "div.x") and pairs["body", "div.x", "h1"] == ("body", "div.x", "h1")
    assert pairs["body", "footer"] == ("body", "footer") and ("body", "nav") not in pairs


def test_given_pages(spark):
    """Every paragraph and headline of the article, and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in wrapper.extracted(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner)
        assert got[r.page_id] == wrapper.clean(re.sub(r"<[^>]+>", "", inner))


@pytest.mark.parametrize("html", ["<", "<p", "</p></div>", "<script>never closed", "<!-- never closed", "<a href='x>y'>z</a>", "<p>" * 900, "<b>" * 3000 + "x"])
def test_broken_html(html):
    wrapper.main_text(html, set())
