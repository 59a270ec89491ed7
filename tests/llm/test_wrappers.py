import re
from html import unescape

from veilwork.llm import wrappers as wr
from veilwork.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.01"


def page(body, extra="", host="a.org"):
    return f"https://{host}/x", (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head><body>"
        f"<header>Site</header><nav><ul><li><a href='>'>One</a><li>Two</ul></nav><div class='ad top'>Buy</div>{body}"
        f"<section id=comments><p>First!</p></section><form><p>Name</p></form>{extra}<footer>&copy; me</footer></body></html>"
    )


def test_all_pages_of_the_table(spark):
    """Brute force for the table's template: heading and paragraphs of the article, by plain regular expressions."""
    pages = spark.read.parquet(f"{ROOT}/pages.parquet").toPandas()
    expected = {}
    for page_id, html in zip(pages["page_id"], pages["html"], strict=True):
        article = re.split("</article>", html.split("<article>", 1)[1])[0]
        parts = re.split(r"</?(?:h1|p)>", article)
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in parts]
        expected[page_id] = "\n".join(x for x in parts if x)
    got = {r.page_id: r for r in QUERIES["op2_wrappers"](spark, ROOT).collect()}
    assert {k: r.text for k, r in got.items()} == expected
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_templates_and_edge_cases(spark):
    pages = [
        (1, *page("<article><h1>A &amp; B</h1><p>One\n  two<b>!</b><p>Three &lt;x&gt;<ul><li>i<li>j</ul></article>")),
        (2, *page("<article><h1>C</h1><aside>side</aside><p>D<br>e</p><!-- no --></article>", "<aside>More</aside>")),
        (3, *page("<div class=body><h1>Top</h1><p>Own text one</p></div><div>Every page says this</div>", host="b.org")),
        (4, *page("<div class=body><h1>Other</h1><p>Own text two</p></div><div>Every page says this</div>", host="b.org")),
        (5, *page("<p>Alone", host="single.org")),
        (6, "https://a.org/", None),
        (7, None, ""),
        (8, "not a url", "just text &am"),
        (9, "https://a.org/z", "<article><p>cut &amp"),
        (10, "https://a.org/y", "<article><p>whole<footer>x</footer><p class='"),
        (None, "https://a.org/y", "<article>" + "<p>long</p>" * 20_000),
        (1, *page("<article><h1>again</h1></article>")),
    ]
    frame = spark.createDataFrame([(*p, "w") for p in pages], "page_id long, url string, html string, wrapper string").repartition(3)
    got = sorted(((r.page_id, r.text) for r in wr.extract(frame).collect()), key=repr)
    assert got == sorted([
        (1, "A & B\nOne two!\nThree <x>\ni\nj"), (2, "C\nD e"), (3, "Top\nOwn text one"), (4, "Other\nOwn text two"), (5, "Alone"),
        (6, ""), (7, ""), (8, "just text &am"), (9, "cut &"), (10, "whole"), (None, "\n".join(["long"] * 20_000)), (1, "again"),
    ], key=repr)
    assert wr.extract(frame.where("false")).count() == 0


def test_alignment():
    folded = wr.fold_repeats("ul li # li # li # /ul".split())
    assert folded == ["ul", "(li #)+", "/ul"]
    once = [(k, False) for k in "ul li # /ul".split()]
    assert wr.expression(wr.align(once, [(k, False) for k in folded])) == "ul (li #)+ /ul"
    more = [(k, False) for k in "ul li # /ul p #".split()]
    assert wr.expression(wr.align(once, more)) == "ul li # /ul (p)? (#)?"


def test_bare_text_behind_end_tags_that_may_be_left_out(spark):
    bodies = [
        ("<article><p>a</p>tail <b>bold</b><p>b</p>end</article>", "a\ntail bold\nb\nend"),
        ("<article><ul><li>a</li>tail<li>b</li>end</ul></article>", "a\ntail\nb\nend"),
        ("<article><table><tr><td>a</td>tail<td>b</td></tr>row</table></article>", "a\ntail\nb\nrow"),
        ("<article><dl><dt>a</dt>x<dd>b</dd>y</dl></article>", "a\nx\nb\ny"),
    ]
    pages = [(k, *page(body, host=f"h{k}.org")) for k, (body, _) in enumerate(bodies)]
    got = wr.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: text for k, (_, text) in enumerate(bodies)}
    assert wr.blocks("<article><p>a</p>tail</article>")[0] == ["article", "p", "#article/p", "#article", "/article"]


def test_content_is_decided_per_page(spark):
    def plain(own, host):
        return f"https://{host}/p", f"<html><body><div class=body><p>{own}</p></div><div>Every page says this</div></body></html>"

    pages = [
        (1, *page("<article><p>in a region</p></article>", host="mixed.org")),
        (2, *plain("own text one", "mixed.org")),
        (3, *plain("own text two", "mixed.org")),
        (4, None, "<article><p>no host</p></article>"),
        (5, "no host", "<div><p>another without one</p></div>"),
        (6, *plain("held twice", "copies.org")),
        (7, *plain("held twice", "copies.org")),
        (8, "https://names.org/", "<body class='page with-sidebar'><article class='post has-comments'><p>one</p></article></body>"),
        (9, "https://names.org/", "<body id=search><main role='alert'><p>two</p></main><div class='side-bar sidebar'>no</div></body>"),
        (10, "https://div.org/", "<body><div class='grid has-sidebar'><p>three</p><div class=left-sidebar>no</div></div></body>"),
        (11, *plain("always", "constant.org")),
        (12, *plain("always", "constant.org")[:1], plain("always", "constant.org")[1].replace("</body>", "<p>more</p></body>")),
    ]
    both = "\nEvery page says this"
    got = wr.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == {
        1: "in a region", 2: "own text one", 3: "own text two", 4: "no host", 5: "another without one",
        6: "held twice" + both, 7: "held twice" + both, 8: "one", 9: "two", 10: "three", 11: "always" + both, 12: "more",
    }
