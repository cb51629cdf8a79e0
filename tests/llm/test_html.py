"""Extraction: what an article keeps and loses, pages without marks, damaged markup, and the whole test table against a plain reading."""

import html as entities
import re
import tracemalloc

import pytest

from corvane.llm import html

SF = "/root/testdata/sf0.001"
LONG = "Long text, with points, and more of it. " * 20
BODY = LONG.strip()

KEPT = {
    "self-closed drawing": ('<article><p>First para.</p><svg class="i"/><p>Second para.</p></article>', "First para.\n\nSecond para."),
    "drawing never closed": ("<article><p>First para.</p><svg class=i><path d=x><p>Second para.</p></article>", "First para.\n\nSecond para."),
    "nested drawings": ("<article><p>First para.</p><svg><svg><text>in</text></svg><text>out</text></svg><p>Second para.</p></article>", "First para.\n\nSecond para."),
    "frames and templates": ("<article><p>One.</p><iframe src=x/><p>Two.</p><template><p>Three.</p><noscript>no</noscript><object/><p>Four.</p></article>", "One.\n\nTwo.\n\nThree.\n\nFour."),
    "formula": ("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then so.</p></article>", "If x=2 then so."),
    "headline's box": (f'<article><div class="entry-header"><h1>Title here</h1></div><p>{LONG}</p></article>', f"Title here\n\n{BODY}"),
    "header in article": (f"<body><header><h1>Site</h1></header><article><header><h1>Title here</h1></header><p>{LONG}</p></article></body>", f"Title here\n\n{BODY}"),
    "warning paragraph": (f'<article><p>{LONG}</p><p class="alert">Do not heat above 40 degrees.</p></article>', f"{BODY}\n\nDo not heat above 40 degrees."),
    "related work": (f'<article><p>{LONG}</p><section class="related-work"><h2>Related work</h2><p>Others did it before.</p></section></article>', f"{BODY}\n\nRelated work\n\nOthers did it before."),
    "form around a page": (f"<body><form action=x><div class=menu><a href=/>Home</a></div><div class=text><h1>Title</h1><p>{LONG}</p><p>Short.</p></div></form></body>", f"Title\n\n{BODY}\n\nShort."),
    "lead in a section": (f"<article><div class=lead><p>Short lead</p></div><div class=text><p>{LONG}</p></div><div class=links><a href=/>Other pages</a></div></article>", f"Short lead\n\n{BODY}"),
    "lists and tables": (f"<article><p>{LONG}</p><ul><li>One<li>Two</ul><table><tr><td>a<td>b</table></article>", f"{BODY}\n\nOne\n\nTwo\n\na\n\nb"),
    "references": ("<article><p>A&amp;B &lt;c&gt; &eacute;&#233;&nbsp;d &unknown; e</p></article>", "A&B <c> éé d &unknown; e"),
    "body's marks": (f'<body class="single has-sidebar comments-open"><article class="post comments-closed"><p>{LONG}</p></article></body>', BODY),
    "reader comments": (f"<article><h1>T</h1><p>{LONG}</p><section id=comments><h2>Comments</h2><article class=comment><p>{LONG} I agree.</p></article></section></article>", f"T\n\n{BODY}"),
}
DROPPED = {
    "parts": f"""<body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies, really, all the time.</div><main><div class="breadcrumbs"><a>a</a></div>
    <article><h1>T</h1><p>{LONG}</p><div class="ad-slot"><p>Buy this, now, it is good.</p></div><aside>Aside, with text.</aside><form><p>Name</p><label>Mail</label></form><div class=share><a>Share</a></div></article>
    <div class=sidebar><p>{LONG}</p></div></main><footer>&copy; Us</footer></body>""",
    "no article": f"""<html><body><div id=wrap><div class=top>Site name</div><div class=menu><a href=/>x</a></div><div class=content><h1>T</h1><p>{LONG}</p></div>
    <div class=col><ul><li><a href=/1>One page</a></li><li><a href=/2>Another page</a></li></ul></div><div class=end>Copyright us</div></div></body></html>""",
    "small mark": f"""<body><div class=text><h1>T</h1><p>{LONG}</p></div><div class=teasers><article><a href=/1>Read on.</a></article></div></body>""",
    "role": f"<body><div role=navigation>Menu, and more, and more.</div><div role=banner>Site</div><div role=main><h1>T</h1><p>{LONG}</p></div><div role=contentinfo>Us, here.</div></body>",
    "hidden code": f"<body><script>var a='<p>';</script><style>p>a{{}}</style><article><h1>T</h1><p>{LONG}<script>x('</p>')</script></p></article><script src=x>",
}


@pytest.mark.parametrize("case", KEPT)
def test_kept(case):
    page, text = KEPT[case]
    assert html.main_text(page) == text


@pytest.mark.parametrize("case", DROPPED)
def test_dropped(case):
    assert html.main_text(DROPPED[case]) == f"T\n\n{BODY}"


def test_path_scores_decide():
    """The same sections without a mark or a telling name: which one is read follows their text, and so do the sections of one page."""
    page = lambda a, b: f"<body><div class=x><p>{a}</p></div><div class=y><p>{b}</p></div></body>"
    assert html.main_text(page(LONG, "Few words")) == BODY and html.main_text(page("Few words", LONG)) == BODY
    assert html.main_text(page(LONG, LONG)) == f"{BODY}\n\n{BODY}"
    links = "".join(f"<a href=/{i}>{LONG}</a>" for i in range(3))
    assert html.main_text(page(LONG, links)) == BODY


def test_damaged_pages():
    assert html.main_text("") == "" and html.main_text("plain &lt; text\n here") == "plain < text here"
    assert html.main_text("<p>a</p><p") == "a" and html.main_text("<!-- open <p>x</p>") == "" and html.main_text("a < b > c") == "a < b > c"
    assert html.main_text("</div></p><p>x</b></p>") == "x"


def test_deep_and_long_pages():
    tracemalloc.start()
    deep = "<div>" * 50000 + "x" + "</b>" * 50000 + "</div>" * 50000
    assert html.main_text(deep) == "x"
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert html.main_text("<b>" * 50000 + "x<p>y") == "x\n\ny"
    assert html.main_text("<p>x</p>" * 20000).count("x") == 20000


def plainly(page):
    """The article of the test table's flat pages: its tags' blocks, by plain cutting."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", inner)
    texts = (" ".join(entities.unescape(re.sub(r"<br\s*/?>", " ", x).replace("<b>", "").replace("</b>", "")).split()) for x in parts)
    return "\n\n".join(t for t in texts if t)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: plainly(r.html) if r.html and "<article>" in r.html else None for r in pages.collect()}
    found = {r.page_id: r for r in html.extracted(pages).collect()}
    assert len(found) == len(want) and sum(w is not None for w in want.values()) > 0.9 * len(want)
    assert [i for i, w in want.items() if w is not None and found[i].text != w] == []
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_edges(spark):
    schema = "page_id int, url string, html string, text int, host string"
    rows = [(1, "u", None, 1, "h"), (2, None, "<p>a</p>", 2, "h"), (2, None, "<p>a</p>", 2, "h"), (None, "u", "<p", 3, None), (3, "u", "", None, None)]
    found = [tuple(r) for r in html.extracted(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(found, key=repr) == sorted([(1, "u", "", 0), (2, None, "a", 1), (2, None, "a", 1), (None, "u", "", 0), (3, "u", "", 0)], key=repr)
    assert html.extracted(spark.createDataFrame([], schema)).collect() == []


SAID = "A first paragraph, long enough, stands here."


@pytest.mark.parametrize("name", ["comments-on-methods", "social-history", "share-prices", "search-results-analysis", "menu", "promo-analysis", "paywall", "related-work", "cookie-recipes", "nav-theory"])
def test_names_with_other_words_drop_nothing(name):
    for tag in ("div", "section"):
        assert html.main_text(f"<article><p>{SAID}</p><{tag} class='{name}'><p>Some words, kept.</p></{tag}></article>") == f"{SAID}\n\nSome words, kept."


@pytest.mark.parametrize("name", ["comments", "comment-list", "social-links", "share-buttons", "ad-slot", "related-posts", "cookie-banner", "newsletter-signup", "nav-menu", "sign-up", "log-in-form", "sideBar", "ad-300x250", "advert"])
def test_names_of_widgets_alone(name):
    assert html.main_text(f"<article><p>{SAID}</p><div class='{name}'><p>Some words, gone.</p></div></article>") == SAID


def test_headline_before_an_unmarked_text():
    body = "".join(f"<p>Paragraph {i}, with commas, which is long, stands here.</p>" for i in range(6))
    page = "<body><div class=top><a href=x>Home</a> <a href=y>News</a></div><div class=hero><h1>Headline</h1><p>Standfirst words.</p></div><div class=x>" + body + "</div></body>"
    found = html.main_text(page).split("\n\n")
    assert found[:2] == ["Headline", "Standfirst words."] and len(found) == 8


def test_controls_do_not_cut_a_paragraph():
    assert html.main_text("<article><p>Press <button>now</button>, please.</p></article>") == "Press , please."


def test_unclosed_elements_are_linear():
    import time

    def took(n):
        began = time.perf_counter()
        html.main_text("<article><p>x</p>" + "<iframe src=x>" * n + "</article>")
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 3
