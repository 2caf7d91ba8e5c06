import html
import re

import pytest

from lurescope.llm.html import (Page, extract, extract_pages, forest, marginals, prior_model, train)

SF = "/root/testdata/sf0.01"
PAGE = """<html><head><title>T</title><style>x</style></head><body class="page">
<header id="masthead"><a href=/>Site</a><nav><a>Home</a> <a>News</a></nav></header>
<div class="cookie-notice">We use cookies to track you. Accept, please, all of them.</div>
<div id="sidebar"><h3>Related stories</h3><ul><li><a href=1>One thing</a><li><a href=2>Other</a></ul></div>
<div class="post-content"><h1>A title &amp; more</h1><p>First paragraph of the text, with some
<b>bold</b>&nbsp;words. It goes on.<p>Second paragraph; also a long one, with commas, and stops.
<ul><li>an item in a list of the text</li><li>another item here</li></ul>
<script>var a="<p>no</p>";</script><!-- hidden <p>no</p> --><blockquote>Quoted words by someone.</blockquote></div>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I like this article, it is great.</p></div></section>
<form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2024 Site. All rights.</footer></body></html>"""
TEXT = ("A title & more First paragraph of the text, with some bold words. It goes on. Second paragraph; "
        "also a long one, with commas, and stops. an item in a list of the text another item here "
        "Quoted words by someone.")


def truth(source):
    """The article element's text, for pages of the table's own layout."""
    inner = re.search(r"<article>(.*)</article>", source, re.S).group(1)
    parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", inner))
    return " ".join(" ".join(html.unescape(x) for x in parts).split())


@pytest.fixture(scope="module")
def sources(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]


def test_held_out_pages(sources):
    model = train(sources[:100])
    assert [extract([s], model)[0] for s in sources[100:]] == [truth(s) for s in sources[100:]]


def test_pages_without_article_mark_up(sources):
    model = train(sources[:100])
    bare = [s.replace("<article>", "<div>").replace("</article>", "</div>") for s in sources[100:]]
    words = right = extra = 0
    for s, b in zip(sources[100:], bare):
        want, got = truth(s).split(), extract([b], model)[0].split()
        words += len(want)
        right += len(set(want) & set(got)) / max(len(set(want)), 1)
        extra += bool(set(got) - set(want))
    assert right / len(bare) > 0.97 and extra / len(bare) < 0.05


@pytest.mark.parametrize("trained", [False, True])
def test_other_layouts(sources, trained):
    assert extract([PAGE], train(sources[:100]) if trained else prior_model()) == [TEXT]


LONG = "This sentence is long enough, with commas, and full stops. It goes on for a while, as such texts do. " * 8
SAYS = ("<p>The first paragraph of the article itself, which is plain text. It has two sentences.</p>"
        "<p>The second paragraph follows, as long as the first one, and it ends here.</p>")
OUT = ['<section class="comments"><p>{}</p></section>', '<div id="comments"><div><p>{}</p></div></div>', "<footer><p>{}</p></footer>",
       "<aside><p>{}</p></aside>", '<div class="sidebar"><p>{}</p></div>', '<div class="sidebar"><div><div><p>{}</p></div></div></div>',
       '<div class="ad"><p>{}</p></div>', '<div class="wrap"><div class="cookie-banner"><div><p>{}</p></div></div></div>',
       "<form><p>{}</p></form>", '<p class="notice">{}</p>', '<nav><p>{}</p></nav>', '<div style="display: none"><p>{}</p></div>',
       '<ul class="comment-list"><li><p>{}</p></li></ul>', '<div class="newsletter"><h3>Join</h3><p>{}</p></div>']


@pytest.mark.parametrize("trained", [False, True])
def test_mark_up_decides_before_length(sources, trained):
    """Boilerplate with paragraphs, short and long, beside and inside the article."""
    model = train(sources[:100]) if trained else prior_model()
    want = extract([f"<body><article><h1>Title</h1>{SAYS}</article></body>"], model)[0]
    assert want.startswith("Title The first") and want.endswith("ends here.")
    wrong = []
    for layout in OUT:
        for text in (LONG[:104], LONG):
            bad = layout.format(text)
            pages = {"after": f"<body><article><h1>Title</h1>{SAYS}</article>{bad}</body>",
                     "before": f"<body>{bad}<main><h1>Title</h1>{SAYS}</main></body>",
                     "inside": f"<body><article><h1>Title</h1>{SAYS}{bad}</article></body>",
                     "no mark-up": f'<body><div class="post"><h1>Title</h1>{SAYS}</div>{bad}</body>'}
            wrong += [(layout, len(text), k) for k, page in pages.items() if extract([page], model)[0] != want]
    assert not wrong


@pytest.mark.parametrize("trained", [False, True])
@pytest.mark.parametrize("page", [
    '<body class="page has-sidebar"><article><h1>Title</h1>{}</article></body>',
    '<body><div class="content-with-sidebar"><article><h1>Title</h1>{}</article></div></body>',
    '<body><form id="aspnetForm"><main><h1>Title</h1>{}</main></form></body>',
    '<body><form id="f"><div class="post"><h1>Title</h1>{}</div></form></body>',
    '<body><article><div class="entry-header"><h1>Title</h1></div>{}</article></body>',
    '<body><article><header><h1>Title</h1></header>{}</article></body>'])
def test_wrappers_and_heads_of_the_article_stay(sources, trained, page):
    model = train(sources[:100]) if trained else prior_model()
    assert extract([page.format(SAYS)], model) == extract([f"<body><article><h1>Title</h1>{SAYS}</article></body>"], model)


@pytest.mark.parametrize("trained", [False, True])
def test_links_in_an_article_are_text(sources, trained):
    model = train(sources[:100]) if trained else prior_model()
    page = f"<body><article>{SAYS}<ul><li><a href=1>First point</a></li><li><a href=2>Second point</a></li></ul></article></body>"
    assert extract([page], model)[0].endswith("ends here. First point Second point")


def test_sum_product_equals_enumeration():
    model = prior_model()
    f = forest([Page("<div><p>Some text, here.</p><nav><a>x</a></nav></div>")])
    import itertools

    import numpy as np
    score, n = f.x @ model.weights, len(f.parent)
    total, on = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = sum(score[i] * y[i] for i in range(n))
        w += sum(model.edges[f.kind[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0)
        total += np.exp(w)
        on += np.exp(w) * np.array(y)
    assert np.allclose(on / total, marginals(f, model))


def test_defined_results(spark):
    deep = "<div>" * 20_000 + "<p>A long enough paragraph of text, at the bottom of it. Yes.</p>"
    rows = [(None, None, None, 1), (1, "u", "", 2), (2, "u", "just text &lt;", 3), (3, None, PAGE, 4),
            (3, None, PAGE, 4), (4, "u", "<article><p>Cut off in a tag, as it is. <b", 5),
            (5, "u", "<script>never closed <p>no</p>", 6), (6, "u", deep, 7),
            (7, "u", "<article><p>" + "many words, in a row. " * 50_000, 8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = extract_pages(df).collect()
    assert len(got) == len(rows)
    by = {r.id: r.text for r in got}
    assert by[None] == by[1] == by[5] == "" and by[2] == "just text <"
    assert by[4].startswith("Cut off") and len(by[7].split()) == 250_000
    assert sum(r.text == TEXT for r in got) == 2
    assert extract_pages(df.limit(0)).count() == 0


def test_whole_table(spark, sources):
    from lurescope.llm.queries import op5_html_text
    got = [r for r in op5_html_text(spark, SF).orderBy("page_id").collect()]
    assert [r.text for r in got] == [truth(s) for s in sources]
    assert all(r.n_chars == len(r.text) for r in got)
