"""HTML extraction on pages of the shapes that sites have, where the blocks' own log-odds
err and the cut mends them; and whole texts of the test pages."""

import html
import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestone.llm import html_text

LONG = "The committee met on Tuesday to go through the long list of open questions, and most of them were settled before noon."
MORE = "Nobody had expected the talks to take a turn like this, least of all those who had been there from the start."
# of each page, what of it is content, in order: marked by « »
PAGES = {
    "plain divisions": f"""<body class="single has-sidebar"><div id="top"><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div class="wrap"><div class="left">
        <h1>«Talks end early»</h1><div>«{LONG}»</div><div>«So be it»</div><div>«{MORE}»</div><div>«Agreed»</div><div>«{LONG} {MORE}»</div></div>
        <div class="sidebar"><div>Most read</div><ul><li><a href=1>One thing that people read</a><li><a href=2>Another one</a></ul></div></div>
        <div id="foot"><a href=/c>Contact</a> <a href=/i>Imprint</a></div>""",
    "short lines between paragraphs": f"""<body><div class="navbar"><a href=/>Start</a></div><section><h2>«A walk»</h2><p>«{LONG}»<p>«Yes»<p>«{MORE}»<div>«I»</div><p>«{LONG}»<div>«II»</div><p>«{MORE}»</section>
        <div class="share-buttons"><span>Share this</span></div><div class="cookie-banner">We use cookies to make this site better for you. You can accept them or read more about them.</div>""",
    "a list and a table of the article": f"""<article><h1>«Steps»</h1><p>«{LONG}»<ul><li>«Flour»<li>«Water»<li>«<a href=s>Salt</a>, a pinch»</ul><table><tr><td>«oven»<td>«200»<tr><td>«time»<td>«40»</table><p>«{MORE}»</article>
        <aside><h3>Related</h3><article><h3>Other recipes that you may like to try.</h3><p>{MORE}</article></aside>""",
    "notes inside the article": f"""<main><h1>«Report»</h1><p>«{LONG}»<div class="newsletter-signup"><p>Get the best of our news by mail, every morning, free of charge.</div><p>«{MORE}»<aside><p>{LONG}</aside><p>«{LONG}»
        <div id="comments"><h2>3 comments</h2><div class="comment"><p>{MORE}</div></div></main><form><label>Search</label><input></form><footer><p>{LONG}</footer>""",
    "a title alone before its text": f"""<div class="masthead">The Daily</div><div><h3>«Weather»</h3><div>«{LONG}»</div><div>«{MORE}»</div></div><div class="pagination"><a href=1>1</a> <a href=2>2</a></div><div style="display: none">{LONG}</div>""",
    "words of layout": f"""<body class="search-open"><div class="content-with-sidebar"><article><h1>«Name»</h1><p>«{LONG}»</article></div><div role="complementary"><p>{MORE}</div><div role="contentinfo">Made by hand. All rights are reserved by us.</div>""",
    "unclosed head": f"""<html><head><title>T</title><p>«{LONG}»<p>«Short»<p>«{MORE}»""",
}


def wanted(page):
    return "\n".join(" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.findall("«(.*?)»", page, re.S))


@pytest.mark.parametrize("name", PAGES)
def test_content_of_pages(name):
    page = PAGES[name]
    assert html_text.main_text(re.sub("[«»]", "", page)) == wanted(page)


def test_the_cut_decides():
    """Blocks whose own log-odds are wrong, and that the cut labels right."""
    blocks = [b for page in PAGES.values() for b in html_text.labelled(re.sub("[«»]", "", page))]
    turned = [text for text, score, keep in blocks if keep != (score > 0)]
    print(f"the cut turns {len(turned)} of {len(blocks)} labels")
    assert {"So be it", "Agreed", "Yes", "I", "II"} <= set(turned)


def given() -> list[str]:
    path = "/root/testdata/sf0.1/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    return pq.read_table(path, columns=["html"]).column(0).to_pylist()


def of_articles(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1|ul|li|h2|div)\b[^>]*>", inner)]
    return [x for x in parts if x]


def test_articles_of_the_test_pages():
    """Each test page's text is that of its article element."""
    for page in given():
        assert html_text.main_text(page) == "\n".join(of_articles(page))


def test_classifier_and_cut(spark):
    """With learned weights, which see no element around a block, blocks err by themselves and
    the cut mends all of it, on the given pages and on those above."""
    pages = given()
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    weights = html_text.fit(df)
    assert weights == html_text.fit(df.repartition(5)) and weights != html_text.PRIOR
    blocks = turned = alone = 0
    for page in pages:
        found = html_text.labelled(page, weights)
        want = "\n".join(of_articles(page))
        assert "\n".join(text for text, _, keep in found if keep) == want
        blocks += len(found)
        turned += sum(keep != (score > 0) for _, score, keep in found)
        alone += "\n".join(text for text, score, _ in found if score > 0) == want
    print(f"the cut turns {turned} of {blocks} labels; without it {alone} of {len(pages)} pages are right")
    assert turned > 0.01 * blocks and alone < 0.8 * len(pages)
    for page in PAGES.values():
        assert html_text.main_text(re.sub("[«»]", "", page), weights) == wanted(page)


def test_fit_on_odd_tables(spark):
    """Pages without an article or main element, null ones and none give the fixed weights;
    repeated rows and columns of clashing names or without a hash do not matter."""
    kind = "html string, hash string, x int, m map<string,int>"
    page = re.sub("[«»]", "", PAGES["a list and a table of the article"])
    none = spark.createDataFrame([(None, "h", 1, {}), ("", None, None, None), ("<p>Some text.", "h", 1, {"a": 1})], kind)
    assert html_text.fit(none) == html_text.fit(none.limit(0)) == html_text.PRIOR
    many = html_text.fit(spark.createDataFrame([(page, "h", 1, {})] * (html_text.PAGES + 500), kind).repartition(3))
    same = html_text.fit(spark.createDataFrame([(page, "h", 1, {})] * html_text.PAGES, kind))
    assert many == pytest.approx(same) and many != html_text.PRIOR


def test_weights_by_slow_descent():
    """Newton's weights are where the penalised likelihood has no slope."""
    rng = np.random.default_rng(3)
    x = rng.random((400, len(html_text.PRIOR)))
    y = rng.random(400) < 0.4
    w = np.array(list(html_text.learned(x, y).values()))
    start = np.array(list(html_text.PRIOR.values()))
    cost = lambda v: np.sum(np.logaddexp(0, x @ v) - y * (x @ v)) + np.sum((v - start) ** 2) / (2 * html_text.VARIANCE)
    for k in range(len(w)):
        for d in (1e-3, -1e-3):
            other = w.copy()
            other[k] += d
            assert cost(other) > cost(w)


def test_long_pages_are_learned_from_evenly():
    page = "<article>" + "<p>One.<p>Two" * 1000 + "</article>"
    x, y = html_text.examples(page)
    assert len(x) <= html_text.BLOCKS and len(x) == len(y) and y.all() and html_text.examples(page, masked=True)[0][:, 4:].sum() == 0
    assert [len(z) for z in html_text.examples("")] == [0, 0]
