import re
from html import unescape
from itertools import product

import numpy as np
import pytest

from curbflow.llm import html_extract as h

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def crf(spark):
    return h.train_crf(spark.read.parquet(PAGES), 200)


def article(html):
    """The article of a generated page, cut out by its known skeleton."""
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
    return "\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)


def test_extracts_every_article_whole(spark, crf):
    pages = spark.read.parquet(PAGES)
    want = {r.page_id: article(r.html) for r in pages.collect()}
    for r in h.extract_pages(pages, crf).collect():
        assert r.text == want[r.page_id]
        assert r.n_chars == len(r.text)


def test_other_layouts(crf):
    page = """<html><head><title>x</title></head><body>
    <div class="cookie-banner">We use cookies to give you the best. Accept all of them.</div>
    <header class="site"><a href=/>Home</a> <a href='/b'>News</a></header>
    <div class="main-content"><h1>Title &lt;of&gt; it</h1>
    <p>Some words are here, and   they form a sentence.\n Another one follows &amp; ends.
    <div class="ad">Buy now the thing, it is good.</div>
    <p>Second paragraph of the story, with <b>more</b> words &#233; in it.</p></div>
    <aside class="sidebar"><p>Related stories of the day, with many words in it.</p></aside>
    <section class="comments"><p>A reader says that this is great, and so on.</p></section>
    <form><p>Leave a reply here.</p></form>
    <script>document.write("<p>no</p>")</script><footer>&copy; 2020 all rights</footer></body>"""
    assert h.main_text(page, crf, {}) == (
        "Title <of> it\n"
        "Some words are here, and they form a sentence. Another one follows & ends.\n"
        "Second paragraph of the story, with more words é in it."
    )


def test_odd_pages(spark, crf):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<"), (4, "u", "a < b <p"), (5, "u", "<!-- x"),
            (6, "u", "<script>x"), (None, "u", "<article><p>" + "word, " * 100_000), (5, "u", "</p>")]
    pages = spark.createDataFrame(
        [(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int"
    )
    got = h.extract_pages(pages, crf).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id != 5}
    assert by[1].text == by[2].text == by[6].text == ""
    assert by[None].n_chars == 6 * 100_000 - 1
    assert h.extract_pages(pages.limit(0), crf).count() == 0
    assert h.train_crf(pages.limit(0)) is None
    assert h.main_text("<p>a</p>b", None, {}) == "a\nb"


def test_viterbi_equals_enumeration():
    pick = np.random.default_rng(2)
    for _ in range(30):
        model = h.Crf({}, pick.normal(size=(2, 2)), float(pick.normal()))
        scores = pick.normal(size=6).tolist()

        def total(states):
            return (
                sum(s for s, y in zip(scores, states) if y)
                + model.first * states[0]
                + sum(model.pairs[a, b] for a, b in zip(states, states[1:]))
            )

        assert h.viterbi(scores, model) == list(max(product((0, 1), repeat=6), key=total))


def test_training_fits_a_chain():
    """Labels that follow their neighbours, not their own features, need the pair weights."""
    pick = np.random.default_rng(4)
    pages, labels = [], []
    for _ in range(150):
        n, start = int(pick.integers(4, 9)), int(pick.integers(1, 3))
        states = [int(k >= start) for k in range(n)]
        pages.append([["begin"] if k == start else ["same"] for k in range(n)])
        labels.append(states)
    model = h.fit_crf(pages, labels, 300)
    for blocks, states in zip(pages, labels):
        scores = [sum(model.weights[f] for f in b) for b in blocks]
        assert h.viterbi(scores, model) == states
