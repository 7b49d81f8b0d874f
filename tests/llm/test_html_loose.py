import time

import pytest

from curbflow.llm import html_extract as h


@pytest.mark.parametrize(
    "html, want",
    [
        ('<p>one <svg class="i"/> two</p><p>three</p>', "one two|three"),
        ("<p>one <svg><title>icon</title><g><text>no</text></g></svg> two</p><p>three</p>", "one two|three"),
        ("<p>one <svg><title/><style/><path d=x/></svg> two</p><p>three</p>", "one two|three"),
        ("<p>one <svg><path d=x></p><p>three</p>", "one|three"),
        ("<p>one</p><svg><path d=x/><p>two</p><p>three</p>", "one|two|three"),
        ("<p>one</p><svg><foreignObject><p>no</p></foreignObject></svg><p>three</p>", "one|three"),
        ("<p>one <object data=x /> two</p><p>three</p>", "one two|three"),
        ("<p>one <iframe src=x></iframe> two</p><iframe src='y'/><p>three</p>", "one two|three"),
        ("<title-card><p>one</p></title-card><p>three</p>", "one|three"),
        ("<object-list><p>one</p></object-list><p>three</p>", "one|three"),
        ("<p>one</p><button>no<p>two</p><p>three</p>", "one|two|three"),
        ("<p>one <button>no</p><p>three</p>", "one|three"),
        ("<p>one</p><button>no<p>two</p><button>no</button><p>three</p>", "one|two|three"),
        ("<p>one</p><button><div>no</div></button><p>three</p>", "one|three"),
        ("<p>one</p><select><option>no<option>no<p>three</p>", "one|three"),
        ("<p>one</p><select><option>no</option></select><p>three</p>", "one|three"),
        ("<p>one</p><noscript><p>no</p></noscript><template><p>no</p></template><p>three</p>", "one|three"),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p><p>three</p>", "if x=2 then|three"),
        ("<p>a <math><semantics><mi>x</mi><annotation>no</annotation></semantics></math></p>", "a x"),
        ("<p>one <math/> two</p><p>three</p>", "one two|three"),
        ("<p>one<script>'<p>'</script > two</p><p>three</p><style>x", "one two|three"),
        ("<p>one</p><!-- <svg> --><p>three</p><textarea><p>no", "one|three"),
    ],
)
def test_loose_markup_keeps_the_rest_of_the_article(html, want):
    page = f"<html><body><article>{html}</article><footer>end</footer></body></html>"
    blocks = h.leaf_blocks(page)
    assert "|".join(b.text for b in blocks if h.markup_label(b.path)) == want


def test_many_open_elements_take_linear_time():
    page = "<article>" + "<svg><g><button>x <object>" * 20_000 + "<p>one</p></article>"
    assert h.leaf_blocks(page)[-1].text == "one"


@pytest.mark.parametrize(
    "unit",
    ['<a "', "<a '\"", "<div><p>", "<div><p>x", '<div class="c">y', "</div ", "<!x", "<svg></math>",
     "<div>x</p></td>", "<p class=a id=", "&#", "<b>x<object><i>"],
)
def test_a_megabyte_of_loose_markup_takes_linear_time(unit):
    page = "<article><p>one</p></article>" + unit * (1_000_000 // len(unit))
    model = h.Crf({"in:p": 1.0, "in:div": -2.0}, h.np.zeros((2, 2)), 0.0)
    start = time.process_time()
    text = h.main_text(page, model, {})
    assert time.process_time() - start < 5
    assert text.split("\n")[0] == "one"


def test_deep_elements_of_many_classes_take_linear_time():
    page = "<p>one</p>" + "".join(f'<div class="{letters(k)}">x' for k in range(40_000))
    model = h.Crf({"word:ab": 1.0, "in:p": 1.0, "in:div": -2.0}, h.np.zeros((2, 2)), 0.0)
    start = time.process_time()
    assert h.main_text(page, model, {}) == "one"
    assert time.process_time() - start < 5


def letters(k):
    out = ""
    while k or not out:
        out, k = out + chr(97 + k % 26), k // 26
    return out


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>&#" + "9" * 5000 + "; a</p>", "� a"),
        ("<p>&#" + "0" * 5000 + "65; a &#65;&#x42;</p>", "A a AB"),
        ("<p>a<b x='>' y=\">\">c</b> d</p>", "ac d"),
        ("<p>a<b x='>c</b> d</p>", "ac d"),
        ("<p>a<b x=\"'>c</b>'\" d</p>", "a"),
        ("<p>a <!-- x > --> b <!DOCTYPE c> <?d e?> </> f", "a b f"),
        ("<p>a < b <c", "a < b <c"),
        ("<p>a <!", "a <!"),
    ],
)
def test_tags_quotes_and_references(html, want):
    assert [b.text for b in h.leaf_blocks(html)] == [want]


def test_path_scores_equal_sums_over_path_features():
    pick = h.np.random.default_rng(5)
    tags = ["div", "p", "section", "ul", "li", "article", "td", "aside"]
    weight: dict[str, float] = {}
    page = []
    for _ in range(3000):
        tag, word = tags[pick.integers(8)], "abcd"[pick.integers(4)]
        page.append(("</%s>t " % tag) if pick.random() < 0.4 else f'<{tag} class="{word} x{word}">t ')
    blocks = h.leaf_blocks("".join(page))
    assert len(blocks) > 1000
    for b in blocks:
        for f in h.path_features(b.path):
            weight.setdefault(f, float(pick.normal()))
    for b in blocks:
        want = sum(weight[f] for f in h.path_features(b.path))
        assert h._path_score(b.within, weight) == pytest.approx(want)


def test_without_a_model_the_markup_decides():
    page = "<header>h</header><div><p>a</p><div class='user-opinions'><p>b</p></div></div><footer>c</footer>d"
    assert h.main_text(page, None, {}) == "a\nd"


def test_long_training_pages_are_learnt_from_at_both_ends():
    blocks = h.leaf_blocks("<p>x</p>" * 1000)
    pieces = h._pieces(blocks, 1)
    assert len(pieces) == h.TRAIN_PIECES and max(map(len, pieces)) == h.TRAIN_BLOCKS
    assert pieces[0][0] is blocks[0] and pieces[-1][-1] is blocks[-1]
    assert h._pieces(blocks[:50], 1) == [blocks[:50]]
