"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import hash_sample

SAMPLE_PAGES = 300  # bound on the pages that training sees
LAYOUTS = 4  # layouts that each training page is given besides its own
TRAIN_BLOCKS = 60  # longer training pages are learnt from in pieces of so many blocks ...
TRAIN_PIECES = 4  # ... of which so many at most, the first, the last and others by chance

# Roles of HTML elements.
RAW = frozenset("script style textarea title".split())  # up to the end tag or the page end
# Elements whose content is not shown as text of the page.
MUTE = frozenset(
    "template noscript svg iframe object select button annotation annotation-xml".split()
)
FOREIGN = frozenset(("svg", "math"))  # here "/>" closes an element
ALONE = frozenset(("button", "select"))  # never inside one of their kind
MATH = frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
    "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Start tags that end an svg that is still open.
LEAVES_SVG = CLOSES_P | frozenset(
    "b big body br center code dd dt em embed head i img li meta ruby s small span strike strong "
    "sub sup tt u var".split()
)
NOT_MAIN_TAGS = frozenset("nav header footer aside form head menu dialog".split())
# Words in class, id or role that mark other parts of a page.
NOT_MAIN_WORDS = frozenset(
    "ad ads advert advertisement sponsor promo banner cookie consent notice alert popup modal "
    "sidebar side aside widget related recommended menu nav navigation navbar breadcrumb "
    "header masthead footer bottom comment comments reply replies discussion disqus share "
    "social newsletter subscribe login signup search form toolbar pagination opinions voices "
    "feedback remarks responses thoughts guestbook readers thread".split()
)
MAIN_WORDS = ("content", "article", "post", "entry", "main", "body", "story", "text")

_TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*+)", re.I)
_TAG_SIGN = re.compile("[>\"']")
_LONG_ZEROS = re.compile("&#0+(?=[0-9])")
_NO_CHARACTER = re.compile("&#[0-9]{8,};?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    """An open element, linked to the one around it."""

    tag: str
    name: str  # "tag" or "tag.word.word"
    around: "Element | None"
    fresh: tuple[str, ...]  # its features that no element around it has
    other: bool  # it, or one around it, is a part beside the main text
    score: float | None = None  # weights of the features of the whole path


@dataclass(slots=True)
class Block:
    within: Element | None
    text: str
    link_chars: int
    bold_chars: int

    @property
    def path(self) -> tuple[str, ...]:
        """Names of the open elements, outermost first."""
        out, element = [], self.within
        while element is not None:
            out.append(element.name)
            element = element.around
        return tuple(reversed(out))


@dataclass(slots=True)
class Token:
    text: str  # decoded text, of a tag its attributes
    tag: str = ""  # lower case, "" for text
    closing: bool = False
    end: int | None = None  # of a MUTE start tag, the index of its end tag


def _tag_ends(html: str) -> tuple[list[int], list[int | None]]:
    """Places of the characters > " and ', and for each the end of a tag that has it as its next
    such character: ">" outside of quoted values, None if there is none. Read from the end, so
    that a page of unbalanced quotes takes no longer than another."""
    places = [m.start() for m in _TAG_SIGN.finditer(html)]
    ends: list[int | None] = [None] * (len(places) + 1)
    later: dict[str, int] = {}
    for k in range(len(places) - 1, -1, -1):
        sign = html[places[k]]
        if sign == ">":
            ends[k] = places[k]
        else:
            closing = later.get(sign)
            ends[k] = None if closing is None else ends[closing + 1]
            later[sign] = k
    return places, ends


def _decoded(raw: str) -> str:
    if "&" not in raw:
        return raw
    if "&#" in raw:  # numbers beyond all characters, of any length
        raw = _NO_CHARACTER.sub("\ufffd", _LONG_ZEROS.sub("&#", raw))
    return unescape(raw)


def _tokens(html: str) -> list[Token]:
    """Texts and tags in page order. Comments are left out, and RAW elements are a space.

    A tag ends at the next ">" outside of quoted values or, if there is none, at the next ">".
    """
    out: list[Token] = []
    pending: dict[str, list[int]] = {}  # MUTE start tags that wait for their end tag
    foreign: list[str] = []
    inside: Counter[str] = Counter()  # of foreign
    places, ends = _tag_ends(html)
    last = html.rfind(">")
    at = 0
    while at < len(html):
        if html[at] != "<":
            end = html.find("<", at)
            end = len(html) if end < 0 else end
            out.append(Token(_decoded(html[at:end])))
            at = end
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = len(html) if end < 0 else end + 3
            continue
        m = _TAG.match(html, at)
        if m is None or m.end() > last:
            if html[at + 1 : at + 2] in ("!", "?", "/") and at + 2 <= last:
                at = html.index(">", at + 2) + 1
            else:
                out.append(Token("<"))
                at += 1
            continue
        end = ends[bisect_left(places, m.end())]
        if end is None:
            end = html.index(">", m.end())
        at = end + 1
        tag, marks = m.group(2), html[m.end() : end]
        tag = tag.lower()
        closing = bool(m.group(1))
        empty = marks.endswith("/")
        if tag in RAW and not closing and not (empty and foreign):
            found = _RAW_END[tag].search(html, at)
            at = found.end() if found else len(html)
            out.append(Token(" "))
            continue
        if tag in FOREIGN and not (empty and not closing):
            if not closing:
                foreign.append(tag)
                inside[tag] += 1
            elif inside[tag]:
                _pop_to(tag, foreign, inside)
        elif foreign and not closing and tag in CLOSES_P:
            foreign.clear()
            inside.clear()
        if tag in MUTE:
            waiting = pending.setdefault(tag, [])
            if closing:
                if waiting:
                    out[waiting.pop()].end = len(out)
            elif not (empty and tag == "svg"):
                if waiting and (tag in ALONE or out[waiting[-1]].text.endswith("/")):
                    waiting.pop()
                waiting.append(len(out))
        out.append(Token(marks, tag, closing))
    return out


def _pop_to(tag: str, names: list[str], counts: Counter[str]) -> None:
    """Take names off the end of the list, up to and with ``tag``."""
    while True:
        name = names.pop()
        counts[name] -= 1
        if name == tag:
            return


def _after_mute(tokens: list[Token], at: int, opened: Counter[str]) -> int:
    """Index of the token after the content of the MUTE element that starts at ``at``.

    That is after its end tag, but never beyond the end of an element around it; an svg ends
    before a tag that cannot stand in it. Without an end tag the element is empty if it closes
    itself, and ends before the next block-level tag otherwise.
    """
    start = tokens[at]
    if start.end is None and start.text.endswith("/"):
        return at + 1
    inside: list[str] = []
    counts: Counter[str] = Counter()  # of inside
    for k in range(at + 1, len(tokens)):
        token = tokens[k]
        tag = token.tag
        if k == start.end:
            return k + 1
        if not tag:
            continue
        if token.closing:
            if counts[tag]:
                _pop_to(tag, inside, counts)
            elif opened[tag]:
                return k
            continue
        if start.tag == "svg":
            if tag in LEAVES_SVG and not counts["foreignobject"]:
                return k
        elif start.end is None and not (
            tag in INLINE or tag in VOID or tag in MUTE or tag in ("option", "optgroup")
        ):
            return k
        if tag not in VOID and not token.text.endswith("/"):
            inside.append(tag)
            counts[tag] += 1
    return len(tokens)


def element_features(name: str) -> tuple[str, ...]:
    """Of an element as an ancestor: its tag and the words of its classes."""
    tag, *words = name.split(".")
    return (f"in:{tag}", *(f"word:{w}" for w in words))


def leaf_blocks(html: str, known: dict[str, tuple[str, ...]] | None = None) -> list[Block]:
    """Runs of text between block-level tags, in page order, with white space folded and
    character references decoded. Unclosed and stray tags are tolerated. Time grows with the
    page, however deep its elements lie; ``known`` keeps features of element names."""
    blocks: list[Block] = []
    known = {} if known is None else known
    stack: list[Element] = []
    opened: Counter[str] = Counter()  # tags on the stack
    active: set[str] = set()  # features of the elements on the stack
    parts: list[str] = []
    links = bold = 0
    depth_a = depth_b = 0

    def flush() -> None:
        nonlocal links, bold
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                blocks.append(Block(stack[-1] if stack else None, text, links, bold))
            parts.clear()
        links = bold = 0

    def shut() -> Element:
        element = stack.pop()
        opened[element.tag] -= 1
        active.difference_update(element.fresh)
        return element

    tokens = _tokens(html)
    at = 0
    while at < len(tokens):
        token = tokens[at]
        at += 1
        tag, closing = token.tag, token.closing
        if not tag:
            parts.append(token.text)
            if depth_a:
                links += len(token.text)
            if depth_b:
                bold += len(token.text)
            continue
        if tag in MUTE:
            parts.append(" ")
            if not closing:
                at = _after_mute(tokens, at - 1, opened)
            continue
        if tag in MATH:
            if tag in ("mspace", "mtd", "mtr"):
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                depth_a = 0 if closing else 1
            elif tag in ("b", "strong"):
                depth_b = 0 if closing else 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                parts.append(" ")
            continue
        flush()
        depth_a = depth_b = 0
        if closing:
            if opened[tag]:
                while shut().tag != tag:
                    pass
            continue
        if stack and (
            (tag in CLOSES_P and stack[-1].tag == "p") or stack[-1].tag in SIBLINGS.get(tag, ())
        ):
            shut()
        marks = token.text
        name = tag
        if "=" in marks:
            words = []
            for found in _MARKS.finditer(marks):
                words += _WORD.findall((found[1] or found[2] or found[3] or "").lower())
            if words:
                name = ".".join([tag, *dict.fromkeys(words)])
        if not (marks.endswith("/") and tag not in CLOSES_P):
            if name not in known:
                if len(known) > 100_000:
                    known.clear()
                known[name] = element_features(name)
            around = stack[-1] if stack else None
            fresh = tuple(f for f in known[name] if f not in active)
            other = (around is not None and around.other) or _beside(name)
            stack.append(Element(tag, name, around, fresh, other))
            opened[tag] += 1
            active.update(fresh)
    flush()
    return blocks


def path_features(path: tuple[str, ...]) -> list[str]:
    """Tags of all ancestors, the words of their classes, and the nearest element."""
    out = set()
    for name in path:
        out.update(element_features(name))
    near = path[-1].split(".")[0] if path else ""
    return sorted(out) + [f"leaf:{near}"]


def text_features(block: Block) -> list[str]:
    text = block.text
    n = text.count(" ") + 1
    out = [f"words:{min(n, 300).bit_length()}"]
    links = block.link_chars / len(text)
    out.append(f"links:{min(3, int(links * 4))}")
    out.append("ends:stop" if text[-1] in ".!?…\"'”" else "ends:open")
    stops = text.count(". ") + text.count(", ")
    out.append(f"stops:{min(stops, 15).bit_length()}")
    if text[0] in "©|»›·" or "©" in text:
        out.append("sign")
    return out


@dataclass
class Crf:
    """Two states, 0 other and 1 main: ``weights`` add to main, ``pairs`` to neighbours."""

    weights: dict[str, float]
    pairs: np.ndarray
    first: float


def fit_crf(
    pages: list[list[list[str]]], labels: list[list[int]], steps: int = 160
) -> Crf | None:
    """Maximum likelihood with a small quadratic penalty, by gradient steps (Adam); forward
    and backward sums run over all pages at once."""
    if not pages:
        return None
    names: dict[str, int] = {}
    n, length = len(pages), max(map(len, pages))
    at, owner = [], []
    y = np.zeros((n, length), np.int64)
    mask = np.zeros((n, length), bool)
    for p, (blocks, states) in enumerate(zip(pages, labels)):
        y[p, : len(states)] = states
        mask[p, : len(states)] = True
        for b, features in enumerate(blocks):
            for f in features:
                at.append(names.setdefault(f, len(names)))
                owner.append(p * length + b)
    at, owner = np.array(at), np.array(owner)
    size = len(names)
    theta = np.zeros(size + 5)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    follow = mask[:, 1:]
    for step in range(1, steps + 1):
        score = np.zeros((n, length, 2))
        score[:, :, 1] = np.bincount(owner, theta[at], n * length).reshape(n, length)
        pair = theta[size : size + 4].reshape(2, 2)
        score[:, 0, 1] += theta[-1]
        ahead = np.zeros((n, length, 2))
        ahead[:, 0] = score[:, 0]
        for k in range(1, length):
            step_in = np.logaddexp(
                ahead[:, k - 1, 0, None] + pair[0], ahead[:, k - 1, 1, None] + pair[1]
            )
            ahead[:, k] = np.where(mask[:, k, None], step_in + score[:, k], ahead[:, k - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind = np.zeros((n, length, 2))
        expected = np.zeros((2, 2))
        for k in range(length - 2, -1, -1):
            onward = score[:, k + 1] + behind[:, k + 1]
            step_back = np.logaddexp(
                pair[:, 0] + onward[:, 0, None], pair[:, 1] + onward[:, 1, None]
            )
            behind[:, k] = np.where(mask[:, k + 1, None], step_back, 0)
            both = (
                ahead[:, k, :, None] + pair + onward[:, None, :] - total[:, None, None]
            )
            expected += (np.exp(both) * mask[:, k + 1, None, None]).sum(axis=0)
        p1 = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * mask
        miss = (p1 - y * mask) / n
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][follow], y[:, 1:][follow]), 1)
        slope = np.concatenate(
            [
                np.bincount(at, miss.ravel()[owner], size),
                ((expected - seen) / n).ravel(),
                [miss[:, 0].sum()],
            ]
        )
        slope += 2e-4 * theta
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.999 * m2 + 0.001 * slope**2
        theta = theta - 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Crf(
        {f: float(theta[k]) for f, k in names.items()},
        theta[size : size + 4].reshape(2, 2).copy(),
        float(theta[-1]),
    )


def viterbi(scores: list[float], crf: Crf) -> list[int]:
    """The most likely states; ``scores`` are the sums of weights of each block."""
    if not scores:
        return []
    (p00, p01), (p10, p11) = crf.pairs.tolist()
    zero, one = 0.0, scores[0] + crf.first
    back: list[tuple[int, int]] = []
    for s in scores[1:]:
        a, b = zero + p00, one + p10
        c, d = zero + p01, one + p11
        back.append((int(b > a), int(d > c)))
        zero, one = max(a, b), max(c, d) + s
    states = [int(one > zero)]
    for choice in reversed(back):
        states.append(choice[states[-1]])
    return states[::-1]


def _beside(name: str) -> bool:
    """Whether the markup of an element says that it is not of the main text."""
    tag, *words = name.split(".")
    if tag in ("article", "main"):
        return False
    return tag in NOT_MAIN_TAGS or not NOT_MAIN_WORDS.isdisjoint(words)


def markup_label(path: tuple[str, ...]) -> int:
    """1 for blocks in an article element that lie in no part of other kind."""
    if any(_beside(name) for name in path):
        return 0
    return int(any(name.split(".")[0] in ("article", "main") for name in path))


def _variants(blocks: list[Block], labels: list[int], seed: int):
    """The page as it is, and the same blocks in other layouts, whose labels are known: the
    article in a container with another name, and other parts around or inside it."""
    yield [b.path for b in blocks], blocks, labels
    pick = np.random.default_rng(seed)
    base = ("html", "body")
    for _ in range(LAYOUTS):
        word = MAIN_WORDS[pick.integers(len(MAIN_WORDS))]
        box = (("main",), (f"div.{word}",), ("section",), ("article",), (f"div.{word}", "article"),
               ("div",), ("div.page", f"div.{word}"))[pick.integers(7)]
        out: list[tuple[tuple[str, ...], Block, int]] = []
        texts = [b for b in blocks if len(b.text) > 20] or blocks
        bad = sorted(NOT_MAIN_WORDS)

        def other(inside: tuple[str, ...], times: int) -> None:
            words = [bad[k] for k in pick.integers(len(bad), size=2)]
            part = (
                ("aside",), ("aside", "p"), ("nav", "ul", "li"), ("nav",), ("form",), ("form", "p"),
                ("header",), ("header", "h1"), ("footer",), ("footer", "p"),
                (f"div.{words[0]}",), (f"div.{words[0]}", "p"), (f"section.{words[0]}", "p"),
                (f"section.{words[0]}", "h2"), (f"div.{words[0]}.{words[1]}", "p"),
                ("aside", f"div.{words[0]}", "p"), (f"ul.{words[0]}", "li"),
                (f"aside.{words[0]}", "p"), (f"div.{words[0]}", "article", "p"),
            )[pick.integers(19)]
            for _ in range(times):
                block = texts[pick.integers(len(texts))]
                text = block.text
                if pick.random() < 0.6:
                    text = " ".join(text.split()[: int(pick.integers(2, 14))])
                linked = len(text) if "li" in part and pick.random() < 0.8 else 0
                out.append((base + inside + part, Block(None, text, linked, 0), 0))

        for _ in range(int(pick.integers(0, 4))):
            other((), int(pick.integers(1, 5)))
        for block, label in zip(blocks, labels):
            if label:
                tag = block.path[-1].split(".")[0] if block.path else "p"
                leaf = () if tag in ("article", "main", "body", "html") else (tag,)
                if pick.random() < 0.1:
                    leaf = (("blockquote", "p"), ("ul", "li"), ("pre",), ("h2",), ("td",))[
                        pick.integers(5)
                    ]
                out.append((base + box + leaf, block, 1))
                if pick.random() < 0.08:
                    other(box, int(pick.integers(1, 3)))
        for _ in range(int(pick.integers(1, 4))):
            other(() if pick.random() < 0.7 else box, int(pick.integers(1, 5)))
        yield [p for p, _, _ in out], [b for _, b, _ in out], [k for _, _, k in out]


def _pieces(blocks: list[Block], seed: int) -> list[list[Block]]:
    """Runs of at most ``TRAIN_BLOCKS`` blocks from all over a page, ``TRAIN_PIECES`` at most."""
    out = [blocks[k : k + TRAIN_BLOCKS] for k in range(0, len(blocks), TRAIN_BLOCKS)]
    if len(out) > TRAIN_PIECES:
        inner = np.random.default_rng(seed).choice(len(out) - 2, TRAIN_PIECES - 2, replace=False)
        out = [out[0], *(out[k + 1] for k in sorted(inner)), out[-1]]
    return out


def _lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of the blocks of labelled pages, in their own and other layouts."""
    for batch in batches:
        seeds, features, labels = [], [], []
        for seed, html in zip(*(batch.column(c).to_pylist() for c in ("seed", "html"))):
            blocks = leaf_blocks(html)
            for piece in _pieces(blocks, seed):
                known = [markup_label(b.path) for b in piece]
                if len(blocks) <= TRAIN_BLOCKS and not any(known):
                    continue
                for paths, made, states in _variants(piece, known, seed):
                    seeds.append(seed)
                    features.append([path_features(p) + text_features(b) for p, b in zip(paths, made)])
                    labels.append(states)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seeds, pa.int32()), pa.array(features, pa.list_(pa.list_(pa.string()))),
             pa.array(labels, pa.list_(pa.int32()))],
            ["seed", "features", "labels"],
        )


def train_crf(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Crf | None:
    """Fit on at most ``sample_pages`` pages that have an article element, chosen by hash of
    page_id and html. Their markup is the label; each page is also laid out anew (``_variants``),
    so that pages without the element are read by their other signs. Pages are parsed in tasks;
    the driver gets the features of at most ``TRAIN_PIECES`` pieces a page and layout."""
    labelled = pages.where(F.lower("html").contains("<article")).select(
        F.col("page_id").cast("long").alias("page_id"), F.xxhash64("html").alias("page"), "html"
    )
    keys = hash_sample(labelled.select("page_id", "page"), ["page_id", "page"], sample_pages)
    chosen = [(k, r.page_id, r.page) for k, r in enumerate(keys.collect())]
    if not chosen:
        return None
    sample = pages.sparkSession.createDataFrame(chosen, "seed int, sample_id long, sample_page long")
    same = F.col("page_id").eqNullSafe(F.col("sample_id")) & (F.col("page") == F.col("sample_page"))
    rows = (
        labelled.join(F.broadcast(sample), same)
        .groupBy("seed")
        .agg(F.min("html").alias("html"))
        .mapInArrow(_lessons, "seed int, features array<array<string>>, labels array<int>")
        .toArrow()
        .to_pylist()
    )
    rows.sort(key=lambda r: r["seed"])  # stable: pieces and layouts of a page stay in order
    if not any(any(r["labels"]) for r in rows):
        return None
    rows = [r for r in rows if r["labels"]]
    return fit_crf([r["features"] for r in rows], [r["labels"] for r in rows])


def _path_score(element: Element | None, weight: dict[str, float]) -> float:
    """Sum of the weights of ``path_features``, each element added up once."""
    open_sums = []
    near = element
    while element is not None and element.score is None:
        open_sums.append(element)
        element = element.around
    total = 0.0 if element is None else element.score
    for element in reversed(open_sums):
        total += sum(weight.get(f, 0.0) for f in element.fresh)
        element.score = total
    return total + weight.get(f"leaf:{near.tag if near else ''}", 0.0)


def main_text(html: str | None, crf: Crf | None, known: dict[str, tuple[str, ...]]) -> str:
    """Texts of the blocks that are decoded as main, joined by line feeds. Without a model,
    blocks that their markup does not put beside the main text count as main."""
    if not html:
        return ""
    blocks = leaf_blocks(html, known)
    if crf is None:
        return "\n".join(b.text for b in blocks if b.within is None or not b.within.other)
    weight = crf.weights
    scores = []
    for b in blocks:
        score = _path_score(b.within, weight)
        for f in text_features(b):
            score += weight.get(f, 0.0)
        scores.append(score)
    return "\n".join(b.text for b, keep in zip(blocks, viterbi(scores, crf)) if keep)


def _extractor(crf: Crf | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            texts = [main_text(h, crf, known) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                ["page_id", "url", "text"],
            )

    return run


def extract_pages(pages: DataFrame, crf: Crf | None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Each whole page is parsed and decoded in its task; nothing is shuffled. Null and empty
    pages, and pages without a main block, give an empty text. Without a model (no page with
    an article element to learn from) the markup decides (``main_text``).
    """
    return (
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
        .mapInArrow(_extractor(crf), "page_id long, url string, text string")
        .withColumn("n_chars", F.length("text").cast("long"))
    )
