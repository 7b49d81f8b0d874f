import re
import zlib
from collections import Counter

import numpy as np
import pytest

from curbflow.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least=5, slip_rate=199):
    """All pairs of words, letter by letter; rows of (doc_id, text)."""
    count = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip_rate == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if n >= least and len(w) >= 6}
    near = {w: [v for v in words if v != w and one_edit(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made_rows(seed, n=400):
    """Words with variants of their variants, in numbers that fall fivefold."""
    pick = np.random.default_rng(seed)
    letters = list("abcdé")

    def changed(word):
        k = int(pick.integers(0, len(word)))
        letter = str(pick.choice(letters))
        return [word[:k] + letter + word[k:], word[:k] + word[k + 1 :],
                word[:k] + letter + word[k + 1 :]][int(pick.integers(0, 3))]

    pool = []
    for _ in range(6):
        word, times = "".join(pick.choice(letters, int(pick.integers(6, 12)))), 700
        while times >= 3:
            pool += [word] * times
            pool += [changed(word) for _ in range(12)] * max(1, times // 12)
            word, times = changed(word), times // 5
    pool = [w.upper() if k % 7 == 0 else w for k, w in enumerate(pool)]
    pick.shuffle(pool)
    return [(k, " ".join(pool[k::n])) for k in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, seed):
    rows = made_rows(seed) + [(None, "abcdéabc " * 7), (3, None), (4, ""), (5, "ÀÉÎ×÷ßa " * 9)]
    rows += rows[:20] + [(900, "q" * 3_000 + " ") , (901, ("q" * 3_001 + " ") * 30)] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.spelling_forms(docs, slip_rate=11)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute(rows, slip_rate=11)
    assert found(got) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of forms


def test_held_words_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 5)
    rows = made_rows(5, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling.spelling_forms(docs)) == brute(rows)


def test_words_one_edit_apart_share_a_file():
    pick = np.random.default_rng(0)
    letters = list("abcdefé")
    places = {}
    for _ in range(3_000):
        word = "".join(pick.choice(letters, int(pick.integers(2, 14))))
        k, letter = int(pick.integers(0, len(word))), str(pick.choice(letters))
        inserted, replaced = word[:k] + letter + word[k:], word[:k] + letter + word[k + 1 :]
        files = [list(spelling.files(w, places)) for w in (word, inserted, replaced)]
        short, long_ = ({f for f, r in x if r == role} for x, role in zip(files, (1, 2)))
        assert short & long_
        if replaced != word:
            assert {f for f, r in files[0] if r == 0} & {f for f, r in files[2] if r == 0}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_forms(empty).count() == 0
    names = ["word", "n", "file", "role", "near", "near_n", "form", "root", "next", "best"]
    rows = made_rows(9, 50)
    wide = spark.createDataFrame(
        [(*r, *names) for r in rows],
        "doc_id long, text string, " + ", ".join(f"{n} string" for n in names),
    )
    assert found(spelling.spelling_forms(wide)) == brute(rows)


def test_no_table_is_broadcast(spark):
    """Spark sizes the files and the stored tables too low; a broadcast of them fills the driver."""
    rows = made_rows(3, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        assert found(spelling.spelling_forms(docs)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
