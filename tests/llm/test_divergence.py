import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from curbflow.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=10, top=10):
    """Every kept term of every group and pair; rows of (text, lang, source)."""
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        mine = {s: c for (l, s), c in groups.items() if l == lang}
        whole = sum(mine.values(), Counter())

        def chances(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: chances(c) for s, c in mine.items()}
        q = chances(whole)
        for s in mine:
            parts = {
                "pair": [(-sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s],
                "term": [(-gap(p[s][t], q[t]), t) for t in kept if mine[s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (x[0], x[1].encode()))
                for k, (value, item) in enumerate(found, 1):
                    if part == "pair" or k <= top:
                        out.append((lang, s, part, item, -value, k))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def made_rows(seed):
    pick = np.random.default_rng(seed)
    words = ["the", "The", "été", "ÉTÉ", "x", "naïve", "don", "t", "日本", "zz", "ab", "Ab"]
    rows = []
    for _ in range(300):
        n = int(pick.integers(0, 30))
        text = " ".join(pick.choice(words, n, p=np.arange(1, 13) / 78)) + ("!x_y'z" if n % 3 else "")
        lang = [None, "", "en", "de"][int(pick.integers(0, 4))]
        source = [None, "a", "b", "é", "Z"][int(pick.integers(0, 5))]
        rows.append((text, lang, source))
    rows += [(rows[0][0], "en", s) for s in "aabbbc"] * 5  # copies across sources
    rows += [(None, "en", "silent"), ("", "en", "empty"), ("word " * 9, "fr", "one")]
    rows += [("rare", "es", "s1"), ("rarer", "es", "s2")]  # a language without kept terms
    return rows


def test_equals_dense_sums(spark):
    rows = made_rows(1)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = divergence.source_divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert found(got) == brute(rows)


def test_held_terms_are_passed_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    rows = made_rows(2)
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert found(divergence.source_divergence(docs, 3, 2)) == brute(rows, 3, 2)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(empty).count() == 0
    names = ["key", "copies", "times", "term", "n", "total", "terms", "own", "none", "p", "q",
             "other", "value", "rank", "item", "part", "by_source", "documents", "lang_n"]
    rows = made_rows(3)
    wide = spark.createDataFrame(
        [(*r, *names) for r in rows],
        "text string, lang string, source string, " + ", ".join(f"{n} string" for n in names),
    )
    assert found(divergence.source_divergence(wide)) == brute(rows)


def test_counts_beyond_a_long_product(spark):
    """10^9 times a count is beyond 64 bits."""
    one = spark.createDataFrame([(40_000_000_000, 90_000_000_000, 7)], "n long, total long, terms long")
    (value,) = one.select(divergence._chance("n", "total", "terms")).first()
    assert value == 1 + 10**9 * 40_000_000_002 // (90_000_000_000 + 14)


def batch_of(rows):
    """Rows (text, lang, {source: times}) as a task gets them."""
    return pa.RecordBatch.from_pydict({
        "lang": pa.array([lang for _, lang, _ in rows], pa.string()),
        "text": pa.array([text.encode() for text, _, _ in rows], pa.binary()),
        "copies": [[{"source": s, "times": n} for s, n in c.items()] for _, _, c in rows],
    })


def test_a_task_sends_a_term_once():
    terms = ["abcdefghij"[k // 1_000] + "é" * (k // 100 % 10) + "x" * (k % 100) for k in range(10_000)]
    text = " ".join(terms)
    out = list(divergence._tally(iter([batch_of([(text, "en", {f"s{k}": 1}) for k in range(30)])])))
    assert sum(b.num_rows for b in out) == 10_000
    assert {len(f) for b in out for f in b.column("found").to_pylist()} == {30}


def test_pieces_of_text_count_like_one(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE_BYTES", 40)
    monkeypatch.setattr(divergence, "HELD_BYTES", 100)
    pick = np.random.default_rng(6)
    signs = list("aAzZ@[`{ \x00\x7f\x80éÉ日0_\n")
    rows = [
        ("".join(pick.choice(signs, int(pick.integers(0, 60)))), ["", "en"][k % 2],
         {s: int(n) for s, n in zip("abé", pick.integers(1, 4, int(pick.integers(1, 4))))})
        for k in range(200)
    ] + [("", "en", {"a": 1}), ("end", "en", {"b": 2}), ("A" * 99, "en", {"b": 1})]
    right = defaultdict(lambda: [0, 0])
    for text, lang, copies in rows:
        for term, k in Counter(TERM.findall(text.translate(LOWER))).items():
            for source, times in copies.items():
                cell = right[lang, term.encode(), source]
                cell[0] += times
                cell[1] += k * times
    got = defaultdict(lambda: [0, 0])
    for batch in divergence._tally(iter([batch_of(rows[:90]), batch_of(rows[90:])])):
        for row in batch.to_pylist():
            for s in row["found"]:
                cell = got[row["lang"], row["term"], s["source"]]
                cell[0] += s["documents"]
                cell[1] += s["n"]
    assert dict(got) == dict(right)
