import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.llm import katz

HELD = "crc32(coalesce(string(doc_id), '')) % 5 = 1"


def brute(rows):
    """Scores by plain dictionaries, from the definition."""
    docs = []
    for doc_id, text in rows:
        tokens = (text or "").encode().lower().split() + [b"\n"]
        name = b"" if doc_id is None else str(doc_id).encode()
        docs.append((doc_id, zlib.crc32(name) % 5 == 1, tokens))
    uni, bi = Counter(), defaultdict(Counter)
    for _, held, tokens in docs:
        if not held:
            uni.update(tokens)
            for a, b in zip([b"\n", *tokens], tokens):
                bi[a][b] += 1
    n, v = sum(uni.values()), len(uni)

    def table(counts):
        of = Counter(counts)
        return katz.discounts(np.array([of[r] for r in range(1, 7)], float))

    d1 = table(uni.values())
    d2 = table([c for row in bi.values() for c in row.values()])
    cut = lambda c, d: c if c > 5 else c * d[c]
    kept = sum(cut(c, d1) for c in uni.values()) / n if n else 0
    scale = 1 if kept < 1 - 1e-12 else n / (n + 1)
    p1 = {w: scale * cut(c, d1) / n for w, c in uni.items()}
    unknown = 1 - scale * kept

    def chance(h, w):
        low = p1.get(w, unknown) if n else 1.0
        if not uni[h]:
            return low
        row = bi[h]
        kept = sum(cut(c, d2) for c in row.values()) / uni[h]
        scale = 1 if kept < 1 - 1e-12 else uni[h] / (uni[h] + 1)
        if row[w]:
            return scale * cut(row[w], d2) / uni[h]
        return (1 - scale * kept) / (1 - sum(p1[x] for x, c in row.items() if c)) * low

    out = []
    for doc_id, held, tokens in docs:
        base = sum(math.log10((uni[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        score = sum(math.log10(chance(a, b)) for a, b in zip([b"\n", *tokens], tokens))
        out.append((doc_id, held, len(tokens), sum(uni[t] > 0 for t in tokens), n, base, score))
    return out, chance, uni


def key(r):
    return (r[0] is None, r[0] or 0, r[2], r[6])


def compare(got, want):
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-6, abs=1e-9)


def test_matches_dictionaries_on_the_small_table(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 20_000)
    monkeypatch.setattr(katz, "PART_TOKENS", 9_000)
    monkeypatch.setattr(katz, "PART_WORDS", 3_000)
    monkeypatch.setattr(katz, "HOT_SHARE", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    compare(katz.katz_scores(docs, F.expr(HELD)).collect(), brute(rows)[0])


def test_chances_of_all_words_add_up_to_one():
    rows = [(k, "a b a c b a\ta d e") for k in range(9)] + [(20, "a b x"), (21, "x y")]
    _, chance, uni = brute(rows)
    for h in uni:
        assert sum(chance(h, w) for w in [*uni, b"never seen"]) == pytest.approx(1)


def test_empty_null_repeated_and_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, " \n\t"), (4, "A a Ä ä"), (5, "z")]
    rows += [(6, "a b " * 20_000)]
    docs = spark.createDataFrame(
        [(a, b, "x", 1) for a, b in rows], "doc_id long, text string, chunk string, rank int"
    )
    compare(katz.katz_scores(docs, F.expr(HELD)).collect(), brute(rows)[0])
    assert katz.katz_scores(docs.limit(0), F.expr(HELD)).count() == 0


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = katz.katz_scores(docs, F.lit(True)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got} == {
        (3, 0, 0, 0.0), (1, 0, 0, 0.0)
    }
