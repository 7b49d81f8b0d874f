from collections import Counter

import numpy as np
import pytest

from curbflow.llm import embedding_dedup, line_dedup, ngram_join, topk

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, node int"


def rows_of(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in rows], SCHEMA)


def find_all(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


# ---- n-gram Jaccard join ----------------------------------------------------------------


def brute_links(rows):
    """Links and classes by comparing all pairs; rows have distinct ids."""
    words = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    pairs = []
    ids = sorted(words)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - both
            if words[a] == words[b] or (union and both >= 0.8 * union):
                pairs.append((a, b))
    count = Counter(x for p in pairs for x in p)
    return {i: (count[i], c) for i, c in find_all(ids, pairs).items()}


def near_copies(n, seed, length=60):
    pick = np.random.default_rng(seed)
    base = [f"w{k}" for k in pick.integers(0, 500, size=length)]
    out = []
    for _ in range(n):
        copy = list(base)
        if pick.random() < 0.8:
            copy[int(pick.integers(length))] = f"x{pick.integers(10_000)}"
        out.append(" ".join(copy))
    return out


def check_links(spark, rows, **kind):
    got = ngram_join.jaccard_links(rows_of(spark, rows), **kind).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in got} == brute_links(rows)


def test_links_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    check_links(spark, [tuple(r) for r in docs.collect()])


def test_links_in_blocks_of_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_GRAMS", 700)
    monkeypatch.setattr(ngram_join, "STRIPE", 16)
    texts = near_copies(90, 1) + near_copies(40, 2) + ["a b", "A  b", "", "", "c"]
    check_links(spark, list(enumerate(texts)))


def test_links_of_odd_rows(spark):
    long = " ".join(f"w{k % 9000}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"),
            (4, long), (5, long + " end"), (None, "x y z u v w")]
    got = ngram_join.jaccard_links(rows_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_links, r.class_id))
    assert by[1] == by[2] == [(1, 1)] and by[3] == [(2, 3)] * 2 and by[4] == by[5] == [(1, 4)]
    assert sorted(by[None], key=str) == [(0, None), (2, 3)]
    assert ngram_join.jaccard_links(rows_of(spark, rows).limit(0)).count() == 0
    kept = ngram_join.one_of_each(rows_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 4]
    assert sum(r.doc_id is None for r in kept) == 1


def test_bands_reach_their_recall():
    for recall in (0.9, 0.99, 0.999):
        bands = ngram_join.choose_bands(0.8, recall)
        assert 1 - (1 - 0.8**bands.rows) ** bands.count >= recall
        assert bands.rows * bands.count <= ngram_join.MOST_HASHES
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.01, 0.999, 8)


# ---- line dedup -------------------------------------------------------------------------


def brute_dedup(rows, rule=line_dedup.ChunkRule()):
    """Texts after removal, by a set of the chunks seen; rows have distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        lines = (text or "").encode().split(b"\n")
        gone = set()
        for a, b in line_dedup.chunk_lines(lines, rule) if len(lines) > 1 else ():
            body = b"\n".join(lines[a:b])
            if b - a > 1 and len(body.split()) >= rule.least_words:
                if body in seen:
                    gone |= set(range(a, b))
                seen.add(body)
        kept = b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode()
        out[doc_id] = (kept if gone else text, len(gone))
    return out


def test_dedup_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "lines_removed"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.text, r.lines_removed) for r in got.collect()} == brute_dedup(rows)


def test_shifted_passages_are_found():
    pick = np.random.default_rng(8)
    passage = [f"passage line {k} of it".encode() for k in range(30)]
    own = [[f"own {pick.integers(10**6)}".encode() for _ in range(n)] for n in (3, 8)]
    rule = line_dedup.ChunkRule()
    chunks = []
    for before in own:
        lines = before + passage + before
        chunks.append({b"\n".join(lines[a:b]) for a, b in line_dedup.chunk_lines(lines, rule)})
        assert b"\n".join(
            b"\n".join(lines[a:b]) for a, b in line_dedup.chunk_lines(lines, rule)
        ) == b"\n".join(lines)
    shared = b"\n".join(chunks[0] & chunks[1]).split(b"\n")
    assert len(shared) >= 24


def test_dedup_of_odd_rows(spark):
    copy = "one two three four five six seven\n" * 2 + "a b c d e f g h i j k l m"
    rows = [(1, copy), (1, copy), (None, copy), (2, None), (3, ""), (4, "\n\n\n"), (5, "x\n" * 5000)]
    got = line_dedup.dedup_lines(rows_of(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = [r for r in got if r.doc_id in (1, None)]
    assert sorted(r.lines_removed for r in kept) == [0, 3, 3]
    assert [r.lines_removed for r in kept if r.doc_id is None] == [3]
    texts = {r.doc_id: r.text for r in got if r.doc_id in (2, 3, 4)}
    assert texts == {2: None, 3: "", 4: "\n\n\n"}
    assert line_dedup.dedup_lines(rows_of(spark, rows).limit(0)).count() == 0


# ---- top-k and embeddings ---------------------------------------------------------------


def brute_top(rows, k):
    out = []
    for a, q in sorted({(i, tuple(v)) for i, v in rows if i is not None and v and i % 5 == 0}):
        found = [
            (-sum(x * y for x, y in zip(q, v)), i) for i, v in rows if v and i not in (a, None)
        ]
        out += [(a, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [3, 400])
def test_top_k_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 70)
    monkeypatch.setattr(topk, "QUERY_ROWS", 9)
    monkeypatch.setattr(topk, "DEPTHS", (2, 5))
    pick = np.random.default_rng(size)
    rows = [(int(k), pick.integers(-6, 7, size=4).tolist()) for k in range(size)]
    rows += [(7, [1, 2]), (None, [1, 1, 1, 1]), (8, None), (11, rows[1][1]), (12, [0, 0, 0, 0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, q array<long>, score int")
    got = topk.top_inner_products(df, df.where("vec_id % 5 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 5)


def test_threshold_search_stops_early_and_exactly():
    pick = np.random.default_rng(0)
    values = np.round(pick.exponential(size=(3000, 3)) ** 4 * 1000)
    lists = topk.SortedLists(np.arange(3000), values)
    early = [lists._from_ends(values[own], own, 5) for own in range(20)]
    assert sum(e is not None for e in early) > 10
    for own, (ids, scores) in enumerate(lists.search(values[:20], np.arange(20), 5)):
        query = values[own]
        full = values @ query
        order = [i for i in np.lexsort((np.arange(3000), -full)) if i != own][:5]
        assert ids.tolist() == order and scores.tolist() == full[order].tolist()


def test_quantised_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.001]), (2, [inf]), (3, [nan]), (4, [None, 1.0]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = df.select("vec_id", topk.quantised(df.embedding).alias("q")).collect()
    assert {r.vec_id: r.q for r in got} == {
        1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []
    }
    big = spark.createDataFrame(
        [(0, [2**40, 1]), (1, [2**20, 3]), (2, [2**20, 5])], "vec_id long, q array<long>"
    )
    got = topk.top_inner_products(big, big.where("vec_id = 0"), 5).collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**60 + 5), (1, 2**60 + 3)]


def brute_embedding(rows):
    used = [(i, label, np.array(v)) for i, label, v in rows]
    pairs = [
        (a[0], b[0])
        for k, a in enumerate(used)
        for b in used[k + 1 :]
        if a[1] == b[1] and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.98
    ]
    count = Counter(x for p in pairs for x in p)
    return {i: (count[i], c) for i, c in find_all([u[0] for u in used], pairs).items()}


def test_embedding_links_equal_brute_force_in_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF_ROWS", 24)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 10)
    pick = np.random.default_rng(6)
    centres = pick.normal(size=(40, 16))
    rows = []
    for k in range(700):
        centre = centres[0 if k % 4 == 0 else int(pick.integers(40))]
        rows.append((k, k % 2, (centre + 0.06 * pick.normal(size=16)).tolist()))
    rows += [(1000 + k, 1, rows[3][2]) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = embedding_dedup.embedding_links(df).collect()
    want = brute_embedding(rows)
    links, found = sum(n for n, _ in want.values()), sum(r.n_links for r in got)
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert found >= 0.995 * links
    assert sum(r.component_id == want[r.vec_id][1] for r in got) >= 0.995 * len(rows)


def test_embedding_of_odd_rows(spark):
    nan = float("nan")
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (3, 2, [1.0, 0.0]), (4, None, [1.0, 0.0]),
            (5, 1, None), (6, 1, [nan, 1.0]), (7, 1, [0.0, 0.0]), (8, 1, [None, 1.0]), (9, 1, []),
            (None, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0])]
    df = spark.createDataFrame(
        [(*r, 5, 6) for r in rows],
        "vec_id long, label int, embedding array<double>, node int, leaf int",
    )
    got = embedding_dedup.embedding_links(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (2, 1, True) and by[2] == (2, 1, False) and by[3] == (0, 3, True)
    assert all(by[k] == (0, k, True) for k in range(4, 10)) and by[None] == (0, None, True)
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0
