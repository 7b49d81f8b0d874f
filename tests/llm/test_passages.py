import numpy as np

from curbflow.llm import line_dedup, queries
from test_near_copies import rows_of


def brute_passages(rows, least=20):
    """Lines in runs that an earlier document (or earlier lines) have, by comparing all pairs of
    lines; rows have distinct ids, and no run overlaps itself."""
    docs = [(i, (t or "").encode().split(b"\n")) for i, t in sorted(rows)]
    places, out = {}, {}
    for d, (doc_id, lines) in enumerate(docs):
        for j, line in enumerate(lines):
            if line.split():
                places.setdefault(line, []).append((d, j))
        gone = set()
        for j, line in enumerate(lines):
            for e, i in places.get(line, ()):
                if (e, i) >= (d, j):
                    continue
                other, k = docs[e][1], 0
                while j + k < len(lines) and i + k < len(other) and lines[j + k] == other[i + k]:
                    k += 1
                k = k if e < d else min(k, j - i)
                run = lines[j : j + k]
                if sum(len(x.split()) for x in run) >= least:
                    gone |= {j + x for x, text in enumerate(run) if text.split()}
        cut = sorted(gone)
        for a, b in zip(cut, cut[1:]):
            if not any(x.split() for x in lines[a + 1 : b]):
                gone |= set(range(a, b))
        kept = b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode()
        out[doc_id] = (kept, len(gone))
    return out


def found(df):
    return {r.doc_id: (r.text or "", r.lines_removed) for r in df.collect()}


def test_op5_equals_search_for_shared_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_passages([(r.doc_id, r.text) for r in docs.collect()])
    assert found(queries.op5(spark, "/root/testdata/sf0.01")) == want
    got = line_dedup.dedup_passages(docs)
    assert got.columns == [*docs.columns, "lines_removed"]


def test_passages_at_any_place_and_of_any_number_of_lines(spark):
    pick = np.random.default_rng(3)

    def line(n):
        return " ".join(f"w{k}" for k in pick.integers(0, 10**6, size=n))

    rows = []
    for k in range(60):
        passage = [line(int(pick.integers(1, 40))) for _ in range(1 + k % 6)]
        if k % 3 == 0:
            passage[1:1] = [""]
        for at in range(3):
            before = [line(int(pick.integers(1, 30))) for _ in range(int(pick.integers(4)))]
            after = [line(int(pick.integers(1, 30))) for _ in range(int(pick.integers(4)))]
            rows.append((3 * k + at, "\n".join(before + passage + after)))
    want = brute_passages(rows)
    assert sum(n > 0 for _, n in want.values()) > 80
    assert found(line_dedup.dedup_passages(rows_of(spark, rows))) == want


def test_passages_of_odd_rows(spark):
    copy = "one two three four five six seven\n" * 2 + "a b c d e f g h i j k l m"
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, copy), (1, copy), (None, copy), (2, None), (3, ""), (4, "\n\n\n"), (5, "x\n" * 5000),
            (6, long), (7, f"own\n{long}\n\n"), (8, " ".join(f"v{k}" for k in range(19)) + "\n" + copy[:33])]
    got = line_dedup.dedup_passages(rows_of(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = [r for r in got if r.doc_id in (1, None)]
    assert sorted(r.lines_removed for r in kept) == [0, 3, 3]
    assert [r.lines_removed for r in kept if r.doc_id is None] == [3]
    by = {r.doc_id: r for r in got}
    assert [by[k].text for k in (2, 3, 4, 6)] == [None, "", "\n\n\n", long]
    assert by[5].text == "x\n" * 20 and by[5].lines_removed == 4980
    assert by[7].text == "own\n\n" and by[7].lines_removed == 1
    assert by[8].text == rows[-1][1]
    assert line_dedup.dedup_passages(rows_of(spark, rows).limit(0)).count() == 0
