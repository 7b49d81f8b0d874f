import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.llm import mixing, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key int"
SMALL = "/root/testdata/sf0.001"


def rows_of(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or ""), "x", 7) for i, t, s in rows], SCHEMA
    )


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


ROWS = [
    (1, "a b c d", "x"), (1, "a b c d", "x"), (2, None, "x"), (3, "", "y"), (4, " \n ", None),
    (5, "q " * 3000, "y"), (None, "one two\tthree", None), (6, "e f", "z"), (7, "g", "z"),
    (8, "h i j k l", "zz"), (9, "ä ö ü", "x"),
]


def test_mixing_equals_its_sql(spark):
    docs = rows_of(spark, ROWS)
    con = duckdb.connect()
    frame = docs.select("doc_id", "text", "source").toPandas()
    con.register("frame", frame)
    con.execute(
        "CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM frame"
    )
    want = sorted(con.execute(mixing.ORACLE).fetchall(), key=str)
    got = mixing.mix_sources(docs).withColumn("target", F.round("target", 6))
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_mix_meets_budgets_and_never_exceeds_two_epochs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = mixing.mix_sources(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(per["taken"] - per["target"]) <= 1).all()
    assert got["target"].groupby(got["source"]).first().sum() == pytest.approx(
        1.5 * got["size"].sum()
    )


def test_mixed_documents_hold_the_words_taken(spark):
    docs = rows_of(spark, ROWS)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    want = {}
    for r in mixing.mix_sources(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert {k: v for k, v in want.items() if v} == got


def test_mixing_of_nothing(spark):
    empty = rows_of(spark, ROWS).limit(0)
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    blank = rows_of(spark, [(1, None, None), (2, "", "x")])
    assert {r.taken for r in mixing.mix_sources(blank).collect()} == {0}


def test_many_ranges_cut_like_one(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    assert sorted(map(tuple, mixing.mix_sources(docs).collect())) == one


def reference_fit(lengths, capacities, cost):
    """Best fit by scanning all open bins."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins = []
    for n, i in enumerate(order):
        x = lengths[i]
        fits = [k for k, (size, used) in enumerate(bins) if size - used >= x]
        if fits:
            k = min(fits, key=lambda k: bins[k][0] - bins[k][1])
            bins[k][1] += x
        else:
            def price(c):
                later = sum(lengths[j] for j in order[n + 1:] if lengths[j] <= c - x)
                return (c + cost) / (x + min(c - x, later))
            size = min((c for c in capacities if c >= x), key=lambda c: (price(c), c))
            bins.append([size, x])
    return sorted((next(c for c in capacities if c >= u), u) for _, u in bins)


def test_best_fit_equals_a_scan():
    pick = np.random.default_rng(5)
    for _ in range(20):
        lengths = pick.integers(1, 65, size=int(pick.integers(1, 80)))
        caps = (8, 16, 32, 64)
        bins, offsets, sizes = packing.best_fit(lengths, caps, 4)
        fill = np.bincount(bins, lengths).astype(int)
        assert (fill <= np.array(sizes)).all()
        got = sorted(zip(sizes, fill.tolist()))
        want = reference_fit(lengths.tolist(), caps, 4)
        assert sum(s for s, _ in got) == sum(s for s, _ in want)
        for k in range(len(sizes)):
            inside = sorted(zip(offsets[bins == k], lengths[bins == k]))
            assert [a for a, _ in inside] == [0, *np.cumsum([x for _, x in inside])[:-1]]


def test_packing_keeps_every_word(spark):
    long = " ".join(f"w{k}" for k in range(20_001))
    docs = rows_of(spark, [*ROWS, (10, long, "x"), (10, long, "x")])
    places = packing.pack_documents(docs).toPandas()
    assert places["n_words"].sum() == sum(len(words(r.text)) for r in docs.collect())
    full = places[places["n_words"] > 0]
    use = full.groupby("bin_id").agg(n=("n_words", "sum"), cap=("bin_capacity", "first"))
    assert (use["n"] <= use["cap"]).all()
    assert places[places["n_words"] == 0]["bin_id"].isna().all()
    packed = packing.packed_documents(docs)
    texts = {}
    for r in packed.collect():
        assert len(words(r.text)) == r.n_words
        texts.setdefault((r.doc_id, r.start), []).append(r.text)
    whole = "".join(texts[10, s][0] for s in (0, 8192, 16384))
    assert whole == long and all(len(texts[10, s]) == 2 for s in (0, 8192, 16384))
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_is_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    places = packing.pack_documents(docs).toPandas()
    bins = places.dropna(subset=["bin_id"]).groupby("bin_id")["bin_capacity"].first()
    assert places["n_words"].sum() / bins.sum() > 0.98
    assert not math.isnan(bins.sum())
