import zlib

import numpy as np
import pytest

from curbflow.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def data(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_ordinal_regression_recovers_ordered_grades():
    pick = np.random.default_rng(3)
    rows, grades = [], []
    for _ in range(600):
        x = pick.normal()
        rows.append((np.array([11, 12]), np.array([x, 1.0])))
        grades.append(int(np.searchsorted([-1, 0.5], x + 0.3 * pick.logistic())))
    model = quality.fit_ordinal(rows, np.array(grades), steps=800, decay=0)
    cuts = model.thresholds - model.weights[12]
    assert (np.diff(model.thresholds) > 0).all()
    assert cuts / model.weights[11] == pytest.approx([-1, 0.5], abs=0.25)
    assert (np.diff(model.tails(0.2)) < 0).all()
    assert quality.fit_ordinal(rows, np.zeros(600, int)) is None


def test_quality_on_held_out_labels(spark):
    docs, labels = data(spark, "documents"), data(spark, "labels")
    train = labels.where("crc32(string(doc_id)) % 3 <> 0")
    model = quality.train_quality(docs, quality.graded(train), 1500)
    got = {r.doc_id: r for r in quality.grade_documents(docs, model).collect()}
    test = [r for r in labels.collect() if fold(r.doc_id, 3) == 0]
    good = [got[r.doc_id].kept for r in test if r.quality == 1 and r.toxic == 0]
    poor = [got[r.doc_id].kept for r in test if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(poor) < 0.1
    assert all(0 <= r.expected_grade <= 2 for r in got.values())


def test_toxicity_on_held_out_labels(spark):
    docs, labels = data(spark, "documents"), data(spark, "labels")
    train = labels.where("crc32(string(doc_id)) % 4 <> 2")
    model = toxicity.train_toxicity(docs, train)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    test = [r for r in labels.collect() if fold(r.doc_id, 4) == 2]
    hit = [got[r.doc_id].predicted for r in test if r.toxic == 1]
    miss = [got[r.doc_id].predicted for r in test if r.toxic == 0]
    assert np.mean(hit) > 0.9 and np.mean(miss) < 0.02
    assert all((r.score >= 0.3) == (r.predicted == 1) for r in got.values())


def test_gram_buckets_equal_plain_hashing_at_every_stripe(monkeypatch):
    text = "Äbc déf " * 40
    whole = np.unique(np.concatenate(list(toxicity.gram_buckets(text))))
    monkeypatch.setattr(toxicity, "STRIPE", 7)
    assert (np.unique(np.concatenate(list(toxicity.gram_buckets(text)))) == whole).all()
    grams = {f" {text.lower()} "[k : k + n] for n in (3, 4, 5) for k in range(len(text) + 3 - n)}
    assert len(whole) == len(grams)


ODD = [(1, None, "a"), (2, "", "a"), (None, "a b", "a"), (3, "x " * 50_000, None), (3, "x", "b")]


def odd_rows(spark):
    return spark.createDataFrame(
        [(i, t, s, 0.5, True) for i, t, s in ODD],
        "doc_id long, text string, source string, score double, kept boolean",
    )


def test_odd_rows_and_missing_labels(spark):
    docs = odd_rows(spark)
    labels = spark.createDataFrame(
        [(1, 0, 0), (2, 1, 1), (3, 1, 0), (None, 1, 1), (9, None, None)],
        "doc_id long, quality int, toxic int",
    )
    model = quality.train_quality(docs, quality.graded(labels))
    assert quality.grade_documents(docs, model).count() == len(ODD)
    assert quality.train_quality(docs, quality.graded(labels.limit(0))) is None
    bare = quality.grade_documents(docs, None, ("doc_id", "kept")).drop("kept").collect()
    assert {(r.expected_grade, r.tail_probability) for r in bare} == {(None, None)}
    tox = toxicity.train_toxicity(docs, labels)
    scores = toxicity.score_toxicity(docs, tox).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.train_toxicity(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), tox).count() == 0
    assert quality.grade_documents(docs.limit(0), model).count() == 0
