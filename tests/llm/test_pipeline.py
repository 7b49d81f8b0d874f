import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from curbflow.llm import mixing, quality
from test_near_copies import brute_links
from test_passages import brute_passages

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage of the pipeline gets and gives, over the small table."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(folder / str(k))
        stage(spark, out[-1], SMALL).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_of_documents_stay(stages):
    for kept in stages[1:-1]:
        assert kept.columns == stages[0].columns and kept.dtypes == stages[0].dtypes


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.train_quality(stages[0], quality.graded(labels))
    features = quality.hashed_words()
    want = {}
    for doc_id, text in texts(stages[0]).items():
        at, value = features(text or "")
        margin = sum(model.weights[a] * v for a, v in zip(at, value))
        if 1 / (1 + np.exp(model.thresholds[0] - margin)) >= 0.5:
            want[doc_id] = text
    assert texts(stages[1]) == want


def test_line_stage(stages):
    want = {k: text for k, (text, _) in brute_passages(list(texts(stages[1]).items())).items()}
    assert texts(stages[2]) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_copy_stage(stages):
    rows = texts(stages[2])
    classes = brute_links(list(rows.items()))
    assert texts(stages[3]) == {k: rows[k] for k, (_, c) in classes.items() if k == c}


def test_mixing_stage(stages):
    con = duckdb.connect()
    con.register("frame", stages[3].select("doc_id", "text", "source").toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM frame")
    column = [d[0] for d in con.execute(mixing.ORACLE).description].index("taken")
    want = {r[0]: r[column] for r in con.execute(mixing.ORACLE).fetchall() if r[column]}
    got, before = Counter(), texts(stages[3])
    for r in stages[4].collect():
        got[r.doc_id] += len(words(r.text))
        assert before[r.doc_id].startswith(r.text)
    assert dict(got) == want


def test_packing_stage(stages):
    want = sorted((r.doc_id, tuple(words(r.text))) for r in stages[4].collect())
    rows = stages[5].collect()
    whole = sorted((r.doc_id, tuple(words(r.text))) for r in rows if r.n_words == len(words(r.text)))
    assert sum(r.n_words for r in rows) == sum(len(w) for _, w in want)
    if all(r.piece == 0 for r in rows):
        assert whole == want
    bins = {}
    for r in rows:
        bins.setdefault((r.bin_id, r.bin_capacity), []).append((r.bin_offset, r.n_words))
    for (_, capacity), inside in bins.items():
        at = 0
        for offset, n in sorted(inside):
            assert offset == at
            at += n
        assert at <= capacity and (capacity == 512 or at > capacity // 2)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == stages[-1].columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))


def test_odd_documents_pass_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0),
            (2, "a b\n" * 30_000, None, "b", 120_000), (3, "x", "en", None, 1)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema) if (
                name != corpus_pipeline.STAGES[-1][0]
            ) else stage(spark, docs, SMALL)
        assert docs.count() >= 0


def test_entry_registers_all_eleven():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
