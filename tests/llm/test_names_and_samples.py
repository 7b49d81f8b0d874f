import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curbflow.llm import line_dedup, mixing, ngram_join, quality, toxicity
from curbflow.llm.common import hash_sample

SMALL = "/root/testdata/sf0.001"
# Every name that an operator gives to a column of its own.
HELPERS = (
    "epochs cut_key target _source source_size size key _copy cut_words budget _row row lines_removed "
    "_gone _nth _text _doomed kept expected_grade tail_probability component node doomed places mark "
    "first last keeper user_column_5 c0 _kept _lines_removed grade"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in HELPERS])


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=str)


@pytest.mark.parametrize(
    "run",
    [
        mixing.mixed_documents,
        line_dedup.dedup_lines,
        line_dedup.dedup_passages,
        ngram_join.one_of_each,
        lambda d: quality.kept_documents(d, None),
        lambda d: corpus_pipeline.without_repeated_lines(None, d, SMALL),
    ],
    ids=["mix", "lines", "passages", "copies", "grades", "stage"],
)
def test_columns_of_any_name_stay(docs, wide, run):
    plain, got = run(docs), run(wide)
    assert got.columns[: len(wide.columns)] == wide.columns
    added = len(plain.columns) - len(docs.columns)
    assert len(got.columns) == len(wide.columns) + added
    assert len(set(got.columns)) == len(got.columns)
    assert rows(got, docs.columns) == rows(plain, docs.columns)
    wrong = [F.col(f"`{n}`") != F.concat(F.lit(f"{n}-"), "doc_id") for n in HELPERS]
    assert got.where(F.array_contains(F.array(*wrong), True)).count() == 0
    if added:
        mine = got.columns[-added:]
        assert rows(got, mine) == rows(plain, plain.columns[-added:])


def test_grades_next_to_columns_of_their_names(docs, wide):
    got = quality.grade_documents(wide, None, ("doc_id", "kept", "_text", "tail_probability"))
    assert got.columns == ["doc_id", "kept", "_text", "tail_probability", "expected_grade",
                           "_tail_probability", "_kept"]
    assert got.where("_kept AND kept = concat('kept-', doc_id)").count() == docs.count()


@pytest.mark.parametrize("hot", [3, 5, 12, 77, 1000])
def test_a_repeated_key_counts_once_in_a_sample(spark, hot):
    df = spark.range(20_000).select(F.lit(hot).cast("long").alias("doc_id"), F.lit(0).alias("grade"))
    df = df.unionByName(spark.range(200).select((F.col("id") + 5_000).alias("doc_id"), F.lit(1).alias("grade")))
    for rows_wanted, want in ((300, 201), (100, 100), (20, 20)):
        got = hash_sample(df, ["doc_id", "grade"], rows_wanted)
        ids = [r.doc_id for r in got.collect()]
        assert len(ids) == len(set(ids)) == want


def test_the_sample_of_unique_keys_is_what_it_was(spark):
    df = spark.range(5_000).select(F.col("id").alias("k"))
    place = F.xxhash64("k", F.lit(5))
    bound = (4 * 100 << 31) // 5_000
    want = df.where(F.pmod(place, F.lit(1 << 31)) < bound).orderBy(place, "k").limit(100)
    assert hash_sample(df, ["k"], 100).collect() == want.collect()


def test_one_label_on_most_rows_still_trains(spark, docs):
    """99 % of the labels are of one document."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    one = labels.where("toxic = 0 AND quality = 1").orderBy("doc_id").limit(1)
    many = labels.unionByName(
        one.crossJoin(spark.range(99 * labels.count()).select(F.lit(1).alias("x"))).drop("x")
    )
    model = quality.train_quality(docs, quality.graded(many), 150)
    plain = quality.train_quality(docs, quality.graded(labels), 150)
    assert model is not None and (model.weights == plain.weights).all()
    scored = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, many))
    same = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))
    assert rows(scored, ["doc_id", "predicted"]) == rows(same, ["doc_id", "predicted"])
