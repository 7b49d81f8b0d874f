from curbflow.llm import ngram_join, queries
from test_near_copies import near_copies, rows_of


def test_unrelated_texts_of_one_id_stay_apart(spark):
    rows = [(1, "a b c d e f g"), (1, "t u v w x y z"), (1, "T u v w x y z"), (2, "t u v w x y z"),
            (5, "k l m n o p q"), (None, "a b c d e f g")]
    links = ngram_join.jaccard_links(rows_of(spark, rows)).collect()
    classes = {}
    for r in links:
        classes.setdefault(r.component, []).append(r)
    assert sorted(len(c) for c in classes.values()) == [1, 2, 3]
    assert {len(c): {r.class_id for r in c} for c in classes.values()} == {1: {5}, 2: {1}, 3: {1}}
    kept = ngram_join.one_of_each(rows_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.text.lower()) for r in kept) == [
        (1, "a b c d e f g"), (1, "t u v w x y z"), (5, "k l m n o p q")
    ]


def test_near_copies_without_ids_leave_one(spark):
    first, second = near_copies(12, 1), near_copies(9, 2)
    rows = [(None, t) for t in first + second] + [(None, "alone")]
    links = ngram_join.jaccard_links(rows_of(spark, rows)).collect()
    assert len(links) == len(rows) and all(r.class_id is None for r in links)
    kept = [r.text for r in ngram_join.one_of_each(rows_of(spark, rows)).collect()]
    assert len(kept) == len({r.component for r in links})
    assert len(set(kept) & set(first)) == len(set(kept) & set(second)) == 1 and "alone" in kept


def test_op2_names_its_classes(spark):
    got = queries.op2(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_links", "component", "class_id"]
    rows = got.collect()
    pairs = {(r.component, r.class_id) for r in rows}
    assert len(pairs) == len({c for c, _ in pairs}) == len({c for _, c in pairs})
