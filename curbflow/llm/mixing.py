"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import WORD_WITH_LEAD, apart, n_words, ordered_offsets, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
RANGE_ROWS = 2_000  # rows of one key range; only the range that holds a cut is sorted


def mixing_key() -> Column:
    """Hash-random order of a source's documents; the same in every run and engine."""
    whole = F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.lit(":"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))),
    )
    return F.md5(whole)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the mixing key of every document, stored once."""
    return stored(
        docs.select("doc_id", "source", n_words().alias("size"), mixing_key().alias("key")),
        "mix-sizes",
    )


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """source, rows, source_size and target words of every source.

    Sources in code point order, null last, take the weights in turn and share ``share``
    times all words. A target never exceeds ``epochs`` times its source; what is cut off
    goes to the others by weight. With sources ordered by cap over weight, the level of
    the uncapped ones is the largest of "(all - caps before) / weights from here on", so
    one pass of prefix sums finds it; the prefix sums are distributed.
    """
    sources = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size")
    )
    ranked = ordered_offsets(
        sources.withColumn("last", F.col("source").isNull())
        .withColumn("name", F.coalesce("source", F.lit("")))
        .withColumn("one", F.lit(1).cast("long")),
        ["last", "name"],
        {"place": "one"},
        "mix-sources",
    )
    turn = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
    weighed = ranked.withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long")
    ).withColumn("cap", F.lit(epochs) * F.col("source_size"))
    leveled = ordered_offsets(
        weighed.withColumn("ratio", F.col("cap") / F.col("weight")),
        ["ratio", "last", "name"],
        {"caps": "cap", "weights": "weight"},
        "mix-levels",
    )
    total = leveled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = leveled.agg(
        F.max(
            (F.lit(share) * F.lit(total[0]) - F.col("caps")) / (F.lit(total[1]) - F.col("weights"))
        )
    ).first()[0]
    return leveled.select(
        "source",
        "rows",
        "source_size",
        F.least(F.col("weight") * F.lit(level).cast("double"), F.col("cap").cast("double")).alias("target"),
    )


def source_cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each source's order is cut: whole ``epochs``, then rows with a key below
    ``cut_key`` once more, and ``cut_words`` of each row that has this key.

    The key space of a source is divided into equal ranges of about ``RANGE_ROWS`` rows.
    Words are summed per range before anything is shuffled, range sums are added up in
    order, and rows are ordered only in the one range where the budget ends. No task gets
    a whole source.
    """
    budget = F.floor(F.col("target") + 1e-6).cast("long")
    plans = stored(
        targets.withColumn("budget", budget)
        .withColumn("ranges", F.ceil(F.col("rows") / RANGE_ROWS))
        .withColumn(
            "epochs",
            F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0),
        )
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumnRenamed("source", "_source"),
        "mix-plans",
    )
    cell = F.floor(
        F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2.0**32)
    )
    keyed = (
        sizes.groupBy("source", "key")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"))
        .join(plans, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("cell", cell)
        .withColumn("words", F.col("copies") * F.col("size"))
        .select("source", "key", "copies", "size", "words", "cell", "rest")
    )
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cells = (
        keyed.groupBy("source", "cell", "rest")
        .agg(F.sum("words").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .where("before <= rest and rest < before + words")
        .select(
            F.col("source").alias("_s"), F.col("cell").alias("_c"), F.col("before").alias("_b")
        )
    )
    above = Window.partitionBy("source").orderBy("key").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cut = (
        keyed.join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")))
        .withColumn("before", F.col("_b") + F.coalesce(F.sum("words").over(above), F.lit(0)))
        .where("before <= rest and rest < before + words")
        .select(
            F.col("source").alias("_cut_source"),
            F.col("key").alias("cut_key"),
            F.expr("(rest - before) div copies").alias("cut_words"),
        )
    )
    return stored(
        plans.join(cut, F.col("_source").eqNullSafe(F.col("_cut_source")), "left").select(
            "_source", "source_size", "target", "epochs", "cut_key", "cut_words"
        ),
        "mix-cuts",
    )


def _taken(size: Column) -> Column:
    once_more = F.when(F.col("key") < F.col("cut_key"), size).when(
        F.col("key") == F.col("cut_key"), F.col("cut_words")
    )
    return F.col("epochs") * size + F.coalesce(once_more, F.lit(0))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Needs doc_id, source and text; other columns are ignored. Returns doc_id, size,
    source_size, target and taken for every row. Null and empty texts have size 0 and
    nothing is taken of them; rows with a null source are a source of their own, the last;
    rows with the same id and text are cut alike; an empty table gives no rows.
    """
    sizes = measured(docs)
    cuts = source_cuts(sizes, source_targets(sizes, weights, share, epochs))
    return sizes.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", _taken(F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as whole epochs take it, and the document at
    a source's cut once with only the words that still fit the budget.

    Returns the columns of ``docs``. ``n_chars`` of a cut document follows its text.
    Documents without words are not part of a mix of words and leave it.
    """
    return apart(docs, _mixed)


def _mixed(docs: DataFrame) -> DataFrame:
    columns = docs.columns
    sizes = measured(docs)
    cuts = source_cuts(sizes, source_targets(sizes))
    # One row per source joins to the documents; Catalyst broadcasts it by its size.
    joined = docs.withColumn("key", mixing_key()).join(
        cuts, F.col("source").eqNullSafe(F.col("_source"))
    )
    words = F.expr(
        f"array_join(slice(regexp_extract_all(text, r'{WORD_WITH_LEAD}', 0), 1,"
        " int(cut_words)), '')"
    )
    whole = F.col("epochs") + F.when(F.col("key") < F.col("cut_key"), 1).otherwise(0)
    part = (F.col("key") == F.col("cut_key")) & (F.col("cut_words") > 0)
    copies = (
        joined.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("epochs") + 1)))
        .where(
            (F.col("_copy") < whole)
            | ((F.col("_copy") == F.col("epochs")) & F.coalesce(part, F.lit(False)))
        )
    )
    is_part = F.coalesce(part, F.lit(False)) & (F.col("_copy") == F.col("epochs"))
    text = F.when(is_part, words).otherwise(F.col("text"))
    out = copies.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(is_part, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*columns)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap,
             [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1] AS weight
      FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS weights
      FROM w WINDOW o AS (ORDER BY cap / weight, source IS NULL, source
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT max((1.5e0 * (SELECT sum(source_size) FROM w) - caps)
                 / ((SELECT sum(weight) FROM w) - weights)) AS level FROM l),
t AS (SELECT source, source_size, least(weight * level, CAST(cap AS DOUBLE)) AS target FROM w, v),
b AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) AS budget,
             CASE WHEN source_size > 0
                  THEN CAST(floor(target + 1e-6) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
g AS (SELECT source, k, count(*) AS copies, any_value(size) AS size FROM d GROUP BY source, k),
p AS (SELECT *, sum(copies * size) OVER (PARTITION BY source ORDER BY k) - copies * size AS before FROM g)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, b.source_size, round(b.target, 6) AS target,
       CAST(b.epochs * d.size + greatest(0, least(d.size,
         (b.budget - b.epochs * b.source_size - p.before) // p.copies)) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.k = p.k
"""
