"""Spelling variants: words one edit apart, and the frequent form that a rare one stands for.

Near words are found by PartEnum. The letters of a word, numbered by occurrence, are a binary
vector; a replaced letter changes two of its places, an inserted or deleted one changes one.
Places are dealt to a few parts, and a word is filed under all but two (or one) of its parts
at once: words that differ in two (or one) places agree in at least one such file. An edit also
leaves the first or the last half of a word as it is, so files are told apart by that half and
by length. Files meet in an equi-join; every pair is then verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import stored

LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_RATIO = 5
SLIP_RATE = 199
PARTS_REPLACED = 4  # of which any two may differ
PARTS_INSERTED = 3  # of which any one may differ
HELD_WORDS = 200_000  # words that a task adds up before it passes them on
FILED_WORDS = 20_000  # words that a task files: a few seconds, as each has 24 files

_COUNTS = "word string, n long"


def _words(least_length: int, slip_rate: int):
    run = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def slipped(word: str, doc: int) -> str:
        place = zlib.crc32(word.encode(), doc) % len(word)
        return word[:place] + word[place + 1 :]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            some = [(w, n) for w, n in held.items() if len(w) >= least_length]
            arrays = [pa.array([w for w, _ in some], pa.string()),
                      pa.array([n for _, n in some], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text"))):
                if not text:
                    continue
                found = run.findall(text.lower().decode("utf-8", "replace"))  # of bytes: A-Z only
                doc = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
                slips = {w for w in set(found) if zlib.crc32(w.encode(), doc) % slip_rate == 0}
                held.update(
                    [slipped(w, doc) if w in slips else w for w in found] if slips else found
                )
                if len(held) > HELD_WORDS:
                    yield passed_on()
                    held.clear()
        yield passed_on()

    return count


def word_counts(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    slip_rate: int = SLIP_RATE,
) -> DataFrame:
    """``word``, ``n``: words of all whole texts, with one letter left out of every word of a
    document whose hash says so."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
    )
    return (
        texts.mapInArrow(_words(least_length, slip_rate), _COUNTS)
        .groupBy("word").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least_count)
    )


# A file's role: 0 replaced letter, 1 the shorter of an insertion, 2 the longer.
_FILES = "word string, n long, file long, role int"


def _part_sums(word: str, parts: int, places: dict[str, int]) -> list[int]:
    """For each part the sum of the hashes of the word's places in it: equal for equal sets."""
    sums = [0] * parts
    seen: dict[str, int] = {}
    for letter in word:
        k = seen[letter] = seen.get(letter, 0) + 1
        name = f"{letter}{k}"
        place = places.get(name)
        if place is None:
            place = places[name] = xxhash.xxh3_64_intdigest(name)
        sums[place % parts] += place >> 3
    return sums


def files(word: str, places: dict[str, int]) -> Iterator[tuple[int, int]]:
    """Files and roles of a word."""
    length = len(word)
    plans = (
        (0, length, PARTS_REPLACED, 2),
        (1, length, PARTS_INSERTED, 1),
        (2, length - 1, PARTS_INSERTED, 1),
    )
    sums = {parts: _part_sums(word, parts, places) for parts in (PARTS_REPLACED, PARTS_INSERTED)}
    for role, shorter, parts, differ in plans:
        half = shorter // 2
        ends = ("first", word[:half]), ("last", word[length - half :])
        for open_parts in combinations(range(parts), differ):
            rest = [s for k, s in enumerate(sums[parts]) if k not in open_parts]
            for end in ends:
                name = repr((role > 0, shorter, open_parts, rest, end))
                yield xxhash.xxh3_64_intdigest(name) - (1 << 63), role


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places: dict[str, int] = {}
    for batch in batches:
        columns: tuple[list, ...] = ([], [], [], [])
        for word, n in zip(*(batch.column(c).to_pylist() for c in ("word", "n"))):
            for name, role in files(word, places):
                for column, value in zip(columns, (word, n, name, role)):
                    column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n", "file", "role"]
        )


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: both directions of all pairs of words of at least two code
    points that differ by one inserted, deleted or replaced code point."""
    dealt = words.repartition(words.count() // FILED_WORDS + 1)
    filed = dealt.mapInArrow(_filed, _FILES)
    left = filed.where("role < 2").select("file", "role", "word", "n")
    right = filed.where("role <> 1").selectExpr(
        "file", "role AS near_role", "word AS near", "n AS near_n"
    )
    # Always a merge join: Spark sizes the files by the words they come from, of which each has 18 on
    # either side, so it would broadcast hundreds of MB.
    pairs = (
        left.join(right.hint("merge"), "file")
        .where("near_role = 2 * role AND (role = 1 OR word < near)")
        .where("levenshtein(word, near, 1) = 1")
        .select("word", "n", "near", "near_n")
        .distinct()
    )
    both = F.explode(F.array(
        F.struct("word", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    ))
    return pairs.select(both.alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the last of the forms that follow from a word.

    Each round doubles the steps taken. A form is ``FORM_RATIO`` times as frequent as its word,
    so there are no rings, and few rounds.
    """
    # Merge joins from here on: Spark sizes a stored table by its packed files, many times too low.
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(
            now.join(further.hint("merge"), "root", "left").select("word", "root", "next"), "roots"
        )
        now = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.where("next IS NOT NULL").isEmpty():
            return now


def spelling_forms(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    ratio: int = FORM_RATIO, slip_rate: int = SLIP_RATE,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each distinct word.

    Words are runs of Latin letters of ``text`` (null: none), A-Z lower-cased, of at least
    ``least_length`` code points (two or more) and ``least_count`` occurrences. If ``slip_rate``
    divides the crc32 of ``<doc_id>:<run>`` (null id: empty), the run loses its letter at
    that number modulo its length. ``form`` is the near word of largest n (ties: the first by
    code points) if it has ``ratio`` times the word's n, else null; ``root`` follows the forms to
    the last. Rows that repeat count as often as they occur; an empty table gives no row; other
    columns are not read.
    """
    words = stored(word_counts(docs, least_length, least_count, slip_rate), "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"),
    )
    has_form = F.expr(f"-best.order >= {int(ratio)} * n")
    known = stored(
        words.join(best.hint("merge"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("best.near")).alias("form"),
            F.when(has_form, -F.col("best.order")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


# Near words by all strings with one letter less, crc32 by its table.
ORACLE = r"""
WITH RECURSIVE tbl AS (
  SELECT list_transform(range(0, 256), lambda b: list_reduce(range(0, 8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
r AS (
  SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name
  FROM runs WHERE length(run) >= 6 GROUP BY ALL),
b AS (
  SELECT run, n, flatten(list_transform(list_transform(string_split(name, ''), lambda c: unicode(c)),
    lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END)) AS bytes
  FROM r),
h AS (
  SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]),
    CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM b, tbl),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER))
              || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6
  GROUP BY word HAVING sum(n) >= 5),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM k),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place,
         count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS (
  SELECT words.word, words.n, coalesce(p.n_near, 0) AS n_near,
         CASE WHEN p.near_n >= 5 * words.n THEN p.near END AS form,
         CASE WHEN p.near_n >= 5 * words.n THEN p.near_n END AS form_n
  FROM words LEFT JOIN ranked p ON p.word = words.word AND p.place = 1),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word
  WHERE forms.form IS NOT NULL),
roots AS (
  SELECT chain.word, chain.root FROM chain JOIN forms ON forms.word = chain.root
  WHERE forms.form IS NULL)
SELECT forms.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM forms JOIN roots ON roots.word = forms.word
"""
