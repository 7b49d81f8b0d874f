"""Audit of how far the sources of a language differ in the words they use.

Texts that several documents of a language share are collapsed: one row per distinct text with
its number of documents in each source. Each distinct text is tokenised once, many texts at a
time as arrays; its counts and its documents are added up with those numbers. Sources are then
compared on the terms that they have; the terms that one or both lack are covered by sums over
equal counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import stored

# Bytes of terms, A-Z lower-cased; 0 for those that separate terms: all of ASCII but its letters.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [ord(chr(c).lower()) if chr(c).isalpha() else 0 for c in range(128)]
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
HELD_TERMS = 1_000_000  # occurrences that a task adds up before it passes them on
HELD_BYTES = 32_000_000  # the same for their bytes
PIECE_BYTES = 4_000_000  # text that is tokenised at a time

_TALLY = "lang string, term binary, found array<struct<source: string, documents: long, n: long>>"


def _terms(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and the number of terms of each text."""
    data = _FOLD[np.frombuffer(b"\0".join([b"", *texts, b""]), np.uint8)]
    inside = data != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, stops = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=offsets[1:])
    found = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
    )
    ends = np.cumsum([len(t) + 1 for t in texts])
    return found, np.diff(np.searchsorted(starts, ends), prepend=0)


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal ``keys`` start."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def _by_term(
    terms: pa.Array, owner: np.ndarray, langs: list[str], copies: list[list[dict]]
) -> pa.RecordBatch:
    """One row per language and term with the sources that have it. ``owner`` is the text of
    each term, ascending; ``langs`` and ``copies`` are those of the texts."""
    groups = sorted({(lang, c["source"]) for lang, found in zip(langs, copies) for c in found})
    number = {g: k for k, g in enumerate(groups)}
    copy_group = np.array(
        [number[lang, c["source"]] for lang, found in zip(langs, copies) for c in found], np.int64
    )
    copy_times = np.array([c["times"] for found in copies for c in found], np.int64)
    n_copies = np.array([len(found) for found in copies], np.int64)
    copy_start = np.cumsum(n_copies) - n_copies

    coded = terms.dictionary_encode()
    names = coded.dictionary
    keys = owner * len(names) + coded.indices.to_numpy(zero_copy_only=False)
    keys.sort()
    heads = _heads(keys)
    times = np.diff(heads, append=len(keys))  # of a term in a text
    text, code = np.divmod(keys[heads], len(names))

    each = n_copies[text]  # a row for each copy of the text
    row = np.repeat(np.arange(len(text)), each)
    copy = np.repeat(copy_start[text] - (np.cumsum(each) - each), each) + np.arange(len(row))
    keys = code[row] * len(groups) + copy_group[copy]
    order = np.argsort(keys)
    keys, documents = keys[order], copy_times[copy][order]
    n = times[row][order] * documents
    heads = _heads(keys)
    code, group = np.divmod(keys[heads], len(groups))
    documents, n = np.add.reduceat(documents, heads), np.add.reduceat(n, heads)

    lang_names = sorted({lang for lang, _ in groups})  # in the order of the groups
    lang_number = {lang: k for k, lang in enumerate(lang_names)}
    lang = np.array([lang_number[x] for x, _ in groups], np.int64)[group]
    rows = _heads(code * len(lang_names) + lang)
    sources = pa.array([source for _, source in groups], pa.string()).take(pa.array(group))
    structs = pa.StructArray.from_arrays(
        [sources, pa.array(documents), pa.array(n)], ["source", "documents", "n"]
    )
    offsets = pa.array(np.append(rows, len(group)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(lang_names, pa.string()).take(pa.array(lang[rows])),
            names.take(pa.array(code[rows])),
            pa.ListArray.from_arrays(offsets, structs),
        ],
        ["lang", "term", "found"],
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Languages, texts and copies of rows with about ``PIECE_BYTES`` of text."""
    for batch in batches:
        columns = [batch.column(c) for c in ("lang", "text", "copies")]
        ends = np.append(0, np.cumsum(pc.binary_length(columns[1]).to_numpy(zero_copy_only=False)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + PIECE_BYTES, side="right")) - 1)
            yield tuple(c.slice(a, b - a).to_pylist() for c in columns)
            a = b


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences of each term by language and source."""
    terms: list[pa.Array] = []
    lengths: list[np.ndarray] = []
    langs: list[str] = []
    copies: list[list[dict]] = []
    held = size = 0

    def added_up() -> pa.RecordBatch:
        n = np.concatenate(lengths)
        return _by_term(pa.concat_arrays(terms), np.repeat(np.arange(len(n)), n), langs, copies)

    for lang, text, copy in _pieces(batches):
        found, n = _terms(text)
        if not len(found):
            continue
        terms.append(found)
        lengths.append(n)
        langs += lang
        copies += copy
        held += int((n * [len(c) for c in copy]).sum())
        size += found.nbytes
        if held > HELD_TERMS or size > HELD_BYTES:
            yield added_up()
            terms, lengths, langs, copies, held, size = [], [], [], [], 0, 0
    if held:
        yield added_up()


def _chance(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly; null without terms."""
    return F.expr(
        f"CASE WHEN {terms} > 0 THEN 1 + ({SCALE} * CAST({n} + 2 AS DECIMAL(20, 0))) DIV "
        f"CAST({total} + 2 * {terms} AS DECIMAL(20, 0)) END"
    )


def _gap(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})"


def collapsed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies (lang, key, source, times) of each distinct text, and the texts with them.

    Only digests and counts are grouped by source; a text is shuffled once, and copies are
    put together before that.
    """
    def known(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    rows = docs.select(known("lang"), known("source"), known("text")).withColumn(
        "key", F.unhex(F.sha2("text", 256))
    )
    copies = stored(
        rows.groupBy("lang", "key", "source").agg(F.count(F.lit(1)).alias("times")), "text-copies"
    )
    listed = copies.groupBy("lang", "key").agg(
        F.collect_list(F.struct("source", "times")).alias("copies")
    )
    texts = rows.groupBy("lang", "key").agg(F.min("text").alias("text")).join(listed, ["lang", "key"])
    return copies, texts.select("lang", F.col("text").cast("binary").alias("text"), "copies")


def term_counts(texts: DataFrame, least_documents: int) -> DataFrame:
    """``lang``, ``term``, ``n`` and ``by_source`` (source, n) of the terms that enough documents
    of the language have.

    Tasks send a term once with all its sources, so a word that is in every text costs a row
    for each ``HELD_TERMS`` occurrences of a task. The sums by source need no further shuffle.
    """
    tallies = texts.mapInArrow(_tally, _TALLY).repartition("lang", "term")
    return (
        tallies.select("lang", "term", F.explode("found").alias("s"))
        .groupBy("lang", "term", "s.source")
        .agg(F.sum("s.documents").alias("documents"), F.sum("s.n").alias("n"))
        .groupBy("lang", "term")
        .agg(
            F.sum("documents").alias("documents"), F.sum("n").alias("n"),
            F.collect_list(F.struct("source", "n")).alias("by_source"),
        )
        .where(F.col("documents") >= least_documents)
        .select("lang", F.col("term").cast("string").alias("term"), "n", "by_source")
    )


def source_divergence(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources of the language by their distance
    (part ``pair``), and the terms that stand out against the language (part ``term``).

    Reads ``text``, ``lang`` and ``source``; null reads as ''. A language keeps the terms
    (runs of letters, A-Z lower-cased) that ``least_documents`` of its documents have, repeats
    of a text counted as often as they occur. A group of n occurrences of a term, total N over
    V kept terms, gives it p = 1 + floor(10^9 (n + 2) / (N + 2 V)); two chances are
    floor((p - q)^2 / (p + q)) apart, and sources the sum of that over all kept terms (0
    without any). Equal values rank by the item's bytes. All sums are of whole numbers. A
    language of one source has no pair; an empty table gives no row. Other columns are not read.
    """
    copies, texts = collapsed(docs)
    kept = stored(term_counts(texts, least_documents), "kept-terms")
    langs = kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total")
    )
    counted = kept.select(
        "lang", "term", F.col("n").alias("lang_n"), F.explode("by_source").alias("s")
    ).select("lang", "term", "lang_n", "s.source", "s.n")
    totals = counted.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("own")
    )
    groups = (
        copies.select("lang", "source").distinct()
        .join(langs, "lang", "left")
        .join(totals, ["lang", "source"], "left")
        .na.fill(0, ["terms", "lang_total", "total", "own"])
    )
    groups = stored(groups.withColumn("none", _chance("0", "total", "terms")), "source-groups")
    chances = stored(
        counted.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", _chance("n", "total", "terms").alias("p"),
            _chance("lang_n", "lang_total", "terms").alias("q"), "none",
        ),
        "term-chances",
    )

    other = groups.select(
        "lang", F.col("source").alias("other"), F.col("none").alias("other_none"),
        F.col("own").alias("other_own"),
    )
    base = groups.join(other, "lang").where("source < other").select(
        "lang", "source", "other",
        F.expr(f"coalesce((terms - own - other_own) * ({_gap('none', 'other_none')}), 0)")
        .alias("value"),
    )
    alone = (  # as if the other source had none of the terms; terms of equal count at once
        chances.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
        .join(other, "lang").where("source <> other")
        .select(
            "lang", F.least("source", "other").alias("source"),
            F.greatest("source", "other").alias("other"),
            F.expr(f"k * ({_gap('p', 'other_none')})").alias("value"),
        )
    )
    shared = (  # what a term changes that both have
        chances.groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "p", "none")).alias("s"))
        .select("lang", F.explode("s").alias("a"), "s")
        .select("lang", "a", F.explode(F.expr("filter(s, x -> x.source > a.source)")).alias("b"))
        .select(
            "lang", F.col("a.source").alias("source"), F.col("b.source").alias("other"),
            F.expr(
                f"{_gap('a.p', 'b.p')} - {_gap('a.p', 'b.none')} - {_gap('a.none', 'b.p')} "
                f"+ {_gap('a.none', 'b.none')}"
            ).alias("value"),
        )
    )
    pairs = (
        base.unionByName(alone).unionByName(shared)
        .groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    )
    both = pairs.select("lang", "source", F.col("other").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "value")
    )
    stand_out = chances.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value")
    )
    place = F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    )

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select(
            "lang", "source", F.lit(part).alias("part"), "item",
            F.col("value").cast("long").alias("value"), place.alias("rank"),
        )

    return ranked(both, "pair").unionByName(
        ranked(stand_out, "term").where(F.col("rank") <= top_terms)
    )


# Every term of every group and pair, without collapsing or sparse sums.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
tok AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok GROUP BY ALL),
kept AS (SELECT lang, term, n FROM (
  SELECT lang, term, count(*) AS n, count(DISTINCT id) AS docs FROM tok GROUP BY ALL) WHERE docs >= 10),
grp AS (SELECT DISTINCT lang, source FROM d),
gk AS (
  SELECT grp.lang, grp.source, kept.term, CAST(coalesce(cnt.n, 0) AS HUGEINT) AS n
  FROM grp JOIN kept ON grp.lang = kept.lang
  LEFT JOIN cnt ON cnt.lang = grp.lang AND cnt.source = grp.source AND cnt.term = kept.term),
gt AS (SELECT lang, source, sum(n) AS total, count(*) AS terms FROM gk GROUP BY ALL),
lt AS (SELECT lang, CAST(sum(n) AS HUGEINT) AS total, count(*) AS terms FROM kept GROUP BY ALL),
p AS (
  SELECT gk.lang, gk.source, gk.term, gk.n,
         1 + (1000000000 * (gk.n + 2)) // (CAST(gt.total AS HUGEINT) + 2 * gt.terms) AS p
  FROM gk JOIN gt ON gk.lang = gt.lang AND gk.source = gt.source),
q AS (
  SELECT kept.lang, kept.term,
         1 + (1000000000 * (CAST(kept.n AS HUGEINT) + 2)) // (lt.total + 2 * lt.terms) AS q
  FROM kept JOIN lt ON kept.lang = lt.lang),
pv AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM r WHERE part = 'pair' OR rank <= 10
"""
