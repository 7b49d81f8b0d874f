"""Language-model scores: Katz backoff with Good-Turing discounts over all documents.

The corpus is cut into chunks of documents. Words and bigrams are counted per chunk before
anything is shuffled, word ids are ranks by frequency (small numbers), and everything that is
shuffled is packed, so that each token costs a few bytes of disk.

1. ``encoded_chunks``: one row per chunk with its distinct words and its tokens as places in them.
2. ``ranked_words``: the unigram table, ranked; each chunk gets the ranks of its own words.
3. ``bigram_table``: bigrams of all chunks meet by context in a partitioned table, with the
   documents that ask for them.
4. ``_evaluate``: the table scores its askers, P(w|h) = discounted count if seen, else the
   weight of h times P(w); sums per document (single precision per partition) meet again by
   chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import ordered_offsets, stored

CHUNK_TOKENS = 2_500_000
PART_TOKENS = 1_500_000  # tokens per partition of the bigram table
PART_WORDS = 400_000  # distinct words of chunks per partition of the unigram table
HOT_SHARE = 2000  # a context with more than 1/2000 of all tokens is spread over all partitions
CUTOFF = 5  # counts above this are not discounted
END = b"\n"  # no word holds a line feed


# ---- packing ----------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as one compressed value, bytes of like weight together."""
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu" and a.size:
            top = int(a.max())
            a = a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(t[2])))
        kind = a.dtype.str.encode().ljust(4)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if a.size else a
        out += [kind, len(a).to_bytes(8, "little"), np.ascontiguousarray(planes).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:2], "little"), 2, []
    for _ in range(n):
        kind = np.dtype(raw[at : at + 4].decode().strip())
        size = int.from_bytes(raw[at + 4 : at + 12], "little")
        at += 12
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at)
        at += size * kind.itemsize
        values = np.ascontiguousarray(planes.reshape(kind.itemsize, size).T).view(kind).ravel()
        # Small unsigned numbers stay small; eight bytes are signed.
        out.append(values.astype(np.int64) if kind == np.dtype("<u8") else values)
    return out


# ---- Good-Turing ------------------------------------------------------------------------


def discounts(of: np.ndarray) -> np.ndarray:
    """Factors d[r] of counts r = 0 ... CUTOFF (d[0] unused), from the numbers ``of`` of
    things seen 1 ... CUTOFF + 1 times. Where these give no proper discount (small or odd
    tables), half a count is taken off instead."""
    r = np.arange(1, CUTOFF + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = (CUTOFF + 1) * of[CUTOFF] / of[0]
        d = ((r + 1) * of[1:] / (r * of[:-1]) - tail) / (1 - tail)
    fair = np.isfinite(d) & (d > 0) & (d < 1) & np.isfinite(tail) & (tail < 1)
    return np.concatenate([[1.0], np.where(fair, d, (r - 0.5) / r)])


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return count * np.where(count > CUTOFF, 1.0, d[np.minimum(count, CUTOFF)])


@dataclass
class Unigrams:
    """Counts of ranked words as steps, at most sqrt(2 N) of them, and P(word)."""

    starts: np.ndarray  # first rank of each count, rising
    counts: np.ndarray  # falling
    tokens: int
    words: int
    d: np.ndarray
    scale: float
    unknown: float

    def count(self, rank: np.ndarray) -> np.ndarray:
        """Training count of each rank; 0 for rank -1, the unknown word."""
        if not len(self.starts):
            return np.zeros(len(rank), np.int64)
        found = self.counts[np.maximum(np.searchsorted(self.starts, rank, "right") - 1, 0)]
        return np.where(rank < 0, 0, found)

    def chance(self, rank: np.ndarray) -> np.ndarray:
        c = self.count(rank)
        if not self.tokens:
            return np.ones(len(rank))
        return np.where(c > 0, self.scale * discounted(c, self.d) / self.tokens, self.unknown)

    def base(self, rank: np.ndarray) -> np.ndarray:
        return np.log10((self.count(rank) + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def unigrams(counts: np.ndarray, numbers: np.ndarray) -> Unigrams:
    """From the distinct counts, falling, and the number of words with each."""
    tokens, words = int((counts * numbers).sum()), int(numbers.sum())
    of = np.array([numbers[counts == r].sum() for r in range(1, CUTOFF + 2)], float)
    d = discounts(of)
    kept = float((discounted(counts, d) * numbers).sum() / tokens) if tokens else 0.0
    scale = 1.0 if kept < 1 - 1e-12 else tokens / (tokens + 1)
    starts = np.cumsum(numbers) - numbers
    return Unigrams(starts, counts, tokens, words, d, scale, 1 - scale * kept)


_PIECE = "part int, chunk long, blob binary"


# ---- 1. chunks --------------------------------------------------------------------------

_CHUNK = (
    "chunk long, n_words int, ids array<long>, held array<boolean>, lengths binary,"
    " codes binary, words binary, counts binary"
)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place: dict[bytes, int] = {END: 0}
    ids: list = []
    held: list[bool] = []
    codes: list[np.ndarray] = []
    tokens = made = 0
    part = TaskContext.get().partitionId() if TaskContext.get() else 0

    def chunk() -> pa.RecordBatch:
        nonlocal place, ids, held, codes, tokens, made
        lengths = np.array([len(c) for c in codes])
        flat = np.concatenate(codes)
        train = ~np.repeat(np.array(held), lengths)
        counts = np.bincount(flat[train], minlength=len(place))
        words = np.array([xxhash.xxh64_intdigest(w) for w in place], np.uint64).view(np.int64)
        made += 1
        row = [
            pa.array([(part << 24) + made], pa.int64()),
            pa.array([len(place)], pa.int32()),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([held], pa.list_(pa.bool_())),
            *[pa.array([b], pa.binary()) for b in (
                pack(lengths), pack(flat), words.tobytes(), pack(counts))],
        ]
        place, ids, held, codes, tokens = {END: 0}, [], [], [], 0
        names = ["chunk", "n_words", "ids", "held", "lengths", "codes", "words", "counts"]
        return pa.RecordBatch.from_arrays(row, names)

    for batch in batches:
        names, flags, texts = (batch.column(c) for c in ("doc_id", "held", "text"))
        for doc_id, out, text in zip(names.to_pylist(), flags.to_pylist(), texts):
            text = text.as_py()
            # bytes.lower changes A-Z only; bytes.split cuts at the six ASCII white spaces.
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            for w in words:
                if w not in place:
                    place[w] = len(place)
            code = np.zeros(len(words) + 1, np.int32)
            code[:-1] = list(map(place.__getitem__, words))
            codes.append(code)
            ids.append(doc_id)
            held.append(bool(out))
            tokens += len(words) + 1
            if tokens >= CHUNK_TOKENS:
                yield chunk()
    if codes:
        yield chunk()


def encoded_chunks(docs: DataFrame, held_out: Column) -> DataFrame:
    """Chunks of about ``CHUNK_TOKENS`` tokens; ``counts`` are those of training documents."""
    picked = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held"), "text"
    )
    return stored(picked.mapInArrow(_encode, _CHUNK), "katz-chunks")


# ---- 2. words ---------------------------------------------------------------------------


def _chunk_words(parts: int):
    """Words of each chunk by hash range: hashes (rising), places in the chunk, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "counts")))
            for chunk, words, counts in rows:
                h = np.frombuffer(words, np.uint64)
                n = unpack(counts)[0]
                place = np.argsort(h)
                h = h[place]
                part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                blobs = [
                    pack(
                        np.diff(h[cuts[p] : cuts[p + 1]], prepend=np.uint64(0)),
                        place[cuts[p] : cuts[p + 1]],
                        n[place[cuts[p] : cuts[p + 1]]],
                    )
                    for p in full
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([chunk] * len(full), pa.int64()),
                        pa.array(blobs, pa.binary()),
                    ],
                    ["part", "chunk", "blob"],
                )

    return run


def _sum_words(pieces: pd.DataFrame) -> pd.DataFrame:
    parsed = [unpack(b) for b in pieces["blob"]]
    word = np.concatenate([np.cumsum(p[0], dtype=np.int64) for p in parsed])
    n = np.concatenate([p[2] for p in parsed])
    word, at = np.unique(word, return_inverse=True)
    n = np.bincount(at, n, len(word)).astype(np.int64)
    return pd.DataFrame({"word": word[n > 0], "n": n[n > 0]})


def _answer_words(pieces: pd.DataFrame, ranked: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, the places of its words in this part with their ranks (+ 1)."""
    ranked = ranked.sort_values("word")
    word, rank = ranked["word"].to_numpy(), ranked["rank"].to_numpy()
    out = []
    for blob in pieces["blob"]:
        rise, place, _ = unpack(blob)
        asked = np.cumsum(rise, dtype=np.int64)
        at = np.minimum(np.searchsorted(word, asked), max(0, len(word) - 1))
        found = word[at] == asked if len(word) else np.zeros(len(asked), bool)
        out.append(pack(place[found], rank[at[found]] + 1 if len(word) else place[found]))
    return pd.DataFrame({"chunk": pieces["chunk"], "blob": out})


def ranked_words(chunks: DataFrame) -> tuple[DataFrame, Unigrams]:
    """Packed (place, rank + 1) of the words that training has, by chunk, and the unigram model.

    Words are counted per chunk before the shuffle and travel packed; ranks by falling count
    are distributed prefix sums; only the number of words per count goes to the driver, at
    most sqrt(2 x tokens) rows.
    """
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, -(-total // PART_WORDS))
    pieces = chunks.select("chunk", "words", "counts").mapInArrow(_chunk_words(parts), _PIECE)
    counts = (
        pieces.groupBy("part")
        .applyInPandas(_sum_words, "word long, n long")
        .select("word", (-F.col("n")).alias("falling"), F.lit(1).cast("long").alias("one"))
    )
    ranked = stored(
        ordered_offsets(counts, ["falling", "word"], {"rank": "one"}, "katz-words").select(
            "word", "falling", "rank"
        ),
        "katz-ranks",
    )
    steps = ranked.groupBy("falling").agg(F.count(F.lit(1)).alias("k")).orderBy("falling").collect()
    model = unigrams(
        np.array([-s.falling for s in steps], np.int64), np.array([s.k for s in steps], np.int64)
    )
    part = F.expr(f"int(shiftrightunsigned(shiftrightunsigned(word, 32) * {parts}L, 32))")
    answers = (
        pieces.groupBy("part")
        .cogroup(ranked.select(part.alias("part"), "word", "rank").groupBy("part"))
        .applyInPandas(_answer_words, "chunk long, blob binary")
    )
    return answers, model


# ---- 3. bigrams -------------------------------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = "kind int, part int, chunk long, context long, sums array<double>, blob binary"


def _parts(context: np.ndarray, word: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    x = context.astype(np.uint64) + np.uint64(1)
    x = np.where(hot, x * _MIX + word.astype(np.uint64) + np.uint64(7), x) * _MIX
    return ((x >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _chunk_bigrams(model: Unigrams, parts: int):
    least_hot = max(2, model.tokens // HOT_SHARE)

    def run(chunk: pd.DataFrame, ranks: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame({"part": [], "chunk": [], "blob": []})
        c = chunk.iloc[0]
        lengths, flat = unpack(c["lengths"])[0], unpack(c["codes"])[0]
        held = np.array(c["held"], bool)
        rank = np.full(c["n_words"], -1, np.int64)
        for blob in ranks["blob"]:
            place, value = unpack(blob)
            rank[place] = value.astype(np.int64) - 1
        n = len(lengths)
        doc = np.repeat(np.arange(n, dtype=np.int32), lengths)
        # Places in the chunk's own list of ranks: small, and in order of rank; 0 is unknown.
        own = np.unique(np.concatenate([[-1], rank]))
        local = np.searchsorted(own, rank).astype(np.int32)[flat]
        del flat
        before = np.concatenate([np.searchsorted(own, rank[:1]).astype(np.int32), local[:-1]])
        known = before > 0
        lone = np.log10(model.chance(own))  # no context: the recursion ends here
        base = [
            np.bincount(doc, model.base(own)[local], n),
            np.bincount(doc[local > 0], minlength=n),
            np.bincount(doc[~known], lone[local[~known]], n).astype(float),
        ]
        out = [(-1 - int(c["chunk"]) % parts, pack(lengths, held, base[1], base[0], base[2]))]
        key = before[known].astype(np.int64)
        key *= len(own)
        key += local[known]
        key *= n
        key += doc[known]
        del doc, local, before, known
        key.sort()
        start = np.flatnonzero(np.diff(key, prepend=-1))  # of each (context, word, document)
        times = np.diff(start, append=len(key)).astype(np.int32)
        pair, asker = np.divmod(key[start], n)
        del key, start
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        train = np.where(held[asker], 0, times)
        train = np.add.reduceat(train, first) if len(first) else first
        askers = np.diff(first, append=len(pair))
        context, word = np.divmod(pair[first], len(own))
        del pair, first
        context, word = own[context], own[word]
        part = _parts(context, word, model.count(context) >= least_hot, parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        begin = np.cumsum(askers) - askers  # of each bigram's askers
        for p in range(parts):
            mine = order[cuts[p] : cuts[p + 1]]
            if len(mine):
                size = askers[mine]
                ask = np.repeat(begin[mine] - (np.cumsum(size) - size), size)
                ask += np.arange(len(ask))
                blob = pack(
                    *_risen(context[mine], word[mine]), train[mine], size, asker[ask], times[ask]
                )
                out.append((p, blob))
        return pd.DataFrame(
            {"part": [p for p, _ in out], "chunk": c["chunk"], "blob": [b for _, b in out]}
        )

    return run


def _risen(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted bigrams as rises: of contexts, and of words within a context."""
    rise = np.diff(context, prepend=0)
    same = np.concatenate([[False], context[1:] == context[:-1]]) if len(context) else rise > 0
    return rise, np.where(same, np.diff(word, prepend=0), word + 1)


def _sunk(rise: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``_risen``."""
    context = np.cumsum(rise, dtype=np.int64)
    begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    total = np.cumsum(word, dtype=np.int64)
    lead = (total - word)[begin]
    return context, total - np.repeat(lead, np.diff(begin, append=len(word))) - 1


def _merge(model: Unigrams):
    """Bigram counts of one partition over all chunks, with the askers of each."""
    least_hot = max(2, model.tokens // HOT_SHARE)

    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        part = int(pieces["part"].iloc[0])
        empty: list = [None] * len(pieces)
        if part < 0:
            return pd.DataFrame(
                {"kind": 0, "part": part, "chunk": pieces["chunk"], "context": 0, "sums": empty,
                 "blob": pieces["blob"]}
            )
        pieces = pieces.sort_values("chunk")
        parsed = [unpack(b) for b in pieces["blob"]]
        bigrams = [_sunk(p[0], p[1]) for p in parsed]
        context = np.concatenate([b[0] for b in bigrams])
        word = np.concatenate([b[1] for b in bigrams])
        sizes = np.array([len(p[4]) for p in parsed])
        train = np.concatenate([p[2] for p in parsed])
        askers = np.concatenate([p[3] for p in parsed])
        asker = np.concatenate([p[4] for p in parsed])
        times = np.concatenate([p[5] for p in parsed])
        del parsed, bigrams
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        new = np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])])
        first = np.flatnonzero(new)
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        count = np.add.reduceat(train[order], first, dtype=np.int64)
        context, word = context[first], word[first]
        entry = np.repeat(entry, askers)
        of = np.bincount(np.minimum(count, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
        rows = [(2, 0, of.astype(float).tolist(), None)]
        begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        hot = model.count(context[begin]) >= least_hot
        sums = context_sums(count, word, begin, model)
        rows += [(3, int(context[begin[k]]), sums[k].tolist(), None) for k in np.flatnonzero(hot)]
        # Askers stay chunk by chunk, in bigram order, so their places rise within a chunk.
        head = np.cumsum(sizes) - sizes
        rise = np.diff(entry, prepend=0)
        rise[head] = entry[head]
        blob = pack(
            *_risen(context, word), count, pieces["chunk"].to_numpy(), sizes, rise, asker, times
        )
        rows.append((1, 0, None, blob))
        return pd.DataFrame(
            {"kind": [r[0] for r in rows], "part": part, "chunk": 0,
             "context": [r[1] for r in rows], "sums": [r[2] for r in rows],
             "blob": [r[3] for r in rows]}
        )

    return run


def context_sums(
    count: np.ndarray, word: np.ndarray, begin: np.ndarray, model: Unigrams
) -> np.ndarray:
    """Per context, over its seen bigrams: tokens of those above the cutoff, numbers of those
    with count 1 ... CUTOFF, and the unigram chance of their words. They add up over
    partitions, and give the backoff weight once the discounts are known."""
    columns = [np.add.reduceat(np.where(count > CUTOFF, count, 0).astype(float), begin)]
    for r in range(1, CUTOFF + 1):
        columns.append(np.add.reduceat((count == r).astype(float), begin))
    columns.append(np.add.reduceat(np.where(count > 0, model.chance(word), 0.0), begin))
    return np.stack(columns, axis=1)


# ---- 4. evaluation ----------------------------------------------------------------------


def backoff(sums: np.ndarray, d: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale of the discounted counts and backoff weight of each context with ``total``
    training tokens: what the seen words leave, over the unigram chance of all other words,
    so that the chances of all words and of the unknown one add up to 1. A context whose
    counts are all above the cutoff gives up one count in total + 1."""
    kept = (sums[:, 0] + sums[:, 1:-1] @ (np.arange(1, CUTOFF + 1) * d[1:])) / total
    scale = np.where(kept < 1 - 1e-12, 1.0, total / (total + 1))
    return scale, (1 - scale * kept) / np.maximum(1 - sums[:, -1], 1e-300)


def _evaluate(model: Unigrams, d: np.ndarray, hot: dict[int, list[float]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, blob in zip(frame["part"], frame["blob"]):
                rise, word, count, chunks, sizes, entry, asker, times = unpack(blob)
                context, word = _sunk(rise, word)
                new = np.concatenate([[True], context[1:] != context[:-1]])
                begin = np.flatnonzero(new)
                sums = context_sums(count, word, begin, model)
                for k in np.flatnonzero(np.isin(context[begin], list(hot))):
                    sums[k] = hot[int(context[begin[k]])]
                total = model.count(context[begin])
                scale, weight = backoff(sums, d, total)
                at = np.cumsum(new) - 1
                value = np.where(
                    count > 0,
                    scale[at] * discounted(count, d) / total[at],
                    weight[at] * model.chance(word),
                )
                value = np.log10(value)
                cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                out = []
                for k in range(len(chunks)):
                    a, b = cuts[k], cuts[k + 1]
                    docs, inside = np.unique(asker[a:b], return_inverse=True)
                    scores = value[np.cumsum(entry[a:b], dtype=np.int64)] * times[a:b]
                    out.append(pack(docs, np.bincount(inside, scores, len(docs)).astype("<f4")))
                yield pd.DataFrame({"chunk": chunks.astype(np.int64), "part": part, "blob": out})

    return run


def _collect(pieces: pd.DataFrame) -> pd.DataFrame:
    """Scores of the documents of one chunk, by their places in it."""
    pieces = pieces.sort_values("part")
    base = pieces[pieces["part"] < 0]["blob"].iloc[0]
    lengths, held, known, base_score, score = unpack(base)
    score = score.copy()
    for blob in pieces[pieces["part"] >= 0]["blob"]:
        docs, sums = unpack(blob)
        score[docs] += sums
    return pd.DataFrame(
        {"chunk": pieces["chunk"].iloc[0], "place": np.arange(len(lengths)),
         "held_out": held.astype(bool), "n_tokens": lengths.astype(np.int64),
         "n_known": known.astype(np.int64),
         "base_score": base_score, "score": score}
    )


def katz_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the
    chance of the text and its end) of every document.

    The model learns from the documents where ``held_out`` is not true. Words are lower-cased
    (A-Z) and end at ASCII white space; each text has one end token, which is also the context
    of its first word. Words that training lacks count as one unknown word, whose chance is
    what the discounts of the unigrams leave. Null and empty texts consist of the end token;
    repeated rows count as often as they occur; without training documents every score is 0.
    """
    chunks = encoded_chunks(docs, held_out)
    ranks, model = ranked_words(chunks)
    parts = max(1, -(-model.tokens // PART_TOKENS))
    table = stored(
        chunks.select("chunk", "n_words", "held", "lengths", "codes")
        .groupBy("chunk")
        .cogroup(ranks.groupBy("chunk"))
        .applyInPandas(_chunk_bigrams(model, parts), _PIECE)
        .groupBy("part")
        .applyInPandas(_merge(model), _TABLE),
        "katz-bigrams",
    )
    of = table.where("kind = 2").agg(
        *[F.coalesce(F.sum(F.col("sums")[r]), F.lit(0.0)) for r in range(CUTOFF + 1)]
    ).first()
    # At most HOT_SHARE contexts can hold 1/HOT_SHARE of the tokens each.
    hot = (
        table.where("kind = 3")
        .groupBy("context")
        .agg(F.array(*[F.sum(F.col("sums")[r]) for r in range(CUTOFF + 2)]).alias("sums"))
        .collect()
    )
    sums = table.where("kind = 1").select("part", "blob").mapInPandas(
        _evaluate(model, discounts(np.array(of)), {h.context: h.sums for h in hot}), _PIECE
    )
    bases = table.where("kind = 0").select("part", "chunk", "blob")
    scores = bases.unionByName(sums).groupBy("chunk").applyInPandas(
        _collect,
        "chunk long, place int, held_out boolean, n_tokens long, n_known long,"
        " base_score double, score double",
    )
    ids = chunks.select("chunk", F.posexplode("ids").alias("place", "doc_id"))
    return ids.join(scores, ["chunk", "place"]).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
