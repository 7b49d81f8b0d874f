"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import n_words, row_key, stored

CAPACITIES = (512, 1024, 2048, 4096, 8192)
BIN_COST = 64  # fixed cost of a sequence, in words
SHARD_ROWS = 8192

_PLACES = (
    "row long, copy int, doc_id long, piece int, start long, n_words long,"
    " bin_id long, bin_capacity int, bin_offset int"
)


def best_fit(
    lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST
) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of every length (each between 1 and the largest capacity), and the
    capacity of every bin.

    Lengths go in from long to short, into the open bin that is left with least room. If
    none fits, the size that costs least per word opens: its cost is its capacity and
    ``bin_cost``, its words are this length and what the shorter lengths still to come can
    fill. In the end each bin shrinks to the smallest permitted size that holds it.
    """
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    rest = np.concatenate([np.cumsum(falling[::-1])[::-1], [0]])
    negative = (-falling).tolist()
    rooms: dict[int, list[int]] = {}
    mask = 0  # bit r: some open bin has room r
    fill: list[int] = []
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    for i, length in enumerate(falling.tolist()):
        fits = mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            stack = rooms[room]
            k = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            size = best = None
            for c in capacities:
                if c >= length:
                    later = rest[max(i + 1, bisect_left(negative, length - c))]
                    cost = (c + bin_cost) / (length + min(c - length, int(later)))
                    if best is None or cost < best:
                        size, best = c, cost
            room, k = size, len(fill)
            fill.append(0)
        at = order[i]
        bins[at], offsets[at] = k, fill[k]
        fill[k] += length
        room -= length
        if room:
            rooms.setdefault(room, []).append(k)
            mask |= 1 << room
    return bins, offsets, [next(c for c in capacities if c >= f) for f in fill]


def _pack_shards(capacities: tuple[int, ...], bin_cost: int):
    top = capacities[-1]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "row"], ascending=[False, True], kind="stable")
        sizes = frame["size"].to_numpy()
        pieces = np.maximum(1, -(-sizes // top))
        at = np.repeat(np.arange(len(frame)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * top
        length = np.minimum(sizes[at] - start, top)
        full = length > 0
        bins, offsets, caps = best_fit(length[full], capacities, bin_cost)
        base = int(frame["shard"].iloc[0]) << 32
        out = pd.DataFrame(
            {
                "row": frame["row"].to_numpy()[at],
                "copy": frame.groupby("row").cumcount().to_numpy()[at].astype(np.int32),
                "doc_id": frame["doc_id"].astype("Int64").array[at],
                "piece": piece.astype(np.int32),
                "start": start,
                "n_words": length,
            }
        )
        for name, values in (
            ("bin_id", bins + base),
            ("bin_capacity", np.array(caps, np.int64)[bins] if len(bins) else bins),
            ("bin_offset", offsets),
        ):
            column = pd.array([None] * len(out), dtype="Int64")
            column[full] = values
            out[name] = column
        return out

    return pack


def pack_documents(
    docs: DataFrame,
    capacities: tuple[int, ...] = CAPACITIES,
    bin_cost: int = BIN_COST,
) -> DataFrame:
    """Places of all documents in bins: one row per piece of a document.

    ``row`` identifies id and text, ``copy`` numbers repeated rows; ``start`` and
    ``n_words`` are the words of the piece, ``bin_offset`` its place in bin ``bin_id`` of
    ``bin_capacity`` words. A document longer than the largest capacity is cut into pieces
    of that length and a rest; no word is lost. Null and empty texts give one row with no
    bin. Documents are dealt by hash into shards of about ``SHARD_ROWS`` rows and each
    shard is packed alone, so the work is linear and only a few bins per shard stay slack.
    """
    capacities = tuple(sorted(capacities))
    items = stored(
        docs.select(row_key().alias("row"), F.col("doc_id").cast("long"), n_words().alias("size")),
        "pack-sizes",
    )
    shards = max(1, -(-items.count() // SHARD_ROWS))
    return (
        items.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_pack_shards(capacities, bin_cost), _PLACES)
    )


def packed_documents(docs: DataFrame) -> DataFrame:
    """The places of ``pack_documents`` with the text of each piece, and source and lang. Other
    columns of ``docs``, n_chars among them, are of whole documents and left out.

    Texts move once, to their places; pieces keep the white space before their words.
    """
    places = (
        pack_documents(docs)
        .groupBy("row")
        .agg(
            F.collect_list(
                F.struct(
                    "copy", "piece", "start", "n_words", "bin_id", "bin_capacity", "bin_offset"
                )
            ).alias("_places")
        )
    )
    # Several pieces of one text: words with the white space before them.
    rule = r"r'[\x20\x09-\x0D]*[^\x20\x09-\x0D]+'"
    text = F.expr(
        "CASE WHEN size(_places) = 1 OR (p.start = 0 AND NOT exists(_places, x -> x.piece > 0))"
        " THEN text ELSE array_join(slice(_words, int(p.start) + 1, int(p.n_words)), '') END"
    )
    joined = docs.select(
        row_key().alias("row"), "doc_id", "source", "lang", "text"
    ).join(places, "row")
    numbered = joined.withColumn(
        "_copy", F.row_number().over(Window.partitionBy("row").orderBy("row")) - 1
    ).withColumn("_places", F.expr("filter(_places, x -> x.copy = _copy)"))
    return (
        numbered.withColumn(
            "_words",
            F.expr(f"CASE WHEN size(_places) > 1 THEN regexp_extract_all(text, {rule}, 0) END"),
        )
        .withColumn("p", F.explode("_places"))
        .select(
            "p.bin_id",
            "p.bin_capacity",
            "p.bin_offset",
            "doc_id",
            "p.piece",
            "p.start",
            "p.n_words",
            "source",
            "lang",
            text.alias("text"),
        )
    )
