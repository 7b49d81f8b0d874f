"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import hash_sample, stored

SIZES = (3, 4, 5)
BUCKETS = 1 << 22
CLASS_SAMPLE = 2000  # bound on labelled rows of each class that training sees
FEATURES = 6000
LEAST_Z = 5.0  # z-score of a feature, or half the largest one in small samples
LEAST_DOCUMENTS = 4  # a feature occurs in at least so many sample documents
CUT = 0.3
STRIPE = 1 << 20  # characters that are hashed at once


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of the lower-cased text, edges marked by spaces, in
    pieces that overlap so that no n-gram is lost."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(points), STRIPE):
        part = points[start : start + STRIPE + SIZES[-1] - 1].astype(np.uint64)
        code = part.copy()
        for n in range(2, SIZES[-1] + 1):
            if len(part) < n:
                break
            code = code[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :]
            if n in SIZES:
                # The last stripe's tail of one piece is the head of the next.
                own = code[:STRIPE] * np.uint64(0x9E3779B97F4A7C15)
                yield (own >> np.uint64(42)).astype(np.int64)


@dataclass
class ToxicityModel:
    """logit = bias + sum of the weights of the features present; ``buckets`` are theirs."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def places(self) -> np.ndarray:
        """Feature of each bucket, -1 for the others."""
        place = np.full(BUCKETS, -1, np.int32)
        place[self.buckets] = np.arange(len(self.buckets))
        return place


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for text in batch.column("text").to_pylist():
            pieces = [np.unique(b) for b in gram_buckets(text or "")]
            found = np.unique(np.concatenate(pieces)) if pieces else np.empty(0, np.int64)
            made.append(found.astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(made, pa.binary())], ["toxic", "at"]
        )


def fit_toxicity(
    rows: list[np.ndarray], toxic: np.ndarray, prior: float, steps: int = 300
) -> ToxicityModel | None:
    """``rows`` are the buckets present in each document. Features are chosen by the z-score
    of the two classes' document shares; their values are presence times the naive Bayes
    log-count ratio; weights come from logistic regression. ``prior`` is the share of toxic
    documents among all labelled ones and sets the bias, as the sample is balanced.
    """
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return None
    seen = np.zeros((2, BUCKETS), np.int32)  # documents of each class that have the n-gram
    for found, kind in zip(rows, toxic):
        seen[int(kind), found] += 1
    often = np.flatnonzero(seen.sum(axis=0) >= min(LEAST_DOCUMENTS, n1))
    in0, in1 = seen[:, often]
    shared = (in1 + in0) / (n1 + n0)
    spread = np.sqrt(np.maximum(shared * (1 - shared) * (1 / n1 + 1 / n0), 1e-12))
    z = np.abs(in1 / n1 - in0 / n0) / spread
    best = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    best = best[(z[best] > 0) & (z[best] >= min(LEAST_Z, z.max(initial=0) / 2))]
    chosen, in0, in1 = often[best], in0[best], in1[best]
    model = ToxicityModel(chosen, np.zeros(len(chosen)), 0.0)
    place = model.places()
    ratio = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    present = [place[found] for found in rows]
    present = [p[p >= 0] for p in present]
    feature = np.concatenate(present)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in present])
    value, y = ratio[feature], toxic.astype(float)
    theta = np.zeros(len(chosen) + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        logit = np.bincount(owner, theta[feature] * value, len(rows)) + theta[-1]
        miss = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y) / len(rows)
        slope = np.concatenate(
            [np.bincount(feature, miss[owner] * value, len(chosen)), [miss.sum()]]
        )
        slope[:-1] += 1e-3 * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta - 0.02 * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.999**step)) + 1e-8
        )
    shift = np.log(prior / (1 - prior)) - np.log(n1 / n0)
    return ToxicityModel(chosen, theta[:-1] * ratio, float(theta[-1] + shift))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, class_sample: int = CLASS_SAMPLE
) -> ToxicityModel | None:
    """Fit on at most ``class_sample`` labelled documents of each class, chosen by hash of
    their ids, out of ``labels`` (doc_id, toxic). Only the text is an input."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")
    ).distinct()
    share = known.agg(F.avg("toxic")).first()[0]
    if share is None:
        return None
    chosen = stored(
        hash_sample(known.where("toxic = 1"), ["doc_id"], class_sample).unionByName(
            hash_sample(known.where("toxic = 0"), ["doc_id"], class_sample)
        ),
        "toxic-sample",
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of a repeated id, one text
        .select("toxic", "text")
        .mapInArrow(_presence, "toxic int, at binary")
        .collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (r.toxic, r.at))
    return fit_toxicity(
        [np.frombuffer(r.at, "<i4") for r in rows],
        np.array([r.toxic == 1 for r in rows]),
        min(max(share, 1e-4), 1 - 1e-4),
    )


def _scorer(model: ToxicityModel | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = np.zeros(len(model.weights) if model else 0, bool)
        place = model.places() if model else None
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                if model is None:
                    scores.append(0.0)
                    continue
                present[:] = False
                for buckets in gram_buckets(text or ""):
                    at = place[buckets]
                    present[at[at >= 0]] = True
                logit = model.bias + float(model.weights[present].sum())
                scores.append(float(1 / (1 + np.exp(-np.clip(logit, -500, 500)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id, score and predicted (score at least ``CUT``) of every document.

    Whole texts are read; null counts as empty, whose score is that of its edge marks and
    the bias. Without a model (no labelled rows of both classes) every score is 0. Nothing is
    shuffled.
    """
    return (
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(_scorer(model), "doc_id long, score double")
        .withColumn("predicted", (F.col("score") >= CUT).cast("int"))
    )
