"""Quality classifier: ordinal cumulative-link regression on graded ratings of texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import apart, hash_sample, stored

BUCKETS = 1 << 15
SAMPLE_ROWS = 4000  # bound on labelled rows that training sees
LEAST_TAIL = 0.5  # a document stays if P(grade >= 1) is at least this
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def hashed_words() -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """Function from a text to buckets and values of its features.

    Each word counts as itself without case and edge punctuation, as its case with its edge
    punctuation, and as a repetition if it equals the word before. Values are square
    roots of shares, so a text has the same length whatever its number of words.
    """
    known: dict[str, tuple[int, int]] = {}

    def buckets(word: str) -> tuple[int, int]:
        core = word.strip(PUNCTUATION)
        case = (
            "-" if not core
            else "d" if core.isdigit()
            else "l" if core.islower()
            else "u" if len(core) > 1 and core.isupper()
            else "t" if core[0].isupper()
            else "m"
        )
        edge = word.replace(core, "_", 1) if core else word
        return (
            crc32(("w" + core.lower()).encode()) % BUCKETS,
            crc32(("s" + case + edge[:12]).encode()) % BUCKETS,
        )

    again = crc32(b"again") % BUCKETS

    def features(text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.empty(0, np.int64), np.empty(0)
        if len(known) > 500_000:
            known.clear()
        counts: dict[int, int] = {}
        for word, n in Counter(words).items():
            pair = known.get(word)
            if pair is None:
                pair = known[word] = buckets(word)
            for k in pair:
                counts[k] = counts.get(k, 0) + n
        repeats = sum(map(str.__eq__, words[1:], words))
        if repeats:
            counts[again] = counts.get(again, 0) + repeats
        at = np.fromiter(counts.keys(), np.int64, len(counts))
        return at, np.sqrt(np.fromiter(counts.values(), float, len(counts)) / len(words))

    return features


@dataclass
class OrdinalModel:
    """P(grade <= k) = logistic(thresholds[k] - weights . x)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, margin: float) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= top)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - margin, -500, 500)))


def fit_ordinal(
    rows: list[tuple[np.ndarray, np.ndarray]],
    grades: np.ndarray,
    steps: int = 300,
    rate: float = 0.05,
    decay: float = 3e-5,
) -> OrdinalModel | None:
    """Maximum likelihood by gradient steps (Adam). Thresholds stay ordered, as each is the
    one before plus an exponential. None if fewer than two grades are present."""
    if len(np.unique(grades)) < 2:
        return None
    top = int(grades.max())
    sizes = np.array([len(a) for a, _ in rows])
    at = np.concatenate([a for a, _ in rows])
    value = np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    used, at = np.unique(at, return_inverse=True)
    n = len(rows)
    share = np.array([(grades > k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(top))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    theta = np.concatenate([np.zeros(len(used)), start[:1], gaps])
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def thresholds(theta: np.ndarray) -> np.ndarray:
        tail = theta[len(used):]
        return tail[0] + np.concatenate([[0], np.cumsum(np.exp(tail[1:]))])

    rank = np.arange(n)
    for step in range(1, steps + 1):
        cuts = thresholds(theta)
        margin = np.bincount(owner, theta[at] * value, n)
        below = 1 / (1 + np.exp(np.clip(margin[:, None] - cuts, -500, 500)))
        wide = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = wide * (1 - wide)
        high, low = grades + 1, grades
        chance = np.maximum(wide[rank, high] - wide[rank, low], 1e-12)
        by_high, by_low = slope[rank, high] / chance, slope[rank, low] / chance
        to_margin = (by_high - by_low) / n  # gradient of the loss
        by_cut = np.zeros(top + 2)
        np.add.at(by_cut, high, -by_high / n)
        np.add.at(by_cut, low, by_low / n)
        by_cut = by_cut[1:-1]
        after = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate(
            [
                np.bincount(at, to_margin[owner] * value, len(used)) + decay * theta[: len(used)],
                after[:1],
                after[1:] * np.exp(theta[len(used) + 1:]),
            ]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.999**step)) + 1e-8
        )
    weights = np.zeros(BUCKETS)
    weights[used] = theta[: len(used)]
    return OrdinalModel(weights, thresholds(theta))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = hashed_words()
    for batch in batches:
        made = [features(text or "") for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("grade"),
                pa.array([a.astype("<i4").tobytes() for a, _ in made], pa.binary()),
                pa.array([v.astype("<f8").tobytes() for _, v in made], pa.binary()),
            ],
            ["grade", "at", "value"],
        )


def train_quality(
    docs: DataFrame, grades: DataFrame, sample_rows: int = SAMPLE_ROWS
) -> OrdinalModel | None:
    """Fit on at most ``sample_rows`` labelled documents, chosen by hash of their ids.

    ``grades`` has doc_id and grade (0, 1, ...; higher is better). Texts become feature rows
    on the executors; the driver gets only those of the sample. The sample's bound also
    bounds the broadcast of its ids.
    """
    chosen = stored(
        hash_sample(
            grades.where("doc_id IS NOT NULL AND grade >= 0").select(
                "doc_id", F.col("grade").cast("int").alias("grade")
            ),
            ["doc_id", "grade"],
            sample_rows,
        ),
        "quality-sample",
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "grade").agg(F.min("text").alias("text"))  # of a repeated id, one text
        .select("grade", "text")
        .mapInArrow(_feature_rows, "grade int, at binary, value binary")
        .collect()
    )
    if not rows:
        return None
    rows.sort(key=lambda r: (r.grade, r.at, r.value))
    return fit_ordinal(
        [(np.frombuffer(r.at, "<i4"), np.frombuffer(r.value, "<f8")) for r in rows],
        np.array([r.grade for r in rows]),
    )


def _scorer(model: OrdinalModel | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = hashed_words()
        for batch in batches:
            expected, tail = [], []
            for text in batch.column("_text").to_pylist():
                if model is None:
                    expected.append(None)
                    tail.append(None)
                    continue
                at, value = features(text or "")
                tails = model.tails(float(model.weights[at] @ value))
                expected.append(float(tails.sum()))
                tail.append(float(tails[0]))
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names],
                    pa.array(expected, pa.float64()),
                    pa.array(tail, pa.float64()),
                ],
                [*names, "expected_grade", "tail_probability"],
            )

    return score


def grade_documents(
    docs: DataFrame, model: OrdinalModel | None, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep`` of every document, with expected_grade, tail_probability of grade 1
    or better, and kept (tail_probability at least ``LEAST_TAIL``). Where ``keep`` has such a name,
    the operator's column gets an underscore in front.

    Null and empty texts have no features: their grade follows the thresholds alone.
    Without a model (no labelled rows, or one grade only) both numbers are null and every
    document is kept. Each whole text is read once, nothing is shuffled.
    """
    fields = [f"c{k}" for k in range(len(keep))]
    picked = docs.select(
        *[F.col(f"`{c}`").alias(name) for c, name in zip(keep, fields)], F.col("text").alias("_text")
    )
    schema = ", ".join(f"{n} {kind}" for n, kind in picked.drop("_text").dtypes)
    scored = picked.mapInArrow(
        _scorer(model), f"{schema}, expected_grade double, tail_probability double"
    ).withColumn(
        "kept", F.coalesce(F.col("tail_probability") >= LEAST_TAIL, F.lit(True))
    )
    taken = {c.lower() for c in keep}
    own = []
    for name in ("expected_grade", "tail_probability", "kept"):
        while name in taken:
            name = f"_{name}"
        own.append(name)
    return scored.toDF(*keep, *own)


def kept_documents(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """The documents that ``grade_documents`` keeps, with all their columns."""

    def run(plain: DataFrame) -> DataFrame:
        columns = plain.columns
        return grade_documents(plain, model, tuple(columns)).where("kept").select(*columns)

    return apart(docs, run)


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the label table: 0 poor, 1 good but toxic, 2 good. Null labels give none."""
    return labels.select(
        "doc_id",
        F.when(F.col("quality") == 0, 0)
        .when(F.col("toxic") == 1, 1)
        .when(F.col("quality") == 1, 2)
        .alias("grade"),
    ).where("grade IS NOT NULL")
