"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its lower-cased characters.  On
labelled text, each feature gets the log ratio of its shares in toxic and other documents;
features are scaled by these ratios, and a logistic regression is fitted to them.  The
weights go to the tasks as one vector of fixed size, and every whole text is scored where it
is read: no shuffle.

Fitting uses at most ``SAMPLE`` labelled rows of each class, chosen by a hash of the id (one
row of each id, however often it is repeated); n-grams are counted by tasks, and more labels
do not make the driver's share grow.  Scores depend on the text alone.

Defined cases: null and empty texts have no features and get the share of class 1 as score;
without labels of both classes every score is the share of class 1; repeated rows get equal
scores; very long texts are scored whole, in blocks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, release, with_fields
from .labelled import held_out, prior, training_rows

SAMPLE = 2_000
"""Labelled rows of each class that the classifier is fitted to, at most."""
SIZES = (3, 4, 5)
BITS = 19
PIECE = 1 << 20
"""Characters whose n-grams are looked up at once."""
PARTS, PART = 4, 2
THRESHOLD = 0.3
SMOOTH = 1.0
LEAST_COUNT, LEAST_RATIO = 6, 1.0
"""Features of fewer training documents, or that say less, have no weight."""
ROUNDS, RATE, DECAY = 150, 0.3, 1.0


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased characters of all texts in a row, and where each text starts."""
    low = [(t or "").lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def grams(points: np.ndarray, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> Iterator[tuple[int, np.ndarray]]:
    """For each n-gram size the bucket of the n-gram that starts at each place."""
    h = points * np.uint32(2654435761)
    for n in range(2, max(sizes) + 1):
        if len(points) < n:
            return
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(2246822519) + points[n - 1 :] * np.uint32(3266489917)
        if n in sizes:
            yield n, ((h ^ (h >> np.uint32(13))) * np.uint32(n * 2 + 1) >> np.uint32(32 - bits)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of one text."""
    points, _ = code_points([text])
    found = [g for _, g in grams(points)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def sums(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """For each text the sum of the weights of its distinct features."""
    points, offsets = code_points(texts)
    docs, buckets = [], []
    for first in range(0, len(points), PIECE):  # pieces overlap by what an n-gram may reach over
        for n, g in grams(points[first : first + PIECE + max(SIZES) - 1]):
            at = np.flatnonzero(weights[g[:PIECE]])
            doc = np.searchsorted(offsets, at + first, side="right") - 1
            inside = at + first + n <= offsets[doc + 1]
            docs.append(doc[inside])
            buckets.append(g[at[inside]])
    out = np.zeros(len(texts))
    if docs:
        pairs = np.unique(np.concatenate(docs).astype(np.int64) << BITS | np.concatenate(buckets))
        np.add.at(out, pairs >> BITS, weights[pairs & ((1 << BITS) - 1)].astype(np.float64))
    return out


def ratios(p: np.ndarray, q: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-count ratio of every bucket that ``p`` of ``n1`` toxic and ``q`` of ``n0`` other texts have; 0 where it says too little."""
    ratio = np.log((p + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((q + SMOOTH) / (n0 + 2 * SMOOTH))
    ratio[(p + q < LEAST_COUNT) | (np.abs(ratio) < LEAST_RATIO)] = 0
    return ratio


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Weights of all buckets (ratio times coefficient) and the intercept, for classes of which the second has this share.

    ``rows`` are the buckets of each text that have a ratio.
    """
    flat = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    n1, n0 = labels.sum(), (1 - labels).sum()
    used = np.flatnonzero(ratio)
    where = np.searchsorted(used, flat).astype(np.int32)
    # The intercept is the log odds of the classes, so a text that says nothing gets the share of class 1.
    b = np.log((n1 + 1) / (n0 + 1))
    x, w, speed = ratio[used], np.zeros(len(used)), np.full(len(used), 1e-6)
    for _ in range(ROUNDS):  # full-batch steps scaled by past gradients
        score = b + np.bincount(of, weights=(w * x)[where], minlength=len(labels))
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels
        gradient = np.bincount(where, weights=error[of], minlength=len(used)) * x / len(labels) + DECAY * w / len(labels)
        speed += gradient**2
        w -= RATE * gradient / np.sqrt(speed)
    weights = np.zeros(len(ratio), np.float32)
    weights[used] = w * x
    return weights, float(np.log(share / (1 - share)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The classifier of the labelled rows that are not held out.

    The driver gets one row per bucket, then of each chosen text only the buckets that have a ratio.
    """
    chosen = training_rows(docs, labels, "toxic", PARTS, PART, sample)
    share = prior(labels, "toxic", PARTS, PART)
    size = 1 << BITS
    n = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    if len(n) < 2:
        return np.zeros(size, np.float32), float(np.log(share / (1 - share)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, size), np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                both[y, features(text)] += 1
        at = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[1, at]), pa.array(both[0, at])], names=["bucket", "p", "q"])

    sums_ = chosen.mapInArrow(count, "bucket bigint, p bigint, q bigint").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).toArrow()
    p, q = np.zeros(size), np.zeros(size)
    p[sums_.column("bucket").to_numpy()], q[sums_.column("bucket").to_numpy()] = sums_.column("p").to_numpy(), sums_.column("q").to_numpy()
    ratio = ratios(p, q, n[1], n[0])
    telling = ratio != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = [(f := features(t))[telling[f]].tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(found, pa.binary())], names=["id", "label", "f"])

    got = chosen.mapInArrow(run, with_fields(["id"], chosen.schema, label="int", f="binary")).toArrow().sort_by("id")
    vectors = [np.frombuffer(f.as_buffer(), np.int32) for f in got.column("f")]  # views, no copies
    return fit(vectors, got.column("label").to_numpy().astype(float), ratio, share)


def score(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "text", name: str = "score") -> DataFrame:
    """The columns of ``docs`` (one of this name gives way) and the probability of class 1."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = sent.value
        for batch in blocks(batches, column):
            z = np.clip(sums(batch.column(column).to_pylist(), weights) + intercept, -30, 30)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(1 / (1 + np.exp(-z)))], names=[*kept, name])
        release()

    return docs.mapInArrow(run, with_fields(kept, docs.schema, **{name: "double"}))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are."""
    name = "score_of_toxicity"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return score(docs, train(docs, labels, sample), name=name).where(F.col(name) < THRESHOLD).drop(name)
