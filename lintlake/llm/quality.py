"""Quality: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of the whole text.  The text is cut into chunks of
512 bytes that overlap by half; each filter's largest answer in a chunk is pooled, a small
dense layer turns the pooled answers into the chunk's logit, and a logistic layer combines
the mean, least and largest logit of all chunks into one probability.

A filter over bytes is a table (place, byte) of answers that are added up, so a block is
scored by table look-ups.  Fitting uses at most ``SAMPLE`` labelled rows of each class (one
row of each id, however often it is repeated).  Every gradient step draws its ``BATCH``
texts, classes balanced, and of each a chunk out of all chunks of the whole text; tasks cut
out what was drawn, so the driver holds ``STEPS * BATCH`` chunks at most.  The last layer is
fitted to the whole texts of these rows, scored by tasks.  Scores depend on the text alone.

Defined cases: null and empty texts are one chunk without answers; without labels of both
classes every score is the share of class 1; repeated rows get equal scores; very long
texts are scored whole, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_bytes, with_fields
from .labelled import held_out, prior, training_rows

SAMPLE = 1_500
"""Labelled rows of each class that the network is fitted to, at most."""
HALF = 256
WIDTH, FILTERS, HIDDEN = 6, 32, 16
PIECE = 1 << 15
PARTS, PART = 5, 0
THRESHOLD = 0.3
STEPS, BATCH, RATE = 500, 192, 0.01


@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    mean: np.ndarray  # scaling, weights and intercept of the last layer
    scale: np.ndarray
    last: np.ndarray
    intercept: float

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of every filter in every chunk and how much of the chunk is filled, and where each text's chunks start."""
        lengths = np.diff(offsets)
        halves = np.maximum(1, -(-lengths // HALF))
        heads = np.concatenate([[0], np.cumsum(halves)])
        padded = np.zeros(heads[-1] * HALF + WIDTH, np.uint8)
        inside = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
        place = np.repeat(heads[:-1] * HALF, lengths) + inside
        padded[place] = data
        # An answer counts if the filter lies in its text.
        counts = np.zeros(len(padded), bool)
        counts[place] = inside + WIDTH <= np.repeat(lengths, lengths)
        best = np.zeros((heads[-1], FILTERS), np.float32)
        for at in range(0, heads[-1] * HALF, PIECE):
            to = min(at + PIECE, heads[-1] * HALF)
            answer = self.table[0][padded[at:to]]
            for k in range(1, WIDTH):
                answer += self.table[k][padded[at + k : to + k]]
            answer += self.bias
            answer *= counts[at:to, None]
            best[at // HALF : to // HALF] = answer.reshape(-1, HALF, FILTERS).max(axis=1)
        np.maximum(best, 0, out=best)
        # A chunk is a half and the next one of the same text; a text of one half is one chunk.
        starts = np.concatenate([[0], np.cumsum(np.maximum(1, halves - 1))])
        first = np.repeat(heads[:-1], np.diff(starts)) + np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))
        second = np.minimum(first + 1, np.repeat(heads[1:] - 1, np.diff(starts)))
        full = np.maximum(0, np.minimum(np.repeat(lengths, np.diff(starts)) - (first - np.repeat(heads[:-1], np.diff(starts))) * HALF, 2 * HALF) - WIDTH + 1)
        return np.column_stack([np.maximum(best[first], best[second]), (full / (2 * HALF)).astype(np.float32)]), starts

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def summary(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean, least and largest chunk logit of every text."""
        pooled, starts = self.pooled(data, offsets)
        z = np.clip(self.logits(pooled), -20, 20)
        n = np.diff(starts)
        return np.stack([np.add.reduceat(z, starts[:-1]) / n, np.minimum.reduceat(z, starts[:-1]), np.maximum.reduceat(z, starts[:-1])], axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = (self.summary(data, offsets) - self.mean) / self.scale @ self.last + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chunks_of(length: np.ndarray | int) -> np.ndarray | int:
    """Number of chunks of a text of so many bytes."""
    return np.maximum(1, -(-length // HALF) - 1)


def cut_chunk(text: bytes, at: int) -> bytes:
    """A chunk of a text, padded to the length of all."""
    return text[at * HALF : at * HALF + 2 * HALF].ljust(2 * HALF, b"\0")


def draws(labels: np.ndarray, counts: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """For all steps the texts, classes balanced, and of each one of its ``counts`` chunks."""
    rng = np.random.default_rng(seed)
    balance = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    text = rng.choice(len(labels), (STEPS, BATCH), p=balance / balance.sum())
    return text, (rng.random((STEPS, BATCH)) * counts[text]).astype(np.int64)


def fit_filters(chunks: np.ndarray, labels: np.ndarray, picks: np.ndarray, seed: int = 7) -> Network:
    """The network but for its last layer, by stochastic gradient steps on single chunks, those of each row of ``picks``."""
    rng = np.random.default_rng(seed)
    params = {
        "table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32),
        "w1": rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)).astype(np.float32), "b1": np.full(HIDDEN, 0.1, np.float32),
        "w2": rng.normal(0, 0.3, HIDDEN).astype(np.float32), "b2": np.zeros(1, np.float32)}
    m = {k: np.zeros_like(v) for k, v in params.items()}
    s = {k: np.zeros_like(v) for k, v in params.items()}
    filled = (chunks != 0).sum(axis=1)
    span = chunks.shape[1] - WIDTH + 1
    for step, pick in enumerate(picks, 1):
        x, y = chunks[pick], labels[pick]
        answer = params["table"][0][x[:, :span]]
        for k in range(1, WIDTH):
            answer += params["table"][k][x[:, k : k + span]]
        answer += params["bias"]
        answer *= (np.arange(span)[None, :, None] + WIDTH <= filled[pick][:, None, None])
        where = answer.argmax(axis=1)
        top = np.take_along_axis(answer, where[:, None, :], axis=1)[:, 0]
        pooled = np.column_stack([np.maximum(top, 0), np.maximum(0, filled[pick] - WIDTH + 1).astype(np.float32) / chunks.shape[1]])
        pre = pooled @ params["w1"] + params["b1"]
        hidden = np.maximum(pre, 0)
        z = hidden @ params["w2"] + params["b2"][0]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(pick)).astype(np.float32)
        dpre = np.outer(dz, params["w2"]) * (pre > 0)
        dpool = (dpre @ params["w1"].T)[:, :FILTERS] * (top > 0)
        dtable = np.zeros_like(params["table"])
        column = np.broadcast_to(np.arange(FILTERS), where.shape)
        for k in range(WIDTH):
            np.add.at(dtable[k], (np.take_along_axis(x, where + k, axis=1), column), dpool)
        grads = {"table": dtable, "bias": dpool.sum(axis=0), "w1": pooled.T @ dpre, "b1": dpre.sum(axis=0), "w2": hidden.T @ dz, "b2": np.array([dz.sum()])}
        rate = RATE * (1 - 0.9 * step / len(picks))
        for k, g in grads.items():
            g = g + 1e-4 * params[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            params[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(params["table"], params["bias"], params["w1"], params["b1"], params["w2"], float(params["b2"][0]), np.zeros(3), np.ones(3), np.zeros(3), 0.0)


def fit_last(net: Network, summary: np.ndarray, labels: np.ndarray, share: float) -> Network:
    """The last layer by Newton steps, set to the share of class 1."""
    net.mean, net.scale = summary.mean(axis=0), summary.std(axis=0) + 1e-6
    x = np.column_stack([(summary - net.mean) / net.scale, np.ones(len(summary))])
    n1, n0 = labels.sum(), (1 - labels).sum()
    weight = np.where(labels == 1, share / n1, (1 - share) / n0) * len(labels)
    w = np.zeros(4)
    ridge = np.diag([1.0, 1.0, 1.0, 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - labels)) + ridge @ w
        w -= np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, gradient)
    net.last, net.intercept = w[:3], float(w[3])
    return net


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """The network of the labelled rows that are not held out; the share of class 1 if there is one class alone."""
    chosen = training_rows(docs, labels, "quality", PARTS, PART, sample)
    ident = with_fields(["id"], chosen.schema)
    share = prior(labels, "quality", PARTS, PART)
    rows = chosen.select("id", "label", F.octet_length("text").alias("bytes")).toArrow().sort_by("id")  # at most 2 * sample
    y = rows.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return share
    text, chunk = draws(y, chunks_of(rows.column("bytes").to_numpy().astype(np.int64)))
    pairs, picks = np.unique(np.stack([text.ravel(), chunk.ravel()], axis=1), axis=0, return_inverse=True)
    ids = rows.column("id").to_pylist()
    wanted: dict = {}
    for t, c in pairs.tolist():
        wanted.setdefault(ids[t], []).append(c)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            data, offsets = text_bytes(batch.column("text"))
            raw, offs, keys = data.tobytes(), offsets.tolist(), batch.column("id").to_pylist()
            pieces = [b"".join(cut_chunk(raw[a:b], c) for c in wanted.get(k, ())) for k, a, b in zip(keys, offs, offs[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pieces, pa.binary())], names=["id", "chunks"])

    got = chosen.mapInArrow(cut, ident + ", chunks binary").toArrow().sort_by("id")  # at most STEPS * BATCH chunks
    drawn = np.frombuffer(b"".join(got.column("chunks").to_pylist()), np.uint8).reshape(-1, 2 * HALF)
    net = fit_filters(drawn, y[pairs[:, 0]], picks.reshape(text.shape))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            s = net.summary(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *(pa.array(s[:, i].astype(float)) for i in range(3))], names=["id", "label", "mean", "least", "most"])

    s = chosen.mapInArrow(summarise, ident + ", label int, mean double, least double, most double").toArrow().sort_by("id")
    return fit_last(net, np.column_stack([s.column(c).to_numpy() for c in ("mean", "least", "most")]), s.column("label").to_numpy().astype(float), share)


def score(docs: DataFrame, net: Network | float, column: str = "text", name: str = "score") -> DataFrame:
    """The columns of ``docs`` (one of this name gives way) and the probability of class 1."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in blocks(batches, column):
            p = np.full(batch.num_rows, net) if isinstance(net, float) else net.score(*text_bytes(batch.column(column)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p.astype(float))], names=[*kept, name])

    return docs.mapInArrow(run, with_fields(kept, docs.schema, **{name: "double"}))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id"), PARTS, PART).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
