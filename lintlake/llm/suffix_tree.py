"""Language-model scoring with a probabilistic suffix tree over the bytes of words.

A text is its words, A-Z lower-cased, each followed by a space, and an end mark; the symbols
of the tree are those bytes, so that a state can begin inside a word.  The state of a place
is a suffix of the bytes before it, of ``DEPTH`` bytes at most.  A context is a state if the
symbols that follow it diverge from those of its parent (the context without its oldest
byte): the gain in log-likelihood over the parent's distribution must reach ``GAIN``.  A
state's distribution is smoothed with its parent's in the ratio of its count to its number
of distinct symbols; a context that is no state has its parent's distribution, so a place is
scored by the longest suffix that is a state.  The root is smoothed with the uniform
distribution over bytes.

The outcomes of the model are tokens, as in the base score: the words that occur in training
texts, the end, and one outcome for all other words.  That one has the mass V / (N + V), of V
distinct among N training tokens; the rest is shared by the tree (the product over a
token's bytes, with its space) and the token's own frequency, in the ratio ``MIX``.

The tree is a table, not an object: every level is grouped from the next deeper one, and
joined with its parents.  Texts are packed once and taken in blocks of bounded size; a
block sends each distinct context with its symbol once, with the count in its training
texts, and gets its probability back, as with its distinct words and their counts.  So what is gathered grows
with the corpus, shuffles carry distinct keys of blocks instead of places, and no task,
broadcast or driver holds the tree.

Beside the score, the base score of a unigram model over words with add-one smoothing is
given: its tokens are the words and the end.

Defined cases: null and empty texts, and texts of white space, are the end alone; rows
that repeat an id keep their rows; rows without a training mark are scored only; without
any training text every token is the outcome of unknown words, of probability 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, stored, text_bytes, written

DEPTH = 5
"""Bytes of the longest contexts (6 at most)."""
GAIN = 2.0
"""Least gain in log-likelihood (nats) of a state over its parent."""
MIX = 0.5
"""Share of the tree in the probability of a known token; the rest goes by the token's own frequency."""
BLOCK = 64 * 1024 * 1024
"""Bytes of the texts of a block."""
PIECE = 1024 * 1024
"""Bytes of texts that are packed, and sorted, at once (a longer text is a piece of its own)."""
END = b"\n"


def body(text: str | None) -> bytes:
    """The symbols of a text: words, each with a space, and the end mark."""
    return b" ".join([*(text or "").encode().lower().split(), END])  # of bytes: A-Z, and the six ASCII white-space characters


def packed(docs: DataFrame, train: Column, key: str, column: str) -> DataFrame:
    """All rows, some to a piece, with their symbols compressed; written once, and read in partitions that make blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", PIECE):
            made = [body(t) for t in batch.column("text").to_pylist()]
            piece = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("train"), pa.array(made, pa.binary())], names=["key", "mark", "body"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(piece)
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, made))]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["size", "data"])

    plain = docs.select(F.col(key).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(column).alias("text"))
    table = written(plain.mapInArrow(run, "size bigint, data binary"))
    return table.coalesce((table.agg(F.sum("size")).first()[0] or 0) // BLOCK + 1)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Scalar]]:
    """The pieces of ``packed`` with the block each belongs to, which is the same whenever they are read."""
    block, held = TaskContext.get().partitionId() << 24, 0
    for batch in batches:
        for size, piece in zip(batch.column("size").to_pylist(), batch.column("data")):
            if held and held + size > BLOCK:
                block, held = block + 1, 0
            held += size
            yield block, piece


def unpacked(piece: pa.Scalar) -> pa.RecordBatch:
    """``key, mark, body`` of a piece's rows."""
    return pa.ipc.open_stream(piece.as_buffer()).read_next_batch()


def windows(data: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    """For every byte of the texts, the byte (lowest) and the ``depth`` ones before it; before a text come end marks."""
    sizes = np.diff(cuts)
    wide = np.full(len(data) + depth * len(sizes), END[0], np.uint64)
    place = np.arange(len(data)) + np.repeat(depth * (np.arange(len(sizes)) + 1), sizes)
    wide[place] = data
    out = np.zeros(len(wide), np.uint64)
    for k in range(depth + 1):
        out[k:] |= wide[: len(wide) - k] << np.uint64(8 * k)
    return out[place]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One list of distinct keys, ascending, with the sums of their numbers."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [(keys[first], np.add.reduceat(n, first))]


class Lookup:
    """Numbers by window, in an open-addressed table: many times as fast as a search in sorted windows."""

    EMPTY = np.uint64(2**64 - 1)  # no window of seven bytes or fewer

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.EMPTY, np.uint64), np.zeros(1 << bits)
        at = self.slots(keys)
        while len(keys):
            free = self.keys[at] == self.EMPTY
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys  # a repeated window has its slot too
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self.last

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots(keys)
        off = np.flatnonzero(self.keys[at] != keys)
        while len(off):
            if (self.keys[at[off]] == self.EMPTY).any():
                raise KeyError("a window of this block has no probability")
            at[off] = (at[off] + 1) & self.last
            off = off[self.keys[at[off]] != keys[off]]
        return self.values[at]


def contexts(table: DataFrame, depth: int) -> DataFrame:
    """``block, gram, n``: the distinct windows of each block, and how often they occur in its training texts (0: in others only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: int, parts: list) -> pa.RecordBatch:
            grams, n = _merged(parts)[0]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block)), pa.array(grams.view(np.int64)), pa.array(n)], names=["block", "gram", "n"])

        now, parts = None, []
        for block, piece in pieces(batches):
            if parts and block != now:
                yield told(now, parts)
                parts = []
            now = block
            rows = unpacked(piece)
            data, cuts = text_bytes(rows.column("body"))
            found = windows(data, cuts, depth)
            learn = np.repeat(rows.column("mark").to_numpy(zero_copy_only=False), np.diff(cuts))
            for mark in (True, False):
                grams, n = np.unique(found[learn == mark], return_counts=True)
                parts.append((grams, n.astype(np.int64) * mark))
            if sum(len(p[0]) for p in parts[1:]) > max(1 << 20, len(parts[0][0])):
                parts = _merged(parts)
        if parts:
            yield told(now, parts)

    return table.mapInArrow(run, "block bigint, gram bigint, n bigint")


def word_counts(table: DataFrame) -> DataFrame:
    """``block, word, n``: the distinct words of each block, the end among them, and how often they occur in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(block: int, counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counts), block)), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["block", "word", "n"])

        now, counts = None, Counter()
        for block, piece in pieces(batches):
            if counts and block != now:
                yield told(now, counts)
                counts = Counter()
            now = block
            rows = unpacked(piece)
            for text, mark in zip(rows.column("body").to_pylist(), rows.column("mark").to_pylist()):
                words = text.split()
                if mark:
                    counts.update(words)
                    counts[END] += 1
                else:
                    for w in (*words, END):
                        counts.setdefault(w, 0)
        if counts:
            yield told(now, counts)

    return table.mapInArrow(run, "block bigint, word binary, n bigint")


def _recent(gram: Column, places: int) -> Column:
    """The newest ``places`` bytes of a window."""
    return gram.bitwiseAND(F.lit((1 << 8 * places) - 1))


def tree(grams: DataFrame, depth: int = DEPTH, gain: float = GAIN) -> DataFrame:
    """``gram, p``: the probability of the last byte of every distinct window, from ``gram, n``.

    Windows of count 0 are told too.
    """
    levels = [stored(grams.groupBy("gram").agg(F.sum("n").alias("n")))]
    for k in range(depth - 1, -1, -1):
        levels.append(levels[-1].groupBy(_recent(F.col("gram"), k + 1).alias("gram")).agg(F.sum("n").alias("n")))
    told = None
    for k, level in enumerate(reversed(levels)):
        # The root has one context of all symbols; a deeper one has 256 symbols at most.
        context = F.shiftrightunsigned("gram", 8) if k else F.lit(0)
        if k:
            up = told.select(F.col("gram").alias("short"), F.col("p").alias("above"))
            rows = level.join(up, _recent(F.col("gram"), k) == F.col("short")).drop("short")
        else:
            rows = level.withColumn("above", F.lit(1 / 256))
        own = Window.partitionBy(context.alias("context"))
        seen = F.col("n") > 0
        stats = rows.withColumns({
            "total": F.sum("n").over(own), "kinds": F.sum(seen.cast("long")).over(own),
            "better": F.sum(F.when(seen, F.col("n") * (F.ln("n") - F.ln("above"))).otherwise(0.0)).over(own)})
        state = (F.col("total") > 0) & (F.lit(not k) | (F.col("better") - F.col("total") * F.ln("total") >= gain))
        smooth = (F.col("n") + F.col("kinds") * F.col("above")) / (F.col("total") + F.col("kinds"))
        told = stats.select("gram", F.when(state, smooth).otherwise(F.col("above")).alias("p"))
    return told


def score(docs: DataFrame, train: Column, key: str = "doc_id", column: str = "text", depth: int = DEPTH, gain: float = GAIN, mix: float = MIX) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of every row; ``train`` marks the rows that are learned from.

    A text's tokens are its words and the end.  ``n_known`` counts those that occur in training texts, of which there are
    ``train_tokens``; ``score`` and ``base_score`` are log10 probabilities.
    """
    table = packed(docs, train, key, column)
    sent = written(contexts(table, depth))
    probable = tree(sent.select("gram", "n"), depth, gain)
    # One shuffle by word: each block's rows keep their place beside the sum over all blocks.
    alike = Window.partitionBy("word")
    asked = written(word_counts(table).select("block", "word", F.sum("n").over(alike).alias("c"), (F.col("block") == F.min("block").over(alike)).alias("first")).where("c > 0"))
    sums = asked.where("first").agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    tokens, kinds = sums["n"] or 0, sums["v"]
    below = float(np.log10(tokens + kinds + 1))
    unknown, rest = (float(np.log10(x / (tokens + kinds))) if tokens else 0.0 for x in (kinds, tokens))

    none = F.lit(None)
    about_grams = sent.select("block", "gram").join(probable, "gram").select(
        "block", F.lit(0).alias("kind"), F.col("gram").alias("a"), F.log10("p").alias("x"), none.cast("binary").alias("w"))
    about_words = asked.select(
        "block", F.lit(1).alias("kind"), none.cast("bigint").alias("a"), F.col("c").cast("double").alias("x"), F.col("word").alias("w"))

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([piece])], names=["block", "w"])

    texts = table.mapInArrow(tagged, "block bigint, w binary").select("block", F.lit(2).alias("kind"), none.cast("bigint").alias("a"), none.cast("double").alias("x"), "w")
    rows = texts.unionByName(about_grams).unionByName(about_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, logs, known, table, now = [], [], {}, None, None
        for batch in batches:
            block, kind = (batch.column(c).to_numpy() for c in ("block", "kind"))
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(block)] if len(block) else []
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if block[a] != now:
                    grams, logs, known, table, now = [], [], {}, None, block[a]
                if kind[a] == 0:
                    grams.append(part.column("a").to_numpy())
                    logs.append(part.column("x").to_numpy())
                    continue
                if kind[a] == 1:
                    known.update(zip(part.column("w").to_pylist(), part.column("x").to_pylist()))
                    continue
                if table is None:
                    table = Lookup(np.concatenate(grams).view(np.uint64), np.concatenate(logs))
                    grams, logs = [], []
                for piece in part.column("w"):
                    piece_rows = unpacked(piece)
                    data, cuts = text_bytes(piece_rows.column("body"))
                    counts, sizes, of_end = [], [], known.get(END, 0.0)
                    for text in piece_rows.column("body").to_pylist():
                        words = text.split()
                        counts += [known.get(w, 0.0) for w in words]
                        counts.append(of_end)
                        sizes.append(len(words) + 1)
                    first = np.cumsum([0, *sizes])[:-1]  # of the tokens of each text
                    starts = np.flatnonzero((data == 32) | (data == END[0])) + 1  # of the tokens, in bytes, but for the first
                    by_tree = np.add.reduceat(table.get(windows(data, cuts, depth)), np.concatenate([[0], starts[:-1]]))
                    c = np.array(counts)
                    seen = c > 0
                    mixed = mix * 10.0 ** by_tree + (1 - mix) * c / max(tokens, 1)
                    told = np.add.reduceat(np.where(seen, np.log10(np.where(seen, mixed, 1.0)) + rest, unknown), first)
                    n, found, base = sizes, np.add.reduceat(seen.astype(np.int64), first), np.add.reduceat(np.log10(c + 1) - below, first)
                    yield pa.RecordBatch.from_arrays(
                        [piece_rows.column("key"), pa.array(n, pa.int64()), pa.array(found, pa.int64()), pa.array([tokens] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(told)],
                        names=["key", *names])

    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = docs.schema[key].dataType.simpleString()
    ddl = f"key {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    done = rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, ddl)
    return done.select(F.col("key").alias(key), *names)
