"""Periodic runs of words, by Kruskal over descending longest common prefixes.

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends.  The suffixes of a text that share a prefix of l words form a class; classes of
level l come from those of higher levels by uniting neighbours in suffix order whose
longest common prefix is l.  Taking these edges by descending prefix length, a union-find
keeps every class as an ordered set of positions and moves the smaller set into the larger.
Two positions that become adjacent at level l have exactly l words in common; if their
distance d is at most l, the stretch from the first position is l + d words long and has
smallest period d, for a smaller period would put a member of the class between them.  It
is a run if the words before the two positions differ.  Every run is seeded once, at its
first word.

A run needs l >= (exponent - 1) * d and l + d >= length, so edges below the least such l can
seed none and are not taken; a text in which no stretch of that many words occurs twice is
not sorted at all.

Defined cases: null and empty texts, and texts of white space, have no words and no runs;
rows that repeat an id keep their rows; a null id is an id like any other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, with_fields

LENGTH, EXPONENT = 6, 4
"""Least words of a run, and least repeats of its period (a whole number)."""
CHUNK = 1024
"""Positions in a piece of an ordered set, so that an insertion moves few."""

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Positions:
    """An ordered set of numbers in pieces of bounded size."""

    __slots__ = ("pieces", "firsts", "n")

    def __init__(self, first: int):
        self.pieces, self.firsts, self.n = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def add(self, x: int) -> tuple[int, int]:
        """Insert ``x``, which is not in the set; its neighbours, -1 where there is none."""
        at = max(bisect_left(self.firsts, x) - 1, 0)
        piece = self.pieces[at]
        i = bisect_left(piece, x)
        before = piece[i - 1] if i else -1
        after = piece[i] if i < len(piece) else self.firsts[at + 1] if at + 1 < len(self.firsts) else -1
        piece.insert(i, x)
        self.n += 1
        if not i:
            self.firsts[at] = x
        if len(piece) > CHUNK:
            half = len(piece) // 2
            self.pieces[at : at + 1] = [piece[:half], piece[half:]]
            self.firsts.insert(at + 1, piece[half])
        return before, after


def least_prefix(length: int, exponent: int) -> int:
    """The shortest common prefix that can seed a run: l + d >= length and l >= (exponent - 1) * d for some period d."""
    return min(max(length - d, (exponent - 1) * d) for d in range(1, max(2, length + 1)))


def _repeats(ids: np.ndarray, width: int) -> bool:
    """Whether some stretch of ``width`` words occurs twice (now and then also where two hashes are equal)."""
    n = len(ids) - width + 1
    if n < 2:
        return False
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the common prefix of each with the one before it (0 for the first), by doubled prefixes."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [], 1
    while True:
        levels.append(rank.astype(np.int32))
        if int(rank.max()) == n:
            break
        follow = np.zeros(n, np.int64)
        follow[: max(n - width, 0)] = rank[width:]
        rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    order = np.argsort(rank)
    common = np.zeros(n, np.int64)
    x, y = order[1:].copy(), order[:-1].copy()
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        inside = (x < n) & (y < n)
        same = inside & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)])
        # ranks of a level are of 2 ** k words, or of all words up to the end
        step = np.where(same, 1 << k, 0)
        common[1:] += step
        x += step
        y += step
    return order, common


def find(words: list, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``length`` words and ``exponent`` (2 or more) periods, by start, then period."""
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    floor = least_prefix(length, exponent)
    if not _repeats(ids, floor):
        return []
    order, common = suffix_order(ids)
    edges = np.flatnonzero(common >= floor)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    root: dict[int, int] = {}
    held: dict[int, Positions] = {}

    def top(x: int) -> int:
        path = []
        while (up := root.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            root[p] = x
        return x

    found = []
    more = exponent - 1
    plain = ids.tolist()
    for x, y, level in zip(order[edges].tolist(), order[edges - 1].tolist(), common[edges].tolist()):
        a, b = top(x), top(y)
        large, small = held.get(a) or Positions(a), held.get(b) or Positions(b)
        if large.n < small.n:
            a, b, large, small = b, a, small, large
        root[b] = a
        held[a] = large
        held.pop(b, None)
        last, moved = -1, list(small)
        for p, following in zip(moved, [*moved[1:], len(plain)]):
            before, after = large.add(p)
            # pairs within the smaller set were adjacent before, and what has one of its members between is not adjacent
            for i, j in ((before if before != last else -1, p), (p, after if after < following else -1)):
                if i >= 0 and j >= 0:
                    d = j - i
                    if level >= more * d and level + d >= length and (not i or plain[i - 1] != plain[j - 1]):
                        found.append((i, level + d, d))
            last = p
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]


def periodic(docs: DataFrame, column: str = "text", length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """All columns of ``docs``, and ``runs`` (ordered by start, then period) and ``collapsed`` (the words that stay, joined by one space).

    A text is one row of one task; nothing is shuffled.  Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("runs", "collapsed") or c == column]
    names = [*(f"c{i}" for i in range(len(kept))), "runs", "collapsed"]
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    text = f"c{kept.index(column)}"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            runs, left = [], []
            for t in batch.column(text).to_pylist():
                words = (t or "").encode().split()  # of bytes: the six ASCII white-space characters
                got = find(words, length, exponent)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in got])
                left.append(b" ".join(collapse(words, got)).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, kind), pa.array(left, pa.string())], names=names)

    done = plain.mapInArrow(run, with_fields(plain.columns, plain.schema, runs=RUNS, collapsed="string"))
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "runs", "collapsed")


def digests(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``runs`` and ``collapsed`` as counts, the run of greatest exponent, and digests."""
    better = lambda a, r: (r["length"] * a["period"] > a["length"] * r["period"])  # noqa: E731 - by exact exponent; runs come by start, then period
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(better(a, r), r).otherwise(a))
    parts = lambda r: (r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    listing = F.concat_ws("", F.transform("runs", lambda r: F.concat(*parts(r))))
    told = docs.select(key, F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), listing.alias("listing"), "collapsed")
    return told.select(
        key, "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("listing").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
