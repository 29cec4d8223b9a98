"""Near copies at a least likeness: wide SimHash fingerprints, deletion variants, likeness of shingles.

Texts of five-word shingles with a likeness (Jaccard) of 0.8 differ in about 15 of 100 bits
of a SimHash, too many for 64 bits in few segments.  So fingerprints here have 128 bits in
eight segments: one of them differs in one bit at most for 93 of 100 such pairs, and for more
the more they are alike.  Fingerprints are indexed under the one-wildcard variants of their
segments, equal variants meet in one shuffle, pairs within ``REACH`` bits are candidates;
sizes and sketches of the shingle sets rule out most that are no links (of all pairs of a dense
group already in the task that compares their fingerprints), and what is left is a link if the likeness of the whole shingle sets is ``least`` or more.

Equal word sequences are one node before the index.  Where many nodes of a variant are near
one another, the candidates are a spanning forest of least distances instead of all pairs.
A forest link may fail where another would not; so the groups that hold such a forest and
fell apart are indexed again, by forests between their parts as long as these join many, and
at last by all pairs between parts.  What is left apart has no candidate that was not compared.

Defined cases: null and empty texts, and texts of white space, are copies of one another and
of nothing else; fewer words than a shingle are one shingle; repeated rows are copies;
repeated and null keys are kept apart by row; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, numbered, release, restored, stored, text_bytes, with_fields, written
from .graph import components

SHINGLE, SEED, LEAST = 5, 42, 0.8
SEGMENT, SEGMENTS = 16, 8
REACH = 32
"""Bits in which candidates differ at most; at a likeness of 0.8 they differ in 19, give or take 4."""
PART, BLOCK = 8_192, 1024 * 1024
"""Shingles hashed and bytes of text handled at once; they bound memory alone."""
CROWD = 512
"""More nodes under one variant are compared in turn, not all at once; it bounds memory alone."""
SKETCH = 16
"""Words of 64 bits of a set's sketch: which of 1,024 buckets its hashes fall into."""
MARKS = ["n", *(f"s{k}" for k in range(SKETCH))]
"""What rules out pairs before whole sets are compared: the size of a set and its sketch."""
FRUITLESS = 50
"""Forests of which at most one link in so many holds are followed by all pairs; it bounds the rounds alone."""
DENSE = 4
"""With more near pairs than this for each node, a variant gives a spanning forest."""


def hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """128-bit hashes of the distinct shingles, as two columns, in order of the first."""
    if not words:
        return np.zeros((0, 2), np.uint64)
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    parts = []
    for at in range(0, n, PART):
        to = min(n, at + PART)
        pieces = [joined[s:e] for s, e in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())]
        parts.append(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces, repeat(SEED))), np.uint64).reshape(-1, 2))
    every = np.concatenate(parts)
    return every[np.unique(every[:, 0], return_index=True)[1]]


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of shingle hashes: a bit is set if it is in over half of them."""
    counts = np.zeros(128, np.int64)
    for at in range(0, len(found), PART):
        counts += np.unpackbits(found[at : at + PART].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(found), bitorder="little").view(np.int64)


def with_fingerprints(docs: DataFrame, column: str, kept: list[str]) -> DataFrame:
    """``kept`` columns, a digest of the words (``d1, d2``) and the fingerprint (``f1, f2``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, column, BLOCK):
            data, offsets = text_bytes(batch.column(column))
            raw, cuts = data.tobytes(), offsets.tolist()
            out = np.empty((batch.num_rows, 4), np.int64)
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                words = raw[a:b].lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
                out[i, :2] = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
                out[i, 2:] = fingerprint(hashes(words))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(out[:, k]) for k in range(4))], names=[*kept, "d1", "d2", "f1", "f2"])
        release()

    return docs.select(*kept, column).mapInArrow(run, with_fields(kept, docs.schema, d1="bigint", d2="bigint", f1="bigint", f2="bigint"))


def sketch(found: np.ndarray) -> np.ndarray:
    """Which buckets a set of hashes falls into, as ``SKETCH`` words."""
    marks = np.zeros(SKETCH * 64, np.uint8)
    marks[(found.view(np.uint64) % np.uint64(SKETCH * 64)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").view(np.int64)


def with_hashes(texts: DataFrame) -> DataFrame:
    """``row, shingles, n`` (their number) and the sketch (``s0, s1, ...``) of ``row, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, most=BLOCK):
            data, offsets = text_bytes(batch.column("text"))
            raw, cuts = data.tobytes(), offsets.tolist()
            sets = [hashes(raw[a:b].lower().split())[:, 0].view(np.int64) for a, b in zip(cuts, cuts[1:])]
            marks = np.stack([sketch(x) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(sets, pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int32()), *(pa.array(marks[:, k]) for k in range(SKETCH))],
                names=["row", "shingles", "n", *(f"s{k}" for k in range(SKETCH))])
        release()

    return texts.select("row", "text").mapInArrow(run, "row bigint, shingles array<bigint>, n int, " + ", ".join(f"s{k} bigint" for k in range(SKETCH)))


def variants() -> Column:
    """All one-wildcard variants of the segments of ``f1, f2``: place of the wild bit, then the segment without it."""
    out = []
    for s in range(SEGMENTS):
        word, start = F.col("f1" if s < SEGMENTS // 2 else "f2"), s * SEGMENT % 64
        part = F.shiftrightunsigned(word, start).bitwiseAND(F.lit((1 << SEGMENT) - 1)).cast("int")
        out += [F.lit((s * SEGMENT + j) << SEGMENT).bitwiseOR(part.bitwiseAND(F.lit(((1 << SEGMENT) - 1) & ~(1 << j)))) for j in range(SEGMENT)]
    return F.array(*out)


def first_variant(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For pairs by the differing bits of both halves: the place of the first variant they share."""
    place = np.full(x.shape, -1, np.int64)
    for s in range(SEGMENTS):
        part = ((x if s < SEGMENTS // 2 else y) >> np.uint64(s * SEGMENT % 64)) & np.uint64((1 << SEGMENT) - 1)
        bits = np.bitwise_count(part)
        low = np.where(bits == 1, np.bitwise_count(part - np.uint64(1) & ~part), 0)
        place = np.where((place < 0) & (bits <= 1), s * SEGMENT + low.astype(np.int64), place)
    return place


def forest(f1: np.ndarray, f2: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of least distances over the pairs within ``REACH``; none between equal labels."""
    n = len(f1)
    distance, parent, open_ = np.full(n, 255), np.full(n, -1), np.ones(n, bool)
    out, at = [], 0
    for _ in range(n):
        open_[at] = False
        if parent[at] >= 0 and label[at] != label[parent[at]]:
            out.append((int(parent[at]), at))
        away = np.bitwise_count(f1 ^ f1[at]).astype(np.int64) + np.bitwise_count(f2 ^ f2[at])
        away[label == label[at]] = -1  # a part comes whole, before equal fingerprints of others
        nearer = open_ & (away < distance) & (away <= REACH)
        distance[nearer], parent[nearer] = away[nearer], at
        left = np.flatnonzero(open_)
        if len(left):
            at = int(left[np.argmin(distance[left])])
    return out


def _pairs(keys: np.ndarray, f1: np.ndarray, f2: np.ndarray, label: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Candidates within runs of equal keys, by place, and whether they are a forest."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(heads, len(keys)))
    run = np.repeat(np.arange(len(heads)), sizes)
    few = np.flatnonzero(np.repeat(sizes <= CROWD, sizes))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for d in range(1, CROWD):
        at = np.flatnonzero(run[few[d:]] == run[few[:-d]])
        if not len(at):
            break
        i, j = few[at], few[at + d]
        near = (np.bitwise_count(f1[i] ^ f1[j]).astype(np.int64) + np.bitwise_count(f2[i] ^ f2[j]) <= REACH) & (label[i] != label[j])
        found.append((i[near], j[near]))
    i, j = (np.concatenate(x) for x in zip(*found))
    dense = (np.bincount(run[i], minlength=len(heads)) > DENSE * sizes) & (not whole)
    sparse = ~dense[run[i]]
    i, j = i[sparse], j[sparse]
    own = first_variant(f1[i] ^ f1[j], f2[i] ^ f2[j]) == keys[i] >> SEGMENT
    yield i[own], j[own], False
    for k in np.flatnonzero(dense | (sizes > CROWD)):
        a, b = int(heads[k]), int(heads[k] + sizes[k])
        if whole:
            for i in range(a, b - 1):
                x, y = f1[i + 1 : b] ^ f1[i], f2[i + 1 : b] ^ f2[i]
                near = (np.bitwise_count(x).astype(np.int64) + np.bitwise_count(y) <= REACH) & (label[i + 1 : b] != label[i])
                j = np.flatnonzero(near)
                j = j[first_variant(x[j], y[j]) == keys[i] >> SEGMENT]
                yield np.full(len(j), i), j + i + 1, False
        else:
            links = forest(f1[a:b], f2[a:b], label[a:b])
            if links:
                i, j = np.array(links).T + a
                yield i, j, True


def may_link(n: np.ndarray, marks: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Which pairs, by place, ``possible`` keeps: ``n`` has the sizes of the sets, ``marks`` their sketches by rows."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), PART):
        a, b = i[at : at + PART], j[at : at + PART]
        x, y, na, nb = marks[a], marks[b], n[a], n[b]
        shared = np.minimum(na - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
        out[at : at + PART] = (np.minimum(na, nb) >= least * np.maximum(na, nb)) & (shared >= (least - 1e-9) * (na + nb - shared))
    return out


def candidates(nodes: DataFrame, whole: bool = False, least: float = LEAST) -> DataFrame:
    """Candidates ``a, b, crowd`` (a < b) between ``node, f1, f2`` of different ``label`` (without that column: all differ).

    ``whole``: all of them; else forests where they are dense, which are told by ``crowd``.
    Nodes with ``n, s0, s1, ...`` (of ``with_hashes``): without the pairs that these rule out for ``least``.
    """
    columns = ["node", "f1", "f2", *(["label"] if "label" in nodes.columns else []), *(MARKS if "n" in nodes.columns else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys, values):
            of = dict(zip(columns, values))
            node, f1, f2, label = of["node"], of["f1"].view(np.uint64), of["f2"].view(np.uint64), of.get("label", of["node"])
            marks = np.stack([of[c].view(np.uint64) for c in MARKS[1:]], axis=1) if "n" in of else None
            for i, j, crowd in _pairs(keys, f1, f2, label, whole):
                if marks is not None:
                    open_ = may_link(of["n"], marks, i, j, least)
                    i, j = i[open_], j[open_]
                if len(i):
                    x, y = node[i], node[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.full(len(i), crowd))], names=["a", "b", "crowd"])

        held_keys, held = np.zeros(0, np.int32), [np.zeros(0, np.int64)] * len(columns)
        for batch in batches:
            keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
            values = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, columns)]
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            held_keys, held = keys[cut:], [v[cut:] for v in values]
            if cut:
                yield from found(keys[:cut], [v[:cut] for v in values])
        if len(held_keys):
            yield from found(held_keys, held)
        release()

    index = nodes.select(*columns, F.explode(variants()).alias("key"))
    pairs = index.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint, crowd boolean")
    return written(pairs.groupBy("a", "b").agg(F.max("crowd").alias("crowd")))


def shingle_sets(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``row, shingles`` of all texts (``row, text``) in ``pairs``."""
    ends = written(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct())
    return written(with_hashes(texts.join(ends, "row", "left_semi")))


def possible(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The ``pairs`` that may have that likeness, by the sets' sizes and sketches; none that has it is left out.

    What one set has in buckets where the other has nothing is not shared, so each such
    bucket takes one from what may be.  Pairs carry sketches here and no whole sets, which
    would be many times their size.
    """
    small = lambda end: sets.select(F.col("row").alias(end), F.col("n").alias(f"n{end}"), *(F.col(f"s{k}").alias(f"{end}{k}") for k in range(SKETCH)))
    both = pairs.join(small("a"), "a").join(small("b"), "b").where(F.least("na", "nb") >= least * F.greatest("na", "nb"))

    def own(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(f"{x}{k}").bitwiseAND(F.bitwise_not(f"{y}{k}"))) for k in range(SKETCH)), F.lit(0))

    shared = F.least(F.col("na") - own("a", "b"), F.col("nb") - own("b", "a"))
    # a little less than that likeness, as products are rounded
    return written(both.where(shared >= (least - 1e-9) * (F.col("na") + F.col("nb") - shared)).select("a", "b", "crowd"))


def alike(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The ``pairs`` whose shingle sets have that likeness."""
    whole = sets.select("row", "shingles")
    both = possible(pairs, sets, least).join(whole.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(whole.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
    n, m = F.size("x"), F.size("y")
    shared = F.size(F.array_intersect("x", "y"))
    return written(both.where(F.when(n + m > 0, shared / (n + m - shared)).otherwise(1.0) >= least).select("a", "b", "crowd"))


def links(nodes: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """Links ``a, b`` between ``node, f1, f2``, enough to join every group; ``texts`` has ``row`` (the node) and ``text``."""
    pairs = candidates(nodes)
    sets = shingle_sets(pairs, texts)  # later rounds meet no node that has no candidate now
    out = alike(pairs, sets, least)
    while not pairs.where("crowd").isEmpty():
        # groups of candidates that hold a forest and fell apart
        groups = components(pairs.select("a", "b")).withColumnRenamed("root", "group")
        parts = components(out.select("a", "b")).withColumnRenamed("root", "label")
        placed = stored(groups.join(parts, "node", "left").select("node", "group", F.coalesce("label", "node").alias("label")))
        crowded = pairs.where("crowd").select(F.col("a").alias("node")).join(placed, "node").select("group").distinct()
        apart = placed.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").join(crowded, "group", "left_semi")
        # a group may hold a third of all rows: Spark splits that key, and broadcasts the few groups
        rest = stored(placed.join(apart, "group", "left_semi").select("node", "label").join(nodes, "node"))
        if rest.isEmpty():
            break
        pairs = candidates(rest)
        fresh = alike(pairs, sets, least)
        last = fresh.count() * FRUITLESS <= pairs.count()
        if last:
            # most pairs of a dense group are no links: what tells so goes along, and rules them out before they are rows
            marked = rest.join(sets.select(F.col("row").alias("node"), *MARKS), "node")
            fresh = fresh.unionByName(alike(candidates(marked, whole=True, least=least), sets, least))
        out = stored(out.unionByName(fresh).dropDuplicates(["a", "b"]))
        if last:
            break
        # parts that this round joined must be seen with the groups they were in
        pairs = written(pairs.unionByName(placed.where("node <> group").select(F.col("group").alias("a"), F.col("node").alias("b"), F.lit(False).alias("crowd"))))
    return out.select("a", "b")


def deduplicate(docs: DataFrame, column: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """One row of each group of near copies, all columns kept: the one with the least key (of equal or null keys: any one)."""
    columns = docs.columns
    text, ident = f"c{columns.index(column)}", f"c{columns.index(key)}"
    table = written(numbered(docs))
    rows = written(with_fingerprints(table, text, ["row", ident]))
    first = F.min(F.struct(F.col(ident).isNull().alias("n"), F.col(ident).alias("k"), "row"))
    nodes = stored(rows.groupBy("d1", "d2").agg(F.min("row").alias("node"), first.alias("best"), F.min("f1").alias("f1"), F.min("f2").alias("f2")))
    joined = links(nodes.select("node", "f1", "f2"), table.select("row", F.col(text).alias("text")), least)
    placed = nodes.join(components(joined), "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    keep = placed.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    # what goes is less than what stays, so it is this side that Spark may broadcast
    gone = written(rows.select("row").join(keep, "row", "left_anti"))
    return restored(table.join(gone, "row", "left_anti"), columns)
