"""SimHash near-duplicates, found through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments.  Of two fingerprints that differ in four
bits or fewer, some segment differs in one bit at most, so both have a variant of that
segment in common in which one bit is wild.  Every distinct fingerprint is indexed under
its 64 one-wildcard variants, equal variants meet in one shuffle, and every meeting is
verified on all 64 bits.

Equal fingerprints become one before the index.  A pair is reported under its first common
variant only, and a variant that many fingerprints share yields a spanning forest of its
verified links instead of all of them, which leaves the components as they are: rows grow
with the fingerprints, not with the pairs.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero, and
link like any other; fewer words than a shingle are one shingle; repeated rows and repeated
or null ids keep their rows; a component of null ids alone has a null component id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, numbered, restored, stored, text_bytes, with_fields, written
from .graph import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
PART = 65_536
"""Shingles counted at once, so that a very long text needs no more memory."""
CROWD = 64
"""More fingerprints under one variant are linked by a spanning forest."""


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text, unsigned."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        to = min(n, at + PART)
        pieces = [joined[s:e] for s, e in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())]
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, to - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, column: str = "text", name: str = "fp", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (the text only if asked) and the fingerprint as a signed long."""
    kept = [c for c in docs.columns if (keep_text or c != column) and c.lower() != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, column):
            data, offsets = text_bytes(batch.column(column))
            raw, cuts = data.tobytes(), offsets.tolist()
            fps = np.array([fingerprint(raw[a:b]) for a, b in zip(cuts, cuts[1:])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(fps)], names=[*kept, name])

    return docs.select(*dict.fromkeys([*kept, column])).mapInArrow(run, with_fields(kept, docs.schema, **{name: "bigint"}))


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Start and width of the fewest segments of which one differs in one bit at most."""
    n = distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fp: Column, distance: int = DISTANCE) -> Column:
    """All one-wildcard variants of the segments, each a number that also tells segment and wild bit."""
    out = []
    for start, width in segments(distance):
        part = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))
        for j in range(width):
            # at most 64 bits of place, then the segment without bit j
            out.append(F.shiftleft(F.lit(start + j).cast("long"), 56).bitwiseOR(part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << j)))))
    return F.array(*out)


def first_variant(differing: np.ndarray, distance: int) -> np.ndarray:
    """For pairs by their differing bits: the place (segment start plus wild bit) of the first variant they share."""
    place = np.full(differing.shape, -1, np.int64)
    for start, width in segments(distance):
        part = (differing >> np.uint64(start)) & np.uint64((1 << width) - 1)
        bits = np.bitwise_count(part)
        low = np.where(bits == 1, np.bitwise_count(part - np.uint64(1) & ~part), 0)
        place = np.where((place < 0) & (bits <= 1), start + low.astype(np.int64), place)
    return place


def _links(keys: np.ndarray, fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links within runs of equal keys."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(heads, len(keys)))
    small = np.repeat(sizes <= CROWD, sizes)
    few_keys, few = keys[small], fps[small]
    for d in range(1, CROWD):
        at = np.flatnonzero(few_keys[d:] == few_keys[:-d])
        if not len(at):
            break
        diff = few[at] ^ few[at + d]
        ok = np.bitwise_count(diff) <= distance
        at, diff = at[ok], diff[ok]
        own = first_variant(diff, distance) == few_keys[at].view(np.uint64) >> np.uint64(56)
        yield few[at[own]], few[at[own] + d]
    for k in np.flatnonzero(sizes > CROWD):
        group = fps[heads[k] : heads[k] + sizes[k]]
        place = int(keys[heads[k]].view(np.uint64) >> np.uint64(56))
        label = np.arange(len(group))
        for i in range(len(group) - 1):
            diff = group[i + 1 :] ^ group[i]
            near = np.flatnonzero(np.bitwise_count(diff) <= distance)
            near = near[first_variant(diff[near], distance) == place] + i + 1
            new, where = np.unique(label[near], return_index=True)
            fresh = new != label[i]
            if fresh.any():
                other = near[where[fresh]]
                label[np.isin(label, new[fresh])] = label[i]
                yield np.full(len(other), group[i]), group[other]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` (a < b) between the distinct fingerprints ``fp`` that differ in ``distance`` bits or fewer; enough to join every component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys, values):
            pairs = list(_links(keys, values.view(np.uint64), distance))
            if pairs:
                x, y = (np.concatenate(z).view(np.int64) for z in zip(*pairs))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([held_keys, batch.column("key").to_numpy()])
            values = np.concatenate([held, batch.column("fp").to_numpy()])
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            held_keys, held = keys[cut:], values[cut:]
            if cut:
                yield from found(keys[:cut], values[:cut])
        if len(held):
            yield from found(held_keys, held)

    index = fps.select("fp", F.explode(variants(F.col("fp"), distance)).alias("key"))
    return index.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, column: str = "text", key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """``key, fp, component_id`` of every row: the component id is the least key reachable over links."""
    rows = stored(with_fingerprints(docs.select(key, column), column))
    return with_components(rows, key, distance).drop("root")


def with_components(rows: DataFrame, key: str, distance: int = DISTANCE) -> DataFrame:
    """The ``rows`` (with ``fp``), ``component_id``, and ``root``, a fingerprint that stands for the component."""
    distinct = stored(rows.groupBy("fp").agg(F.min(key).alias("first")))
    member = components(links(distinct, distance)).select(F.col("node").alias("fp"), "root")
    placed = distinct.join(member, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp", "left")


def deduplicate(docs: DataFrame, column: str = "text", key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """One row of each component, all columns kept: the one with the least key (of equal or null keys: any one)."""
    columns = docs.columns
    text, ident = f"c{columns.index(column)}", f"c{columns.index(key)}"
    table = written(with_fingerprints(numbered(docs), text, keep_text=True))
    rows = with_components(stored(table.select("row", ident, "fp")), ident, distance)
    # A component may hold a third of all rows: the least row of each is found by partial minima.
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col(ident).isNull().alias("n"), F.col(ident).alias("k"), "row")).alias("x"))
    return restored(table.join(keep.select(F.col("x.row").alias("row")), "row", "left_semi"), columns)
