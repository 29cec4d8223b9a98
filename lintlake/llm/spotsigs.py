"""Document fingerprints: SpotSigs.

A spot is a common word (an anchor); its signature is the anchor with the chain of the next
content words at a fixed distance.  A document's fingerprint is the set of its signatures,
so it follows the running text and not what surrounds it.  The beginning of a text counts
as an anchor, so that a text without common words has a signature too.

Fingerprints are compared by Jaccard similarity.  Two sets of which the smaller has fewer
than t times the members of the larger cannot reach t, so ``similar`` partitions sets by
length, only neighbouring partitions meet, and there only sets that share one of their
rarest signatures; a comparison stops once t is out of reach.  The result is exact.

The neighbour in id order is found without ordering texts in one task: ids are cut into
ranges by quantiles, each range is sorted on its own, and the first text of the next range
is sent along with it.

Defined cases: null and empty texts, and texts without words, have the empty fingerprint;
two empty ones have likeness 1, an empty and another 0; rows that repeat an id are ordered
by their text; null ids come first; a table of one row is its own next document.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, stored

CHAIN, DISTANCE = 3, 1
PIECE = 2 * 1024 * 1024
"""Bytes that are hashed at once; a longer text is handled in pieces that end between words."""
STEP = 256
"""Members compared before the rest is weighed against the least likeness."""
# common words of the four languages of the texts
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their there they this to was we were which will with you "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur ne nous on ou par pas pour que qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es ich im in ist mit nach nicht noch nur oder sich sie sind so um und von vor war was wie zu zum zur "
    "al como con del el ella en entre era es esta fue ha hay la las lo los mas me mi muy no nos o para pero por que se sin sobre son su sus un una y ya").split()

PRIME = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(1_000_003)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * PRIME
    return h ^ (h >> np.uint64(29))


KIND = np.zeros(256, bool)  # bytes of words: letters, digits and non-ASCII
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = True
LOW = np.arange(256, dtype=np.uint64)
LOW[65:91] += np.uint64(32)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in bytes (A-Z lower-cased), and where they start."""
    found, at = [], 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        if to < len(data) and KIND[data[to]]:  # up to the end of the word
            rest = np.flatnonzero(~KIND[data[to:]])
            to = to + int(rest[0]) if len(rest) else len(data)
        words, starts = _piece_hashes(data[at:to])
        found.append((words, starts + at))
        at = to
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _piece_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = KIND[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # A word's hash is the sum of its mixed bytes and places: bytes * BASE ** place, modulo 2 ** 64.
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    longest = int((ends - starts).max())
    powers = np.cumprod(np.full(longest, BASE, np.uint64)) if longest else np.ones(1, np.uint64)
    terms = np.where(inside, (LOW[data] + np.uint64(1)) * powers[np.minimum(place, longest - 1)], np.uint64(0))
    return _mix(np.add.reduceat(terms, starts)), starts


ANCHOR_HASHES = np.sort(_word_hashes(np.frombuffer(" ".join(sorted(set(ANCHORS))).encode(), np.uint8))[0])


def _signatures(data: np.ndarray, offsets: np.ndarray, chain: int, distance: int) -> list[np.ndarray]:
    """The distinct signatures of each text, ascending; texts lie in ``data`` with a byte that is no word between them."""
    words, starts = _word_hashes(data)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    anchor = ANCHOR_HASHES[np.minimum(np.searchsorted(ANCHOR_HASHES, words), len(ANCHOR_HASHES) - 1)] == words
    content = np.flatnonzero(~anchor)
    contents, content_doc = words[content], doc[content]
    before = np.cumsum(~anchor)  # content words up to and with each word
    # Spots: each anchor, and the beginning of each text that has a content word.
    first = np.flatnonzero(np.concatenate([[True], content_doc[1:] != content_doc[:-1]])) if len(content) else np.zeros(0, np.int64)
    spot_word = np.concatenate([words[anchor], np.zeros(len(first), np.uint64)])
    spot_doc = np.concatenate([doc[anchor], content_doc[first]])
    at = np.concatenate([before[anchor], first])
    sig, ok = _mix(spot_word + np.uint64(1)), np.zeros(len(at), bool)
    for k in range(chain):  # the chain ends with the text; an anchor with no content word after it is no spot
        here = at + k * distance
        inside = here < len(contents)
        here = np.minimum(here, max(len(contents) - 1, 0))
        if len(contents):
            inside &= content_doc[here] == spot_doc
            sig = _mix(sig * BASE + np.where(inside, contents[here], np.uint64(0)))
        if k == 0:
            ok = inside
    pairs = np.stack([spot_doc[ok], (sig[ok] >> np.uint64(32)).astype(np.int64)])
    order = np.lexsort((pairs[1], pairs[0]))
    pairs = pairs[:, order]
    fresh = np.ones(pairs.shape[1], bool)
    fresh[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    pairs = pairs[:, fresh]
    cuts = np.searchsorted(pairs[0], np.arange(len(offsets)))
    return [pairs[1][a:b].astype(np.uint32) for a, b in zip(cuts[:-1], cuts[1:])]


def signatures(texts: list[str], chain: int = CHAIN, distance: int = DISTANCE) -> list[np.ndarray]:
    """The distinct 32-bit signatures of each text, ascending."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
    if not raw:
        return []
    return _signatures(np.frombuffer(b" ".join([*raw, b""]), np.uint8), offsets, chain, distance)


def packed(signature: np.ndarray) -> str:
    """A fingerprint as text: the base64 form of its signatures, four bytes each, ascending."""
    return base64.b64encode(signature.astype(">u4").tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4").astype(np.uint32)


def jaccard(x: np.ndarray, y: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two ascending sets; 0 where their lengths, or the members seen so far, already keep it below ``least``."""
    if len(x) > len(y):
        x, y = y, x
    small, large = len(x), len(y)
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    if least:
        need, common = least / (1 + least) * (small + large) - 1e-6, 0
        for at in range(0, small, STEP):
            piece = x[at : at + STEP]
            common += int((y[np.minimum(np.searchsorted(y, piece), large - 1)] == piece).sum())
            if common + max(0, small - at - STEP) < need:
                return 0.0
    else:
        common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (small + large - common)


def edited(text: str, other: str) -> str:
    """``text`` with its second half (rounded down) replaced by as many first characters of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_next(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The rows in ranges of the key, sorted: ``part, copy, k, none, t`` (``none``: the key is null).

    Each range ends with a copy of the row that follows its last one: the first of the next
    range, after the last range the first of all.  The bounds are keys of the table, found
    from the keys alone; a text is shuffled once.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Quantiles are keys that occur, so each is the first key of its range; that they are approximate only sways the ranges' sizes.
    got = docs.select(F.col(key).alias("k")).agg(
        F.min("k").alias("least"), F.count("*").alias("n"), F.count("k").alias("known"),
        F.percentile_approx("k", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges)).alias("cuts")).first()
    least = got["least"] if got["known"] else 1
    bounds = sorted({*([least - 1] if got["known"] < got["n"] else []), *([least] if got["known"] else []), *(got["cuts"] or [])}) or [0]
    sent = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = sent.value
        for batch in batches:
            k = batch.column("k").to_numpy(zero_copy_only=False)
            part = np.searchsorted(heads, k, side="right") - 1
            first = pa.array(np.flatnonzero(heads[np.maximum(part, 0)] == k))
            for rows, parts, copy in ((batch, part, False), (batch.take(first), (part[first.to_numpy()] - 1) % len(heads), True)):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(parts.astype(np.int32)), pa.array(np.full(rows.num_rows, copy)), *(rows.column(c) for c in ("k", "none", "t"))], names=["part", "copy", "k", "none", "t"])

    plain = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(least - 1)).alias("k"), F.col(key).isNull().alias("none"), F.coalesce(F.col(column), F.lit("")).alias("t"))
    dealt = plain.mapInArrow(deal, "part int, copy boolean, k bigint, none boolean, t string")
    return dealt.repartition("part").sortWithinPartitions("part", "copy", "k", "t")


def fingerprints(docs: DataFrame, key: str = "doc_id", column: str = "text", chain: int = CHAIN, distance: int = DISTANCE, least: float = 0.0) -> DataFrame:
    """Fingerprint of every text and of its edited text, and the likeness to the edited and to the next text's.

    Likenesses below ``least`` are not worked out and are 0.
    """
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose next one is still to come
        for batch in blocks(batches, "t", PIECE):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "copy", "k", "none", "t"))))
            sigs = signatures([r[4] for r in rows], chain, distance)
            if held is not None:
                rows, sigs = [held[0], *rows], [held[1], *sigs]
            held = (rows[-1], sigs[-1])
            at = [i for i in range(len(rows) - 1) if not rows[i][1]]
            changed = [edited(rows[i][4], rows[i + 1][4]) for i in at]
            after = signatures(changed, chain, distance)
            if at:
                yield pa.RecordBatch.from_arrays([
                    pa.array([None if rows[i][3] else rows[i][2] for i in at], pa.int64()), pa.array([len(rows[i][4]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([packed(sigs[i]) for i in at], pa.string()), pa.array([packed(x) for x in after], pa.string()),
                    pa.array([jaccard(sigs[i], x, least) for i, x in zip(at, after)], pa.float64()),
                    pa.array([jaccard(sigs[i], sigs[i + 1], least) for i in at], pa.float64())], names=names)

    ddl = f"`{key}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, column).mapInArrow(run, ddl)


def length_bounds(longest: int, least: float) -> list[int]:
    """First lengths of the partitions: of two sets that can reach ``least``, the partitions are the same or neighbours."""
    out = [1]
    while out[-1] <= longest:
        out.append(int(out[-1] / least * (1 + 1e-12) + 1e-9) + 1)
    return out


def similar(docs: DataFrame, least: float, key: str = "doc_id", column: str = "text", chain: int = CHAIN, distance: int = DISTANCE) -> DataFrame:
    """``a, b, likeness`` of all pairs of different fingerprints with a likeness of ``least`` (above 0) or more.

    ``a`` and ``b`` are the least keys of the texts with these fingerprints (null if all are);
    empty fingerprints are like no other.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "t", PIECE):
            sigs = signatures(batch.column("t").to_pylist(), chain, distance)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([x.astype(np.int64) for x in sigs], pa.list_(pa.int64()))], names=["k", "sigs"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c) for c in ("x", "y"))
            found = [jaccard(p.values.to_numpy(), q.values.to_numpy(), least) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "likeness"])

    texts = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(column), F.lit("")).alias("t"))
    sets = texts.mapInArrow(sign, "k bigint, sigs array<bigint>").where(F.size("sigs") > 0).groupBy("sigs").agg(F.min("k").alias("k"))
    # Numbers of rows hold once the rows are written.
    sets = stored(stored(sets).select(F.monotonically_increasing_id().alias("id"), "k", "sigs", F.size("sigs").alias("n")))
    bounds = length_bounds(sets.agg(F.max("n")).first()[0] or 0, least)
    # Sets of likeness t share t of each one's members, so one of the first n - ceil(t * n) + 1 of each in any common order: the rarest first.
    members = sets.select("id", "n", F.explode("sigs").alias("sig"))
    ranked = members.join(members.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    head = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-6)).cast("int") + 1
    rare = ranked.groupBy("id", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "sig"))), F.lit(1), head).alias("rare"))
    part = F.udf(lambda n: bisect_right(bounds, n), "int")(F.col("n"))
    index = stored(rare.select("id", "n", part.alias("part"), F.explode("rare.sig").alias("sig")))
    own = index.select("part", "sig", F.col("id").alias("i"), F.col("n").alias("m"))
    near = index.withColumn("guest", F.lit(False)).unionByName(index.select("id", "n", (F.col("part") + 1).alias("part"), "sig", F.lit(True).alias("guest")))
    met = own.join(near, ["part", "sig"]).where(F.col("guest") | (F.col("i") > F.col("id"))).where(F.least("m", "n") >= F.lit(least) * F.greatest("m", "n") - F.lit(1e-6))
    pairs = met.select("i", "id").distinct()
    x, y = (sets.select(F.col("id").alias(i), F.col("k").alias(k), F.col("sigs").alias(v)) for i, k, v in (("i", "a", "x"), ("id", "b", "y")))
    told = pairs.join(x, "i").join(y, "id").select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint, likeness double")
    found, none = told.where(F.col("likeness") >= least), F.col("a").isNull() | F.col("b").isNull()
    return found.select(F.when(none, F.lit(None)).otherwise(F.least("a", "b")).alias("a"), F.greatest("a", "b").alias("b"), "likeness")  # a null key is a
