"""Spelling variants, found through an index of variable-length grams.

Words are near if they differ by exactly one inserted, deleted or replaced code point.  The
gram dictionary is pruned by frequency: from every place of a word a gram of ``LEAST`` code
points is taken, and made longer for as long as it is frequent (``frequent`` holds those
grams; each length has fewer than ``DICTIONARY`` of them, which bounds the broadcast).  So
common pieces are told apart by what follows them, and rare ones stay short.

How far a gram reaches depends on the code points inside it alone (or on the end of the
word), so an edit affects only the grams that hold its place.  The most grams that hold one
place is the word's bound on affected grams: two near words have all other grams in common,
at the same place or, after an insertion, one further on.  Hence, of the bound + 1 rarest
grams of each, both have one in common at such a place, whatever the edit was.  Words are
listed under these grams, by length class (words of ``c`` and of ``c + 1`` code points, with
grams of at most half of ``c``), gram and place; lists are merged, and every pair of a list is
verified.

A long list is cut into blocks, and pairs of blocks are tasks of their own.  What is verified
is one row per pair; no list, word or group is ever held whole beyond a block.

Defined cases: null words are left out, repeated words are one with the sum of their
numbers; the empty word is near the words of one code point; a word without near words has
no form and is its own root; of equally frequent near words the least in code-point order
is the form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, blocks, stored, text_bytes, written

LEAST, MOST = 3, 6
"""Code points of the shortest and the longest grams."""
DICTIONARY = 40_000
"""A gram is frequent if its share of all places exceeds one in so many."""
BLOCK = 2_000
"""Words of a list that are compared at once; longer lists are cut into blocks."""
PAIRS = 1 << 20
"""Pairs of a list weighed at once."""
BROADCAST_ROWS = 200_000
"""Long lists whose sizes are broadcast; where there are more, they are joined by a shuffle."""
TASK = 20_000
"""Words that a task takes apart."""
TIMES = 10
"""How many times a word's count its form must have."""

BASE, PRIME = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * PRIME
    return h ^ (h >> np.uint64(29))


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column, and where its words start (and the last one ends)."""
    data, cuts = text_bytes(words)
    begins = (data & 0xC0) != 0x80
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes, np.concatenate([[0], np.cumsum(begins)])[cuts]


def _hashes(codes: np.ndarray, q: int, before: np.ndarray | None) -> np.ndarray:
    """Hashes of the ``q`` code points from each place, from those of one less; what crosses the end is of no use."""
    ahead = np.zeros(len(codes), np.uint64)
    ahead[: len(codes) - q + 1] = codes[q - 1 :]
    return _mix((np.uint64(q) if before is None else before) * BASE + ahead + np.uint64(1))


def limits(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shortest and longest grams of length classes: no edit can affect all grams of a word."""
    most = np.minimum((lengths - 1) // 2, MOST)
    return np.minimum(most, LEAST), most


def gram_counts(words: DataFrame) -> DataFrame:
    """``gram, n``: how often each gram that could be made longer occurs in the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "word"):
            codes, cuts = _codes(batch.column("word"))
            left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(codes))
            h = None
            for q in range(1, MOST):
                h = _hashes(codes, q, h)
                if q >= LEAST:
                    grams, n = np.unique(h[left >= q], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return words.select("word").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, dictionary: int = DICTIONARY) -> tuple[np.ndarray, np.ndarray]:
    """The frequent grams, ascending, and their counts: fewer than ``dictionary`` for each length."""
    places = words.agg(F.sum(F.greatest(F.char_length("word") - LEAST + 1, F.lit(0)))).first()[0] or 0
    rows = gram_counts(words).where(F.col("n") > max(1, places // dictionary)).toArrow()
    grams, n = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def decompose(codes: np.ndarray, cuts: np.ndarray, classes: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The bound + 1 rarest grams of every word: word, place in it, hash; and the bounds.

    ``classes`` are the length classes under which the words are taken apart.
    """
    sizes = np.diff(cuts)
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - np.repeat(cuts[:-1], sizes)
    left = np.repeat(cuts[1:], sizes) - np.arange(len(codes))
    least, most = (x[word] for x in limits(classes))
    reach, value = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.uint64)
    often = np.zeros(len(codes), np.int64)
    h = None
    for q in range(1, MOST + 1):
        h = _hashes(codes, q, h)
        grown = (reach == q - 1) & (often > 0) & (q > least)  # frequent, so it may become longer
        take = (left >= q) & (q <= most) & ((q == least) | grown)
        reach[take], value[take] = q, h[take]
        if LEAST <= q < MOST and len(grams):
            at = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
            often = np.where(take, np.where(grams[at] == h, counts[at], 0), often)
    at = np.flatnonzero(reach)
    edges = np.bincount(at, minlength=len(codes) + 1) - np.bincount(at + reach[at], minlength=len(codes) + 1)
    cover = np.cumsum(edges)[:-1]
    bound = np.zeros(len(sizes), np.int64)
    some = sizes > 0
    if some.any():
        bound[some] = np.maximum.reduceat(cover, cuts[:-1][some])
    # by word, rarity (powers of two) and gram; of equal grams the first place comes first
    order = np.lexsort((value[at], word[at] * 64 + np.ceil(np.log2(often[at] + 1)).astype(np.int64)))
    at = at[order]
    first = np.searchsorted(word[at], np.arange(len(sizes)))
    kept = at[np.arange(len(at)) - first[word[at]] <= bound[word[at]]]
    return word[kept], place[kept], value[kept], bound


def _key(classes: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    tag = (classes.astype(np.uint64) << np.uint64(32)) + (place.astype(np.int64) + 2).astype(np.uint64)
    return _mix(value ^ _mix(tag * BASE + np.uint64(1))).view(np.int64)


def listed(words: pa.Array, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry of the lists: the word's index, the list's key, and whether the word is the longer kind of its class."""
    codes, cuts = _codes(words)
    sizes = np.diff(cuts)
    out = []
    for longer in (False, True):
        classes = sizes - longer
        word, place, value, _ = decompose(codes, cuts, classes, grams, counts)
        # Words too short for grams are all of a list by class.
        short = np.flatnonzero((limits(classes)[1] < 1) & (classes >= 0))
        for step in (0, 1)[: 1 + longer]:  # behind an insertion, grams are one place further on
            out.append((word, _key(classes[word], place - step, value), longer))
        out.append((short, _key(classes[short], np.full(len(short), -2), np.zeros(len(short), np.uint64)), longer))
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([np.full(len(x[0]), x[2]) for x in out]))


def near(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _signs(words: pa.Array, longer: np.ndarray) -> np.ndarray:
    """Sets of 64 bits of the code points that occur, and of code points with their places, and hashes of the first and of the last half, as the length class cuts it."""
    codes, cuts = _codes(words)
    sizes = np.diff(cuts)
    classes = sizes - longer
    half = classes // 2
    place = np.arange(len(codes)) - np.repeat(cuts[:-1], sizes)
    back = place - np.repeat(longer, sizes)
    folded = [np.uint64(1) << (_mix(x) >> np.uint64(58)) for x in (codes, codes * BASE + place.astype(np.uint64))]
    for at, inside in ((place, place < np.repeat(half, sizes)), (back, back >= np.repeat(half, sizes))):
        folded.append(np.where(inside, _mix(codes * BASE + at.astype(np.uint64)), np.uint64(0)))
    some = sizes > 0
    out = np.zeros((4, len(sizes)), np.uint64)
    if some.any():
        for row, values, fold in zip(out, folded, (np.bitwise_or, np.bitwise_or, np.add, np.add)):
            row[some] = fold.reduceat(values, cuts[:-1][some])
    return out


def _verified(words: pa.Array, longer: np.ndarray, first: np.ndarray, last: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near pairs among rows ``rows[i]`` and each of ``first[i] .. last[i] - 1``."""
    letters, places, head, tail = _signs(words, longer)
    many = np.maximum(last - first, 0)
    ends = np.cumsum(many)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - many[at] + PAIRS, side="right")))
        n = many[at:to]
        x = np.repeat(rows[at:to], n)
        y = np.arange(len(x)) + np.repeat(first[at:to] - (np.cumsum(n) - n), n)
        # One edit changes two of the bits at most, and one if it inserts; it leaves one half as it is, and places if it replaces.
        ok = np.flatnonzero(np.bitwise_count(letters[x] ^ letters[y]) <= 2)
        x, y = x[ok], y[ok]
        same = longer[x] == longer[y]
        ok = ((head[x] == head[y]) | (tail[x] == tail[y])) & (np.bitwise_count(places[x] ^ places[y]) <= np.where(same, 2, 64))
        ok &= same | (np.bitwise_count(letters[x] ^ letters[y]) <= 1)
        x, y = x[ok], y[ok]
        told = np.fromiter(map(near, words.take(pa.array(x)).to_pylist(), words.take(pa.array(y)).to_pylist()), bool, len(x))
        yield x[told], y[told]
        at = to


def near_pairs(words: DataFrame, grams: np.ndarray, counts: np.ndarray, block: int = BLOCK) -> DataFrame:
    """``a, b, na, nb``: every pair of near words once, with their numbers; ``words`` (word, n) are distinct and stored."""
    spark = words.sparkSession
    sent = spark.sparkContext.broadcast((grams, counts))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "word", 1 << 20):
            word, key, longer = listed(batch.column("word"), *sent.value)
            taken = batch.take(pa.array(word))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(longer), taken.column("word"), taken.column("n")], names=["key", "longer", "word", "n"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "word", 1 << 20):
            key, n = np.unique(listed(batch.column("word"), *sent.value)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    words = words.repartition(words.count() // TASK + 1).select("word", "n")
    entries = words.mapInArrow(index, "key bigint, longer boolean, word string, n bigint")
    long = words.mapInArrow(sizes, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("size")).where(F.col("size") > block)
    long = stored(long.select("key", F.ceil(F.col("size") / block).cast("int").alias("parts")))
    few = long.count() <= BROADCAST_ROWS
    cut = entries.join(F.broadcast(long) if few else long, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    # Cell (i, j) compares the words of block i with those of block j; a word of a cut list goes to all cells of its row and column.
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
    as_row = F.transform(others, lambda j: cell(F.col("own"), j, F.lit(0)))
    as_column = F.transform(others, lambda i: cell(i, F.col("own"), F.col("kind")))
    cells = (F.when(F.col("parts") == 1, F.array(cell(F.lit(0), F.lit(0), F.when(F.col("longer"), 2).otherwise(0))))
             .when(F.col("longer"), as_column).otherwise(F.concat(as_row, F.filter(as_column, lambda c: c["i"] < F.col("own")))))
    # role 0 meets what comes after it in its cell: words of its own length (1) and longer ones (2)
    dealt = cut.withColumn("own", own).withColumn("kind", F.when(F.col("longer"), 2).otherwise(1)).select("key", F.explode(cells).alias("c"), "word", "n").select("key", "c.i", "c.j", "c.role", "word", "n")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            key, i, j, role = (table.column(c).to_numpy() for c in ("key", "i", "j", "role"))
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            ends = np.append(edge[1:], len(key))
            cell = np.repeat(np.arange(len(edge)), ends - edge)
            shorter = np.concatenate([[0], np.cumsum(role == 0)])
            border = edge + shorter[ends] - shorter[edge]  # rows of role 0 come first
            rows = np.flatnonzero(role == 0)
            first = np.where(i[rows] == j[rows], rows + 1, border[cell[rows]])
            words = table.column("word").chunk(0) if table.num_rows else pa.array([], pa.string())
            n = table.column("n").to_numpy()
            for x, y in _verified(words, (role == 2).astype(np.int64), first, ends[cell[rows]], rows):
                a, b = words.take(pa.array(x)), words.take(pa.array(y))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(n[x]), pa.array(n[y])], names=["a", "b", "na", "nb"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in ("key", "i", "j")]
            same = np.logical_and.reduce([batch.column(c).to_numpy() == v for c, v in zip(("key", "i", "j"), last)])
            cut = int(np.argmax(same))  # the last cell may go on in the next batch
            if cut:
                yield from told(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and [held[-1].column(c)[0].as_py() for c in ("key", "i", "j")] != last:
                yield from told(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from told(pa.Table.from_batches(held))

    met = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role").mapInArrow(meet, "a string, b string, na bigint, nb bigint")
    return met.select(*(F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na")))).distinct()


def variants(words: DataFrame, times: int = TIMES, dictionary: int = DICTIONARY, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every distinct word of ``words`` (word, n).

    The form is the near word of largest n, if that is at least ``times`` (2 or more) the word's own;
    the root is where forms lead in the end.
    """
    table = written(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")))
    pairs = near_pairs(table, *frequent_grams(table, dictionary), block)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m")),
                             F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m"))))
    told = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(
        F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("w"))).alias("best"))
    fits = -F.col("best.m") >= F.lit(times) * F.col("n")
    told = stored(told.select("word", "n_near", F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    # Counts grow by ``times`` with every step, so the steps to a root are few, and doubling them fewer.
    roots = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        roots = stored(roots.join(step, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    out = table.join(told, "word", "left").join(roots.drop("moved"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


def runs_of_letters(docs: DataFrame, least: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key, run``: every occurrence of a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) of at least ``least`` code points, A-Z lower-cased."""
    runs = F.regexp_extract_all(F.col(column), F.lit("[A-Za-zÀ-ÿ]{%d,}" % least), F.lit(0))
    return docs.select(F.col(key).alias("key"), F.explode(runs).alias("run")).select("key", ascii_lower(F.col("run")).alias("run"))


def with_typos(runs: DataFrame, one_in: int) -> DataFrame:
    """``word``: the runs; where ``one_in`` divides the CRC-32 of ``key:run``, without the code point at the remainder by its length."""
    h = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    cut = runs.select("run", h.alias("h")).withColumn("at", (F.col("h") % F.char_length("run")).cast("int"))
    less = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    return cut.select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("word"))
