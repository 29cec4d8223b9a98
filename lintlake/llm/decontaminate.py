"""Benchmark decontamination: windows of benchmark words looked up from every training window.

Native: DataFrame functions only.  Texts become words (A-Z lower-cased; a word is a run of
digits, lower-case letters and non-ASCII characters).  The benchmark becomes a table of
its word windows keyed by hash.  Every training window is hashed where its text is read
and probes that table; each hit is verified word by word, so hash collisions do no harm.
The table is broadcast while its measured size is under ``BROADCAST_BYTES``; beyond it the same
join runs as a shuffle of window hashes, and the hits are verified after a join back.

Training texts are not shuffled: only hits, and one small row per document, meet in the
aggregation.  A passage that a third of all documents share gives each of them its own rows
(partly aggregated before the shuffle).

Defined cases: null, empty and wordless texts have no words and no hits; an item of fewer
words than a window is one window; an item without words has none; repeated items and
repeated rows keep their own rows; null item ids are not counted as items, their windows
still hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, numbered, restored, stored, written

WINDOW = 10
BROADCAST_BYTES = 64 * 1024 * 1024
# fixed value: what is not part of a word, once A-Z are lower-cased
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text in order; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN)
    return F.filter(parts, lambda w: w != "")  # at most the first and the last are empty


def _key(hashes: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(hashes, at + i) for i in range(width)])


def benchmark_windows(items: DataFrame, window: int = WINDOW, column: str = "text", key: str = "item_id") -> DataFrame:
    """``key64, width, gram, item_id``: the distinct windows of each item."""
    cut = items.select(F.col(key).alias("item_id"), words_of(F.col(column)).alias("words")).where("size(words) > 0")
    cut = cut.withColumn("width", F.least(F.size("words"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1))
    grams = cut.select("item_id", "width", "words", at.alias("at")).select(
        "item_id", "width", F.slice("words", F.col("at"), F.col("width")).alias("gram")).distinct()
    hashes = F.transform("gram", lambda w: F.xxhash64(w))
    by_width = F.coalesce(*[F.when(F.col("width") == n, _key(F.col("hashes"), F.lit(0), n)) for n in range(1, window + 1)])
    return grams.withColumn("hashes", hashes).select(by_width.alias("key64"), "width", "gram", "item_id")


def _covered(spans: Column) -> Column:
    """Positions inside any of the (start, width) spans."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(
        F.array_sort(spans), zero,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["at"] + s["width"] - F.greatest(acc["end"], s["at"]))).alias("n"),
            F.greatest(acc["end"], s["at"] + s["width"]).alias("end")),
        lambda acc: acc["n"])


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, column: str = "text", carry: tuple[str, ...] = ("doc_id",),
         broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: the carried columns, ``n_words``, ``spans`` (start and width in words of every hit), ``n_hit`` and ``items`` (ids, sorted as strings)."""
    bench = stored(benchmark_windows(items, window))
    size = bench.agg(F.collect_set("width").alias("widths"), F.sum(F.octet_length(F.array_join("gram", " ")) + 64).alias("bytes")).first()
    small = (size["bytes"] or 0) <= broadcast_bytes
    carried = [f"c{i}" for i in range(len(carry))]
    texts = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carry, carried)), F.col(f"`{column}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    if not small:
        texts = written(texts)  # the row numbers are joined on below
    rows = texts.select("row", *carried, words_of(F.col("text")).alias("words")).select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))

    # The windows of each width (items shorter than a window have their own), and a row at -1 that stands for the document.
    # The words go along only as far as the probe's filter: both are one pass over a document's windows.
    widths = sorted(size["widths"], reverse=True) or [window]
    head = F.col("at") < 0
    same = F.slice("words", F.col("at") + 1, F.col("width")) == F.col("gram")
    probe = bench.select(F.col("key64").alias("k"), "gram", "item_id")
    kept = ["row", *carried, "at", "width", "size", "item_id"]
    parts = []
    for i, width in enumerate(widths):
        last = F.size("words") - width
        lead = i == 0 and small
        at = F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), last))) if lead else F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)))
        spread = rows.select("row", *carried, "words", "hashes", at.alias("at")).select(
            "row", *carried, "words", "at", F.lit(width).alias("width"), F.when(F.col("at") >= 0, _key(F.col("hashes"), F.col("at"), width)).alias("key64"))
        if small:
            hits = spread.join(F.broadcast(probe), F.col("key64") == F.col("k"), "left" if lead else "inner").where(head | same)
            parts.append(hits.withColumn("size", F.when(head, F.size("words"))).select(*kept))
        else:  # only hashes and places are shuffled; the words come back by a join on the row
            found = spread.select("row", "at", "width", "key64").join(probe, F.col("key64") == F.col("k")).select("row", "at", "width", "gram", "item_id")
            parts.append(rows.select("row", *carried, "words").join(found, "row").where(same).withColumn("size", F.lit(None).cast("int")).select(*kept))
    if not small:
        parts.append(rows.select("row", *carried, F.lit(-1).alias("at"), F.lit(0).alias("width"), F.size("words").alias("size"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    per = hits.select(
        "row", *carried, "size", F.when(~head, F.struct("at", "width")).alias("span"), F.when(~head, F.col("item_id")).alias("item"),
    ).groupBy("row", *carried).agg(F.max("size").cast("bigint").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("item").alias("found"))
    return per.select(
        *(F.col(n).alias(c) for c, n in zip(carry, carried)), "n_words", F.array_sort("spans").alias("spans"),
        _covered(F.col("spans")).alias("n_hit"), F.array_sort(F.transform("found", lambda x: x.cast("string"))).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    return scan(docs, items, window).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove(docs: DataFrame, items: DataFrame, window: int = WINDOW, spans: bool = False, column: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents without those that hold a benchmark window; with ``spans`` all documents, the hit words cut out.

    Cutting also takes what stands between two hit words that are neighbours, and nothing else.
    """
    columns = docs.columns
    table = written(numbered(docs))
    text = f"c{columns.index(column)}"
    hit = stored(scan(table, items, window, text, ("row",), broadcast_bytes).where("n_hit > 0").select(F.col("row").alias("at_row"), "spans"))
    on = F.col("row") == F.col("at_row")
    few = hit.count() * 64 <= broadcast_bytes
    if not spans:
        rows = hit.select("at_row")
        return restored(table.join(F.broadcast(rows) if few else rows, on, "left_anti"), columns)
    joined = table.join(hit, on, "left")
    # Words and what is between them in turn; word k is piece 2k, or 2k + 1 if the text does not begin with a word.
    pieces = F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    lead = F.when(F.col(text).rlike(r"^[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(0)).otherwise(F.lit(1))
    words = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["width"] - 1))))
    cut = joined.withColumns({"pieces": pieces, "lead": lead, "gone": words})
    left = F.filter("pieces", lambda p, i: ~F.when(
        (i - F.col("lead")) % 2 == 0, F.array_contains("gone", ((i - F.col("lead")) / 2).cast("int"))
    ).otherwise(F.array_contains("gone", F.floor((i - 1 - F.col("lead")) / 2).cast("int")) & F.array_contains("gone", F.floor((i + 1 - F.col("lead")) / 2).cast("int"))))
    return restored(cut.withColumn(text, F.when(F.col("spans").isNull(), F.col(text)).otherwise(F.array_join(left, ""))), columns)
