"""Shards of equal size that all have the mixture of the whole: proportional stratified interleaving.

Native: DataFrame functions only.  The rows of each source are shuffled by a seeded hash and
ranked; the rank over the source's size is the row's place in [0, 1).  Sorted by place,
the sources are interleaved in proportion everywhere, so equal cuts of the sequence have
equal mixtures: per shard and source the count is within two of the exact share.

Only small columns are ranked, never texts.  No rank is one task per source: rows are
range-partitioned, numbered inside partitions and offset by the counts before (a source
with a third of all rows spreads over many partitions).

Defined cases: null texts have size 8 and checksum 0; a null source is a source, at equal places the last one; repeated
rows, and repeated or null ids, are rows of their own; fewer rows than shards leave the
last shards empty; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import row_numbers
from .common import stored

SHARDS = 24
SEED = "lintlake"


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, source: str = "source", key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key, size, text_crc32, shard, slot`` of every row; the counts of two shards differ by one at most."""
    text = F.col(f"`{column}`")
    rows = docs.select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("row"))
    # What the order is made of is kept, so that rows of equal ids and texts are equal whichever comes first.
    dice = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    ranked = row_numbers(rows.withColumn("dice", dice), "rank", ["source"], ["dice", "crc", "size", "row"])
    ranked = stored(ranked)
    sizes = ranked.groupBy("source").agg(F.count("*").alias("n"))
    total = ranked.count()
    # Sources are few against rows, but not bounded: Spark decides by their size how to join them.
    placed = ranked.join(sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "id", "size", "crc", "dice", "row", "source", ((F.col("rank") - F.lit(0.5)) / F.col("n")).alias("place"))
    in_order = row_numbers(placed, "at", [], ["place", F.col("source").asc_nulls_last(), "dice", "crc", "size", "row"])
    # Shard k holds the places from ceil(k * total / shards) on.
    shard = F.expr(f"CAST((at - 1) * {shards} DIV {max(total, 1)} AS INT)")
    first = F.expr(f"(CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    return in_order.withColumn("shard", shard).withColumn("slot", F.col("at") - 1 - first).select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("bigint").alias("slot"), "source")
