"""Connected components of a link table, by stars that shrink in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _turn(links: DataFrame, both: bool) -> DataFrame:
    """One turn: every node hands the least node it knows to its larger neighbours (``both``) or to its smaller ones and itself."""
    known = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = known.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # A node of many links is a skewed key of this join, which Spark splits at run time.
    joined = known.join(least, "a")
    if both:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes that have links ``a, b`` (longs, a <> b): the root is the least node of the component.

    Nothing is collected but a count and a checksum per turn; each turn is written to the
    checkpoint folder, so a lost executor repeats one turn at most.  The number of turns
    grows with the logarithm of the component size.
    """
    now = stored(links.distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = mark
        now = stored(_turn(_turn(now, True), False))
