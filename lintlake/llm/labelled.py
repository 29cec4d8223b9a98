"""Labelled training rows for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text leaves this remainder (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def training_ids(labels: DataFrame, label: str, parts: int, part: int, most: int, key: str = "doc_id") -> DataFrame:
    """``id, label`` of at most ``most`` labelled rows of each class that may be learned from, chosen by a hash of the id.

    Rows without id or label are left out; of repeated ids the larger label counts.  The
    result is bounded by ``most``, so it may be broadcast.
    """
    clean = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    clean = clean.where(~held_out(F.col("id"), parts, part)).groupBy("id").agg(F.max("label").alias("label"))
    dice = F.xxhash64(F.lit("train"), F.col("id"))
    picked = [clean.where(F.col("label") == y).orderBy(dice, "id").limit(most) for y in (0, 1)]
    return picked[0].unionByName(picked[1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, most: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``id, label, text`` of the chosen rows, written once: at most ``2 * most``, whatever the table holds.

    Of documents that share an id one counts, that of the least text hash (each task keeps
    one of an id before the shuffle); a null text is an empty one.
    """
    ids = training_ids(labels, label, parts, part, most, key)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), "id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("one")
    return written(rows.groupBy("id").agg(one).select("id", "one.label", "one.text"))


def prior(labels: DataFrame, label: str, parts: int, part: int, key: str = "doc_id") -> float:
    """Share of class 1 among all labelled rows that may be learned from (one half where there are none)."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key), parts, part))
    n = rows.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("p")).first()
    return ((n["p"] or 0) + 1) / (n["n"] + 2)
