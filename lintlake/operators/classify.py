"""Language classification: lookups in broadcast dimensions of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, basic_extname, compound_extname, extname
from ..functions.text import utf16_len
from ..sources import dims


def classify_language(files: DataFrame, profile: str = "extended") -> DataFrame:
    """Add ``language``, ``family`` and ``comment``.

    ``extended`` takes the first hit of exact file name, compound extension and
    lower-cased last extension.  ``basic`` knows lower-cased last extensions only and
    has neither family nor comment marker.
    """
    if {"language", "family", "comment"} <= set(files.columns):
        return files  # classified before, as by the selection
    spark = files.sparkSession
    if profile == "basic":
        dim = dims.lang_basic_dim(spark).withColumnRenamed("name", "_n").withColumnRenamed("key", "_k")
        return (
            files.join(F.broadcast(dim), F.lower(basic_extname(F.col("path"))) == F.col("_k"), "left")
            .withColumn("language", F.coalesce("_n", F.lit("Other")))
            .withColumn("family", F.lit(None).cast("string"))
            .withColumn("comment", F.lit(None).cast("string"))
            .drop("_k", "_n")
        )
    keys = {
        "f": (dims.lang_file_dim(spark), basename(F.col("path"))),
        "c": (dims.lang_ext_dim(spark), compound_extname(F.col("path"))),
        "e": (dims.lang_ext_dim(spark), F.lower(extname(F.col("path")))),
    }
    out = files
    for p, (dim, key) in keys.items():
        named = dim.select(F.col("key").alias(f"_{p}k"), F.struct("name", "family", "comment").alias(f"_{p}"))
        out = out.join(F.broadcast(named), key == F.col(f"_{p}k"), "left")
    other = F.struct(F.lit("Other").alias("name"), F.lit("other").alias("family"), F.lit(None).cast("string").alias("comment"))
    return (
        out.withColumn("_l", F.coalesce("_f", "_c", "_e", other))
        .withColumn("language", F.col("_l.name"))
        .withColumn("family", F.col("_l.family"))
        .withColumn("comment", F.col("_l.comment"))
        .drop("_l", *[f"_{p}" for p in keys], *[f"_{p}k" for p in keys])
    )


def file_stats(files: DataFrame, profile: str = "extended") -> DataFrame:
    """One row per analyzed file: language, family, lines and size in UTF-16 units."""
    return classify_language(files, profile).select(
        "repo", "path", "language", "family",
        F.size(F.split("content", "\n")).alias("lines"), utf16_len(F.col("content")).alias("size"))
