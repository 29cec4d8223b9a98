"""The file corpus that queries run on, derived from the given tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import read_table
from .snippets import PATH_CASES, PREPENDED, SNIPPETS


def snippet_dim(spark: SparkSession) -> DataFrame:
    n = len(SNIPPETS)
    return spark.createDataFrame(pa.table({
        "k": pa.array(range(n), pa.int64()),
        "suffix": pa.array([s for s, _ in SNIPPETS], pa.string()),
        "body": pa.array([b for _, b in SNIPPETS], pa.string()),
        "pre": pa.array([i in PREPENDED for i in range(n)], pa.bool_()),
    }))


def path_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table({
        "k": pa.array(range(len(PATH_CASES)), pa.int64()), "case_path": pa.array(PATH_CASES, pa.string())}))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a source file: its text plus one snippet."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")
    joined = docs.join(F.broadcast(snippet_dim(spark)), F.col("doc_id") % len(SNIPPETS) == F.col("k"))
    doc = F.col("doc_id").cast("string")
    tail = F.when(F.startswith("suffix", F.lit(".")), F.col("suffix")).otherwise(F.concat(F.lit("/"), "suffix"))
    return joined.select(
        F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string")).alias("repo"),
        F.concat(F.lit("src/d"), (F.col("doc_id") % 7).cast("string"), F.lit("/f"), doc, tail).alias("path"),
        F.when(F.col("pre"), F.concat("body", F.lit("\n"), "text")).otherwise(F.concat("text", F.lit("\n"), "body")).alias("content"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an HTML file."""
    pages = read_table(spark, f"{sf_dir}/pages.parquet", "page_id", "html")
    return pages.select(
        F.lit("web").alias("repo"), F.concat(F.lit("site/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("content"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_files(spark, sf_dir).unionByName(page_files(spark, sf_dir))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a listed file under a telling path; sizes reach past the limit."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "n_chars")
    joined = docs.join(F.broadcast(path_dim(spark)), F.col("doc_id") % len(PATH_CASES) == F.col("k"))
    return joined.select(
        F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string")).alias("repo"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("/"), "case_path").alias("path"),
        (F.col("n_chars") * 200).alias("size_bytes"))
