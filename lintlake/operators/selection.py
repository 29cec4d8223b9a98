"""Which files of an inventory are analyzed, and why the others are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, extname
from ..sources import dims
from .classify import classify_language
from .match import sql_text


def _list(values: list[str]) -> Column:
    """A constant array, built in one call."""
    return F.expr(f"array({', '.join(map(sql_text, values))})")


def ignored_dir(path: Column) -> Column:
    """Topmost directory that is ignored by name or hidden, as a path prefix; else null."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    names = _list(dims.IGNORED_DIRS)
    flags = F.transform(dirs, lambda d: F.array_contains(names, d) | F.startswith(d, F.lit(".")))
    at = F.array_position(flags, F.lit(True)).cast("int")
    return F.when(at > 0, F.array_join(F.slice(parts, 1, at), "/"))


def is_binary(path: Column) -> Column:
    name = F.lower(basename(path))
    cond = F.array_contains(_list(dims.BINARY_EXTENSIONS), F.lower(extname(path))) | F.array_contains(_list(dims.LOCK_FILES), name)
    for s in dims.BUNDLE_SUFFIXES:
        cond = cond | F.endswith(name, F.lit(s))
    return cond


def basic_ignored(path: Column) -> Column:
    """A pattern anywhere in the path: ``cabinet.js`` is out because of ``bin``."""
    return F.exists(_list(dims.BASIC_IGNORED), lambda p: F.contains(path, p))


def basic_binary(path: Column) -> Column:
    return F.exists(_list(dims.BASIC_BINARY), lambda e: F.endswith(F.lower(path), e))


def basic_supported(path: Column) -> Column:
    return F.exists(_list(dims.BASIC_SUPPORTED), lambda e: F.endswith(path, e))


def skip_reason(inventory: DataFrame, profile: str = "extended") -> DataFrame:
    """Add ``skip_reason`` (null: analyzed) and ``ignored_root`` to ``(repo, path, size_bytes)``.

    Profiles: ``extended`` (a walked directory), ``remote`` (a listed tree: language and
    size only) and ``basic``.  A missing size counts as zero.
    """
    path = F.col("path")
    if profile == "basic":
        return inventory.withColumn("ignored_root", F.lit(None).cast("string")).withColumn(
            "skip_reason",
            F.when(basic_ignored(path), "ignored").when(basic_binary(path), "binary")
            .when(~basic_supported(path), "unsupported"))
    out = classify_language(inventory, "extended")
    too_big = F.coalesce(F.col("size_bytes"), F.lit(0)) > dims.MAX_FILE_BYTES
    unknown = F.col("family") == "other"
    if profile == "remote":
        return out.withColumn("ignored_root", F.lit(None).cast("string")).withColumn(
            "skip_reason", F.when(unknown, "unknown_language").when(too_big, "too_big"))
    return out.withColumn("ignored_root", ignored_dir(path)).withColumn(
        "skip_reason",
        F.when(F.col("ignored_root").isNotNull(), "ignored_dir").when(is_binary(path), "binary")
        .when(unknown, "unknown_language").when(too_big, "too_big"))


def select_files(files: DataFrame, profile: str = "extended", classified: bool = False) -> DataFrame:
    """Files to analyze.  Size comes from ``size_bytes`` or else from the content.

    ``classified`` keeps the language columns where the selection had to look them up.
    """
    cols = files.columns
    sized = files if "size_bytes" in cols else files.withColumn("size_bytes", F.octet_length("content"))
    kept = skip_reason(sized, profile).where("skip_reason IS NULL")
    extra = ["language", "family", "comment"] if classified and profile != "basic" else []
    return kept.select(*cols, *[c for c in extra if c not in cols])


def skip_counts(inventory: DataFrame, profile: str = "extended") -> DataFrame:
    """Skipped entries per repo and reason; an ignored directory counts once, whatever it holds."""
    skipped = skip_reason(inventory, profile).where("skip_reason IS NOT NULL")
    per_entry = skipped.groupBy("repo", "skip_reason", "ignored_root").agg(F.count("*").alias("n"))
    return per_entry.groupBy("repo", "skip_reason").agg(
        F.sum(F.when(F.col("ignored_root").isNotNull(), F.lit(1)).otherwise(F.col("n"))).cast("bigint").alias("skipped"))


def search_repos(repos: DataFrame, query: str, column: str = "repo") -> DataFrame:
    """Repositories whose name contains the query, ignoring case."""
    return repos.where(F.contains(F.lower(column), F.lower(F.lit(query))))
