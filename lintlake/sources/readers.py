"""Reading corpora: tables, directories, landed tree listings and content payloads."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import valid_utf8
from ..operators.rank import ensure_checkpoint_dir
from ..operators.selection import ignored_dir, select_files

TREE_SCHEMA = "array<struct<path:string,type:string,size:bigint,sha:string>>"
PAYLOAD_SCHEMA = "struct<encoding:string,content:string>"


SPREAD = "spark.lintlake.read.partitions"


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A parquet table, only the named columns.

    Its splits are the session's (``spark.sql.files.maxPartitionBytes``) and contents are not
    moved.  A small table in few row groups can be spread over so many partitions by naming
    their number in the setting ``spark.lintlake.read.partitions``; nothing else turns that on.
    """
    df = spark.read.parquet(path).select(*columns)
    parts = spark.conf.get(SPREAD, None)
    return df.repartition(int(parts)) if parts else df


LISTED = ["uri", "path", "is_dir", "size_bytes", "error"]
LIST_CHUNK = 10_000


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of each folder: regular files and folders, no links."""
    for batch in batches:
        for uri, rel in zip(batch["uri"], batch["rel"]):
            fs, folder = pafs.FileSystem.from_uri(uri)
            local = isinstance(fs, pafs.LocalFileSystem)
            try:
                infos = fs.get_file_info(pafs.FileSelector(folder))
            except (FileNotFoundError, PermissionError) as e:  # other errors fail the task, which is tried again
                yield pd.DataFrame([(uri, rel, True, 0, type(e).__name__)], columns=LISTED)
                continue
            rows = [
                (fs_uri(uri, x.base_name), f"{rel}{x.base_name}", x.type == pafs.FileType.Directory, x.size or 0, None)
                for x in infos
                if x.type in (pafs.FileType.File, pafs.FileType.Directory) and not (local and os.path.islink(x.path))
            ]
            for at in range(0, len(rows), LIST_CHUNK):
                yield pd.DataFrame(rows[at : at + LIST_CHUNK], columns=LISTED)


def as_uri(root: str) -> str:
    """A folder's address; a plain path, or Hadoop's ``file:/path``, is a local one."""
    if root.startswith("file:/") and not root.startswith("file://"):
        return "file://" + root[len("file:"):]
    return root if "://" in root else "file://" + quote(os.path.abspath(root))


def fs_uri(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{quote(name)}"


def list_directory(spark: SparkSession, root: str, repo: str) -> DataFrame:
    """Files under a directory: ``repo, path, size_bytes, uri, error``.

    A folder that is gone or may not be read is a row with its ``error``; any other failure
    of the store fails the task.

    The tree is walked level by level, the folders of a level spread over tasks; ignored
    folders are not entered and appear as one row whose path ends with a slash.  Spark's
    own file sources are not used because they hide names that start with ``_`` or ``.``,
    such as ``__init__.py`` and ``.env``.
    """
    ensure_checkpoint_dir(spark)
    frontier = spark.createDataFrame([(as_uri(root), "")], "uri string, rel string")
    found: DataFrame | None = None
    while True:
        level = (
            frontier.repartition("uri").mapInPandas(_list_folders, "uri string, path string, is_dir boolean, size_bytes bigint, error string")
            .withColumn("path", F.when(F.col("is_dir") & F.col("error").isNull(), F.concat("path", F.lit("/"))).otherwise(F.col("path")))
            .withColumn("ignored", F.col("is_dir") & F.col("error").isNull() & ignored_dir(F.col("path")).isNotNull())
            .checkpoint()  # every level is listed once
        )
        rows = level.where("NOT is_dir OR ignored OR error IS NOT NULL").select(
            F.lit(repo).alias("repo"), "path", F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("size_bytes")).cast("bigint").alias("size_bytes"), "uri", "error")
        found = rows if found is None else found.unionByName(rows)
        frontier = level.where("is_dir AND NOT ignored AND error IS NULL").select("uri", F.col("path").alias("rel"))
        if frontier.isEmpty():
            return found


READ = ["repo", "path", "size_bytes", "data", "error"]
READ_CHUNK_BYTES = 32 * 1024 * 1024


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows, held = [], 0
        for r in batch.itertuples(index=False):
            fs, path = pafs.FileSystem.from_uri(r.uri)
            data, error = None, None
            try:
                with fs.open_input_stream(path) as f:
                    data = f.read()
            except (FileNotFoundError, PermissionError) as e:  # other errors fail the task, which is tried again
                error = type(e).__name__
            rows.append((r.repo, r.path, r.size_bytes, data, error))
            held += len(data or b"")
            if held >= READ_CHUNK_BYTES:
                yield pd.DataFrame(rows, columns=READ)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=READ)


def read_contents(listed: DataFrame, skipped: bool = False) -> DataFrame:
    """Text of listed files: ``repo, path, size_bytes, content``.

    Select first: only the files that are left are opened.  With ``skipped`` the files that
    are gone or may not be read are rows too, with null content and their ``error``.
    """
    spread = listed.where("NOT endswith(path, '/')").select("repo", "path", "size_bytes", "uri").repartition("path")
    raw = spread.mapInPandas(_read_files, "repo string, path string, size_bytes bigint, data binary, error string")
    texts = raw.select("repo", "path", "size_bytes", valid_utf8(F.col("data")).alias("content"), "error")
    return texts if skipped else texts.where("error IS NULL").drop("error")


def scan_directory(spark: SparkSession, root: str, repo: str, profile: str = "extended") -> DataFrame:
    """The files of a directory that the profile analyzes, with their text."""
    return read_contents(select_files(list_directory(spark, root, repo).where("error IS NULL").drop("error"), profile))


def tree_blobs(trees: DataFrame) -> DataFrame:
    """Blobs of landed tree listings ``(repo, tree)``; ``tree`` is an array or JSON text."""
    tree = F.col("tree")
    if isinstance(trees.schema["tree"].dataType, T.StringType):
        tree = F.from_json(tree, TREE_SCHEMA)
    return (
        trees.select("repo", F.explode(tree).alias("e")).where("e.type = 'blob'")
        .select("repo", F.col("e.path").alias("path"), F.coalesce("e.size", F.lit(0)).cast("bigint").alias("size_bytes"))
    )


def payload_text(encoding: Column, content: Column) -> Column:
    """Decoded content of a landed payload."""
    packed = F.regexp_replace(content, r"\s", "")
    return F.when(
        (encoding == "base64") & (content != ""), valid_utf8(F.unbase64(packed))
    ).otherwise(F.coalesce(content, F.lit("")))


def decode_payloads(payloads: DataFrame) -> DataFrame:
    """``repo, path, content`` of landed payloads ``(repo, path, encoding, content)``."""
    return payloads.select("repo", "path", payload_text(F.col("encoding"), F.col("content")).alias("content"))
