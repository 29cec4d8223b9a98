"""Writing audits: findings tables, paged JSON reports, compact text."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.findings import assign_ids, stored
from ..operators.rank import row_numbers
from .readers import as_uri

PAGE_SIZE = 1000
PAGE_BYTES = 16 * 1024 * 1024


def report_header(report: DataFrame, languages: DataFrame, timestamp: str | None = None) -> DataFrame:
    """``repo, json``: the report without its lists, with nested statistics (languages in a map) and scores.

    ``languages`` has ``repo, language, files``: at most one row per known language and
    repository.  ``timestamp`` is written as given; null leaves it out.
    """
    counted = languages.groupBy("repo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "files")))).alias("by_language"))
    named = {"total_files": "totalFiles", "analyzed_files": "analyzedFiles", "analyzed_lines": "analyzedLines"}
    issues = {"total_issues": "totalIssues", "critical_issues": "criticalIssues", "warnings": "warnings", "suggestions": "suggestions"}
    statistics = F.struct(
        *[F.col(c).alias(n) for c, n in named.items()], F.coalesce("by_language", F.expr("map()").cast("map<string,bigint>")).alias("languages"),
        *[F.col(c).alias(n) for c, n in issues.items()])
    scores = F.struct("security", "performance", "quality", "cleanliness", "overall")
    return report.join(counted, "repo", "left").select("repo", F.to_json(F.struct(
        F.col("repo").alias("repository"), F.lit(timestamp).alias("timestamp"), statistics.alias("statistics"), scores.alias("scores"),
        "grade", "summary")).alias("json"))


def _with_code(item: Column, columns: list[str]) -> Column:
    """JSON of an issue with its ``code``: a list of lines, or a text."""
    if "code" not in columns:
        return item
    code = F.when(F.col("code").isNotNull(), F.to_json(F.struct("code"))).when(F.col("code_text").isNotNull(), F.to_json(F.struct(F.col("code_text").alias("code"))))
    return F.when(code.isNull(), item).otherwise(F.concat(F.expr("left(item, length(item) - 1)"), F.lit(","), F.substr(code, F.lit(2))))


def report_documents(
    report: DataFrame, findings: DataFrame, files: DataFrame, page: int = PAGE_SIZE, page_bytes: int = PAGE_BYTES, timestamp: str | None = None,
) -> DataFrame:
    """The report of every repository as JSON documents: ``repo, section, page, part, json``.

    One header per repository (statistics with languages, scores, summary) and its issues
    and files in pages of a fixed number of entries.  A page whose entries are long
    (snippets of minified code) is cut into parts by bytes.  A repository of any size
    becomes more documents; none is ever assembled in one row.
    """
    head = report_header(report, files.groupBy("repo", "language").agg(F.count("*").alias("files")), timestamp).select(
        "repo", F.lit("header").alias("section"), F.lit(0).cast("bigint").alias("page"), F.lit(0).cast("bigint").alias("part"), "json")

    def paged(df: DataFrame, number: str, section: str, item: Column) -> DataFrame:
        rows = df.withColumn("item", F.to_json(item)).select(
            "repo", F.col(number).alias("n"), F.floor((F.col(number) - 1) / page).cast("bigint").alias("page"), _with_code(F.col("item"), df.columns).alias("item"))
        # a window holds one page, never a repository
        sofar = Window.partitionBy("repo", "page").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        parts = rows.withColumn("part", F.floor(F.coalesce(F.sum(F.octet_length("item")).over(sofar), F.lit(0)) / page_bytes).cast("bigint"))
        return parts.groupBy("repo", "page", "part").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("items")).select(
            "repo", F.lit(section).alias("section"), "page", "part",
            F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]")).alias("json"))

    issues = findings if "id" in findings.columns else assign_ids(findings)
    cols = [c for c in issues.columns if c not in ("repo", "id", "ord", "seq", "rule_id", "code", "code_text")]
    issue_pages = paged(issues, "id", "issues", F.struct("id", *cols))
    numbered = row_numbers(files.select("repo", "path", "language", "family", "lines", "size"), "n", ["repo"], ["path"])
    file_pages = paged(numbered, "n", "files", F.struct("path", "language", "family", "lines", "size"))
    return head.unionByName(issue_pages).unionByName(file_pages)


def write_files(files: DataFrame, root: str) -> int:
    """Every ``path, content`` as a file under a folder; how many there are.  A task that runs again writes the same files."""
    base = as_uri(root)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                fs, at = pafs.FileSystem.from_uri("/".join([base.rstrip("/"), *map(quote, path.split("/"))]))
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(at) as f:
                    f.write(content.encode())
            yield batch[["path"]]

    return files.select("path", "content").mapInPandas(put, "path string").count()


BUCKETS = 256


def _bucketed(df: DataFrame, *order: str) -> DataFrame:
    """Rows dealt by ranges of (bucket of the repository, order), so that a bucket is written by few tasks and a large repository by several."""
    bucket = F.pmod(F.xxhash64("repo"), F.lit(BUCKETS)).cast("int").alias("bucket")
    return df.select("*", bucket).repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)


def write_report_json(documents: DataFrame, path: str) -> None:
    """JSON documents in one folder per bucket of repositories."""
    _bucketed(stored(documents), "repo", "section", "page", "part").write.mode("overwrite").partitionBy("bucket").json(path)


def write_findings(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Findings table in one folder per bucket of repositories, in the order of repository and file.

    The findings are computed once and stored before they are dealt out.
    """
    _bucketed(stored(findings), "repo", "file").write.mode(mode).option("maxRecordsPerFile", 1_000_000).partitionBy("bucket").parquet(path)


def write_compact(lines: DataFrame, path: str) -> None:
    """Compact report as text, one folder per repository, in report order."""
    ordered = stored(lines).repartitionByRange("repo", "section", "position").sortWithinPartitions("repo", "section", "position")
    ordered.select("repo", F.col("text").alias("value")).write.mode("overwrite").partitionBy("repo").text(path)
