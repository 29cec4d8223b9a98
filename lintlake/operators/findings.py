"""Operators over a findings table: identity, filters, orderings, short lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules.model import Rule
from .rank import ensure_checkpoint_dir, row_numbers

# Emission order inside a repository; files go by path.
EMISSION = ["file", "ord", "seq"]
# Fixed values.
SEVERITY_RANK = {"info": 0, "warning": 1, "critical": 2}
SEVERITY_SORT = {"critical": 0, "warning": 1, "info": 2}
INFO_CAP = 20
FIX_CAP = 20


def _lookup(c: Column, table: dict[str, int], default: int) -> Column:
    cases = None
    for k, v in table.items():
        cases = F.when(c == k, F.lit(v)) if cases is None else cases.when(c == k, F.lit(v))
    return cases.otherwise(F.lit(default))


def stored(df: DataFrame) -> DataFrame:
    """Findings written once to the checkpoint folder, for results that read them often."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def dedupe_findings(df: DataFrame) -> DataFrame:
    """First finding per (repo, file, line, title).

    ``findings`` already dedupes inside each file without a shuffle; this is for tables
    merged from several runs.  The key is per line, so no group can grow large.
    """
    w = Window.partitionBy("repo", "file", "line", "title").orderBy("ord", "seq")
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def assign_ids(df: DataFrame) -> DataFrame:
    """Sequential ``id`` per repository in emission order."""
    return row_numbers(df, "id", ["repo"], EMISSION)


def new_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that an earlier audit did not have."""
    return current.join(baseline.select("repo", "file", "line", "title"), ["repo", "file", "line", "title"], "left_anti")


def rules_for(rules: list[Rule], wanted: Callable[[Rule], bool]) -> list[Rule]:
    """The rules that findings of the wanted ones depend on: these, and those that share a title with one (equal titles are duplicates)."""
    titles = {r.title for r in rules if wanted(r)}
    return [r for r in rules if r.title in titles]


# --- filters --------------------------------------------------------------------------

def min_severity(df: DataFrame, level: str) -> DataFrame:
    """At least this severe; an unknown level keeps everything."""
    return df.where(_lookup(F.col("severity"), SEVERITY_RANK, 0) >= SEVERITY_RANK.get(level, 0))


def of_type(df: DataFrame, type_: str) -> DataFrame:
    return df.where(F.col("type") == type_)


def of_severity(df: DataFrame, severity: str = "all", file: str | None = None) -> DataFrame:
    out = df if severity == "all" else df.where(F.col("severity") == severity)
    return out if file is None else out.where(F.col("file") == file)


def under_path(df: DataFrame, prefix: str) -> DataFrame:
    """Plain string prefix: ``src/d1`` also takes ``src/d10``."""
    return df.where(F.startswith("file", F.lit(prefix)))


def ci_gate(counts: DataFrame) -> DataFrame:
    """Per repository with analyzed files: does it have a critical finding?  From ``scoring.file_counts``, in one pass."""
    return counts.groupBy("repo").agg(F.sum("critical").cast("bigint").alias("critical_issues")).withColumn("gate", F.col("critical_issues") > 0)


# --- orderings and short lists --------------------------------------------------------

def severity_sort_key() -> Column:
    return _lookup(F.col("severity"), SEVERITY_SORT, 3)


def sorted_by(df: DataFrame, what: str, name: str = "position") -> DataFrame:
    """Position of each finding of a repository when sorted by severity, file or type.

    Ties keep emission order.  Files and types compare by the Unicode collation.
    """
    keys = {"severity": severity_sort_key(), "file": F.collate("file", "UNICODE"), "type": F.collate("type", "UNICODE")}
    ranked = df.withColumn("_key", keys[what])
    return row_numbers(ranked, name, ["repo"], ["_key", *EMISSION]).drop("_key")


def first_per(df: DataFrame, by: list[str], n: int, name: str = "position") -> DataFrame:
    """First n findings of each group in emission order.

    Spark cuts each group to n before the shuffle (rank limit), so a group that holds
    most of the rows still sends at most n per task.
    """
    w = Window.partitionBy(*by).orderBy(*EMISSION)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def info_top(df: DataFrame, n: int | None = INFO_CAP) -> DataFrame:
    """Info findings a compact report shows: the first ``n`` of a repository (None: all)."""
    info = df.where("severity = 'info'")
    return row_numbers(info, "position", ["repo"], EMISSION) if n is None else first_per(info, ["repo"], n)


def fixable(df: DataFrame, n: int | None = FIX_CAP) -> DataFrame:
    """Findings whose suggestion carries code: the first ``n`` of a repository (None: all)."""
    coded = df.where("suggestion.code IS NOT NULL")
    return row_numbers(coded, "position", ["repo"], EMISSION) if n is None else first_per(coded, ["repo"], n)


def compact_lines(df: DataFrame, report: DataFrame | None = None, cap: int | None = INFO_CAP) -> DataFrame:
    """Lines of the compact report: ``repo, section, position, text``.

    Critical and warning findings are all listed, info findings up to ``cap`` (None: all)
    with a count of the rest.  With a ``report`` every repository, also one without
    findings, has a heading (section -1): files, lines, scores, and whether it is clean.
    """
    item = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" — "), "title")
    # Numbering writes the findings once; the parts below only read them back.
    numbered = row_numbers(df.select("repo", "severity", *EMISSION, item.alias("text")), "position", ["repo", "severity"], EMISSION)
    shown = numbered if cap is None else numbered.where((F.col("severity") != "info") | (F.col("position") <= cap))
    shown = shown.select("repo", "severity", "position", "text")
    counts = numbered.groupBy("repo", "severity").agg(F.max("position").alias("n"))
    label = F.when(F.col("severity") == "critical", "Critical").when(F.col("severity") == "warning", "Warnings").otherwise("Info")
    heads = counts.select("repo", "severity", F.lit(0).cast("bigint").alias("position"),
                          F.concat(label, F.lit(" ("), F.col("n").cast("string"), F.lit("):")).alias("text"))
    lines = shown.unionByName(heads)
    if cap is not None:
        lines = lines.unionByName(counts.where(f"severity = 'info' AND n > {cap}").select(
            "repo", "severity", F.lit(cap + 1).cast("bigint").alias("position"),
            F.concat(F.lit("... and "), (F.col("n") - cap).cast("string"), F.lit(" more")).alias("text")))
    lines = lines.select("repo", severity_sort_key().alias("section"), "position", "text")
    if report is None:
        return lines
    score = lambda name, c: F.concat(F.lit(f"{name} "), F.col(c).cast("string"))
    heading = F.array_compact(F.array(
        F.concat(F.lit("Files: "), F.col("analyzed_files").cast("string")), F.concat(F.lit("Lines: "), F.col("analyzed_lines").cast("string")),
        F.concat(F.lit("Score: "), F.col("overall").cast("string"), F.lit(" ("), F.col("grade"), F.lit(")")),
        F.concat_ws(", ", score("Security", "security"), score("Performance", "performance"), score("Quality", "quality"), score("Cleanliness", "cleanliness")),
        F.when(F.col("total_issues") == 0, F.lit("No issues found."))))
    return lines.unionByName(report.select("repo", F.lit(-1).alias("section"), F.posexplode(heading).alias("position", "text")).select(
        "repo", "section", F.col("position").cast("bigint").alias("position"), "text"))
