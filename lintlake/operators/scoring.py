"""Aggregates: totals, penalties, scores, histograms, rollups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import letter_grade, score_band, summary_text
from ..rules.model import Rule
from .rank import row_numbers

# Points per finding, most points per type, weight in the overall score.
POINTS = {"critical": 15, "warning": 5, "info": 1}
CAPS = {"security": 60, "performance": 40, "quality": 40, "unused": 30}
SCORE_NAMES = {"security": "security", "performance": "performance", "quality": "quality", "unused": "cleanliness"}
WEIGHTS = {"security": 0.35, "performance": 0.25, "quality": 0.25, "cleanliness": 0.15}
SEVERITIES = ("critical", "warning", "info")
LANGUAGE_CAP = 15


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo").agg(
        *[F.count_if(F.col("severity") == s).cast("bigint").alias(n)
          for s, n in (("critical", "critical_issues"), ("warning", "warnings"), ("info", "suggestions"))])


def penalties(findings: DataFrame, profile: str = "extended") -> DataFrame:
    """Penalty points per repository and type.

    An unknown type counts as quality.  An unknown severity costs one point in the
    extended profile and nothing in the basic one.
    """
    known = F.when(F.col("type").isin(*CAPS), F.col("type")).otherwise(F.lit("quality"))
    other = 0 if profile == "basic" else 1
    points = F.when(F.col("severity") == "critical", POINTS["critical"]).when(
        F.col("severity") == "warning", POINTS["warning"]).when(
        F.col("severity") == "info", POINTS["info"]).otherwise(other)
    return findings.groupBy("repo", known.alias("type")).agg(F.sum(points).alias("points"))


def _score(points: Column, cap: int) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - F.least(points, F.lit(cap))).cast("int")


def overall_score() -> Column:
    """Weighted mean of the four scores, rounded half up."""
    total = None
    for name, weight in WEIGHTS.items():
        part = F.col(name).cast("double") * F.lit(weight)
        total = part if total is None else total + part
    return F.floor(total + F.lit(0.5)).cast("int")


def with_scores(points: DataFrame) -> DataFrame:
    """Scores, grade and band from columns ``points_<type>``."""
    out = points
    for t, cap in CAPS.items():
        out = out.withColumn(SCORE_NAMES[t], _score(F.coalesce(f"points_{t}", F.lit(0)), cap))
    out = out.withColumn("overall", overall_score())
    return out.withColumn("grade", letter_grade(F.col("overall"))).withColumn("band", score_band(F.col("overall")))


def score_findings(findings: DataFrame, profile: str = "extended") -> DataFrame:
    """Scores per repository from a stored findings table."""
    per_type = penalties(findings, profile).groupBy("repo").pivot("type", list(CAPS)).sum("points")
    for t in CAPS:
        per_type = per_type.withColumnRenamed(t, f"points_{t}")
    return with_scores(per_type).drop(*[f"points_{t}" for t in CAPS])


def repo_report(audited: DataFrame, rules: list[Rule], profile: str = "extended", selected: DataFrame | None = None) -> DataFrame:
    """Statistics, scores, grade and summary per repository, in one pass over the audit.

    Each file is reduced to a few counters before the only shuffle, which carries one
    partial row per task and repository, however large a repository is.
    ``selected`` gives the files that were chosen but may not have been readable.
    """
    kinds, code = hit_kinds(rules)
    per_file = audited.select("repo", F.size("lines").alias("n"), F.transform("hits", lambda h: code(h["rix"])).alias("kinds"))
    counted = per_file.select("repo", F.lit(1).alias("files"), "n", *[
        F.size(F.filter("kinds", _equals(c))).alias(f"{t}_{s}")
        for c, (t, s) in enumerate(kinds)])
    return report_of_counters(counted, kinds, profile, selected)


def hit_kinds(rules: list[Rule]) -> tuple[list[tuple[str, str]], Callable[[Column], Column]]:
    """The (type, severity) pairs of some rules, and the place of a rule number's pair among them."""
    kinds = [(t, s) for t in CAPS for s in SEVERITIES if any(r.type == t and r.severity == s for r in rules)]
    codes = [-1] * (max(r.rix for r in rules) + 1)
    for r in rules:
        codes[r.rix] = kinds.index((r.type, r.severity))
    table = F.array(*map(F.lit, codes))
    return kinds, lambda rix: F.get(table, rix)


def report_of_counters(counted: DataFrame, kinds: list[tuple[str, str]], profile: str = "extended", selected: DataFrame | None = None) -> DataFrame:
    """The report of ``repo_report`` from rows of ``repo, files, n`` (lines) and a counter per kind, which may be negative where something is taken back."""

    def total(*pick: str) -> Column:
        cols = [F.col(f"{t}_{s}") for t, s in kinds if t in pick or s in pick]
        return sum(cols[1:], cols[0]) if cols else F.lit(0)

    stats = counted.groupBy("repo").agg(
        F.sum("files").cast("bigint").alias("analyzed_files"), F.sum("n").cast("bigint").alias("analyzed_lines"),
        *[F.sum(f"{t}_{s}").cast("bigint").alias(f"{t}_{s}") for t, s in kinds])
    for t in CAPS:
        parts = [F.col(f"{t}_{s}") * POINTS[s] for s in SEVERITIES if (t, s) in kinds]
        stats = stats.withColumn(f"points_{t}", sum(parts[1:], parts[0]) if parts else F.lit(0))
    stats = stats.withColumn("critical_issues", total("critical")).withColumn("warnings", total("warning")).withColumn(
        "suggestions", total("info"))
    stats = stats.withColumn("total_issues", F.col("critical_issues") + F.col("warnings") + F.col("suggestions"))
    if selected is not None:
        chosen = selected.groupBy("repo").agg(F.count("*").alias("total_files"))
        stats = stats.join(chosen, "repo", "left")
    else:
        stats = stats.withColumn("total_files", F.col("analyzed_files"))
    return _report_columns(with_scores(stats), profile)


def report_of_findings(findings: DataFrame, stats: DataFrame, profile: str = "extended") -> DataFrame:
    """The report of ``repo_report`` from stored findings and file statistics."""
    files = stats.groupBy("repo").agg(F.count("*").alias("analyzed_files"), F.sum("lines").cast("bigint").alias("analyzed_lines"))
    per_type = penalties(findings, profile).groupBy("repo").pivot("type", list(CAPS)).sum("points")
    for t in CAPS:
        per_type = per_type.withColumnRenamed(t, f"points_{t}")
    names = ["critical_issues", "warnings", "suggestions"]
    out = files.join(severity_counts(findings), "repo", "left").join(per_type, "repo", "left")
    for n in names:
        out = out.withColumn(n, F.coalesce(n, F.lit(0)).cast("bigint"))
    out = out.withColumn("total_issues", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    return _report_columns(with_scores(out.withColumn("total_files", F.col("analyzed_files"))), profile)


def _report_columns(scored: DataFrame, profile: str) -> DataFrame:
    return scored.withColumn("summary", summary_text(
        profile, F.col("analyzed_files"), F.col("analyzed_lines"), F.col("critical_issues"), F.col("warnings"), F.col("overall"))).select(
        "repo", "total_files", "analyzed_files", "analyzed_lines", "total_issues", "critical_issues", "warnings",
        "suggestions", "security", "performance", "quality", "cleanliness", "overall", "grade", "band", "summary")


def _equals(code: int):
    return lambda k: k == code


# --- languages ------------------------------------------------------------------------

def language_histogram(stats: DataFrame) -> DataFrame:
    return stats.groupBy("repo", "language").agg(F.count("*").alias("files"), F.min("path").alias("first_seen"))


def language_share(stats: DataFrame, top: int = LANGUAGE_CAP) -> DataFrame:
    """Most frequent languages of each repository with their share of its files."""
    hist = language_histogram(stats)  # at most one row per known language and repo
    per_repo = Window.partitionBy("repo")
    rank = per_repo.orderBy(F.desc("files"), "first_seen")
    return (
        hist.withColumn("pct", F.round(F.col("files") / F.sum("files").over(per_repo) * 100, 1))
        .withColumn("position", F.row_number().over(rank))
        .withColumn("more", F.greatest(F.count("*").over(per_repo) - top, F.lit(0)))
        .where(F.col("position") <= top).drop("first_seen")
    )


# --- files, directories, rules --------------------------------------------------------

def _of_rules(rules: list[Rule], value, default) -> Column:
    """A table from rule position to a value, as an array column."""
    out = [default] * (max(r.rix for r in rules) + 1)
    for r in rules:
        out[r.rix] = value(r)
    return F.array(*map(F.lit, out))


def file_counts(audited: DataFrame, rules: list[Rule]) -> DataFrame:
    """``repo, file, critical, warning, info`` of every analyzed file, from its own hits: nothing is joined or shuffled."""
    level = _of_rules(rules, lambda r: {"critical": 0, "warning": 1}.get(r.severity, 2), 2)
    rows = audited.select("repo", F.col("path").alias("file"), F.transform("hits", lambda h: F.get(level, h["rix"])).alias("levels"))
    return rows.select("repo", "file", *[
        F.size(F.filter("levels", _equals(i))).cast("bigint").alias(n) for i, n in enumerate(SEVERITIES)])


def _worst() -> Column:
    return F.when(F.col("critical") > 0, "critical").when(F.col("warning") > 0, "warning").when(F.col("info") > 0, "info")


def file_badges(counts: DataFrame) -> DataFrame:
    """Severity counts, total and worst severity of the files with findings."""
    # One row each by an outer explode: a filter on the counters themselves would be pushed
    # below them, and evaluate all rules again for each counter.
    once = counts.select("repo", "file", F.inline_outer(F.array(F.struct(*SEVERITIES))))
    total = F.col("critical") + F.col("warning") + F.col("info")
    return once.withColumn("total", total).where("total > 0").withColumn("worst", _worst())


def dir_rollup(counts: DataFrame) -> DataFrame:
    """The file tree as rows: every directory and file with its files, findings and worst severity.

    ``position`` orders the nodes of one parent: directories first, then by name.
    """
    nodes = counts.select("repo", *SEVERITIES, F.split("file", "/").alias("parts")).select(
        "repo", *SEVERITIES, "parts", F.size("parts").alias("n"), F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    rolled = nodes.groupBy(
        "repo", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("node"), "depth",
        (F.col("depth") == F.col("n")).alias("is_file"),
    ).agg(F.count("*").alias("files"), *[F.sum(c).cast("bigint").alias(c) for c in SEVERITIES])
    return rolled.withColumn("name", F.element_at(F.split("node", "/"), -1)).withColumn("worst", _worst())


def tree_positions(nodes: DataFrame) -> DataFrame:
    """Nodes of ``dir_rollup`` with their ``position`` in the repository's tree listed by key order, each directory before what it holds."""
    # The path with a mark that no name can have sorts a directory right before its own nodes.
    key = F.replace("node", F.lit("/"), F.lit("\u0000"))
    return row_numbers(nodes.withColumn("_key", key), "position", ["repo"], ["_key", "is_file"]).drop("_key")


def type_severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts by type and severity with subtotals and a grand total."""
    return findings.rollup("type", "severity").agg(F.count("*").alias("issues"))


def rule_matrix(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type", "severity", "title").agg(
        F.count("*").alias("issues"), F.count_distinct("repo").alias("repos"))


def corpus_rollup(audited: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of every rule over the whole corpus, and per thousand lines, in one pass over the audit.

    Each task sends one row per rule and title; the corpus' lines come along as one more.
    """
    texts = _of_rules(rules, lambda r: r.id, None), _of_rules(rules, lambda r: r.title, None)
    rows = audited.select(F.size("lines").alias("n"), F.transform("hits", lambda h: h["rix"]).alias("rixes"))
    spread = rows.select(F.explode(F.concat(
        F.array(F.struct(F.lit(-1).alias("rix"), F.col("n").alias("lines"))),
        F.transform("rixes", lambda r: F.struct(r.alias("rix"), F.lit(0).alias("lines"))))).alias("x"))
    counted = spread.groupBy("x.rix").agg(F.count("*").alias("issues"), F.sum("x.lines").alias("lines"))
    # one row per rule position: a table of fixed size
    whole = Window.partitionBy(F.lit(0))
    named = counted.withColumn("all_lines", F.sum("lines").over(whole)).where("rix >= 0").select(
        F.get(texts[0], F.col("rix")).alias("rule_id"), F.get(texts[1], F.col("rix")).alias("title"), "issues", "all_lines")
    return named.groupBy("rule_id", "title").agg(F.sum("issues").alias("issues"), F.max("all_lines").alias("all_lines")).select(
        "rule_id", "title", "issues", F.round(F.col("issues") * 1000 / F.col("all_lines"), 4).alias("per_1k_lines"))


def mean_scores(report: DataFrame) -> DataFrame:
    """Mean scores over all repositories of a report (one row)."""
    names = [*WEIGHTS, "overall"]
    return report.agg(F.count("*").alias("repos"), *[F.round(F.avg(n), 4).alias(f"mean_{n}") for n in names])


# --- references between files ---------------------------------------------------------

# Import specifiers: quoted module names, and Python module paths at line starts.
_QUOTED = r"""(?:from|import|require\s*\()\s*['"]([^'"\n]+)['"]"""
_PYTHON = r"(?m)^(?:from|import)\s+([\w.]+)"


def import_edges(files: DataFrame) -> DataFrame:
    """``repo, source, stem``: which file names the files of a repository import."""
    targets = F.concat(
        F.regexp_extract_all("content", F.lit(_QUOTED), F.lit(1)),
        F.transform(F.regexp_extract_all("content", F.lit(_PYTHON), F.lit(1)), lambda t: F.replace(t, F.lit("."), F.lit("/"))))
    stems = F.array_distinct(F.transform(targets, lambda t: F.regexp_replace(F.element_at(F.split(t, "/"), -1), r"\.[^.]+$", "")))
    return files.select("repo", F.col("path").alias("source"), F.explode(stems).alias("stem")).where("stem <> ''")


def dead_files(files: DataFrame) -> DataFrame:
    """Files whose name no other file of the repository imports (opt-in, no finding).

    A name is imported by another file when the least or the greatest importing path
    differs from the file's own, so each name is reduced to two paths before the join.
    """
    used = import_edges(files).groupBy("repo", "stem").agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return (
        files.select("repo", "path", stem.alias("stem")).join(used, ["repo", "stem"], "left")
        .where("lo IS NULL OR (lo = path AND hi = path)").select("repo", "path")
    )
