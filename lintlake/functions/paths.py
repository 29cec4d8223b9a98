"""Path, URL, score and time functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extname(path: Column) -> Column:
    """Last dot and what follows; none when the name's only dot is its first character."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]*)$", 1)


def compound_extname(path: Column) -> Column:
    """Everything from the first dot of the file name."""
    return F.regexp_extract(basename(path), r"(?s)^[^.]*(\..*)$", 1)


def basic_extname(path: Column) -> Column:
    """Text after the last dot of the whole path."""
    return F.regexp_extract(path, r"(?s)(\.[^.]*)$", 1)


_HOSTED = r"github\.com/([^/]+)/([^/]+?)(?:\.git)?(?:/|$)"


def repo_key(url: Column, strict: bool = True) -> Column:
    """``owner/repo`` of a hosted URL or of an ``owner/repo`` literal, else null.

    ``strict`` (extended profile) allows no white space in the literal form.
    """
    literal = r"^([^/\s]+)/([^/\s]+)$" if strict else r"^([^/]+)/([^/]+)$"

    def named(pattern: str) -> Column:
        return F.when(url.rlike(pattern), F.concat(
            F.regexp_extract(url, pattern, 1), F.lit("/"),
            F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git$", "")))

    return F.coalesce(named(_HOSTED), named(literal))


# Lowest score of each grade.
GRADES = [(97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"),
          (67, "D+"), (63, "D"), (60, "D-")]
# Seconds per unit of relative time.
TIME_UNITS = [("year", 31536000), ("month", 2592000), ("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60)]


def letter_grade(score: Column) -> Column:
    cases = F.when(score >= GRADES[0][0], F.lit(GRADES[0][1]))
    for limit, grade in GRADES[1:]:
        cases = cases.when(score >= limit, F.lit(grade))
    return cases.otherwise(F.lit("F"))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, F.lit("good")).when(score >= 60, F.lit("fair")).otherwise(F.lit("poor"))


def time_ago(ts: Column, now: Column) -> Column:
    """Relative time in the largest unit that fits, rounded down."""
    seconds = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(1000000.0))
    cases = None
    for unit, size in TIME_UNITS:
        n = F.floor(seconds / F.lit(size))
        text = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")), F.lit(" ago"))
        cases = F.when(n >= 1, text) if cases is None else cases.when(n >= 1, text)
    return cases.otherwise(F.lit("just now"))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))


def env_name(label: Column) -> Column:
    """Environment variable name suggested for a kind of secret."""
    return F.regexp_replace(F.upper(label), "[^A-Z]", "_")


def summary_text(profile: str, files: Column, lines: Column, critical: Column, warnings: Column, overall: Column) -> Column:
    """One-paragraph summary of a report; the two profiles word it differently."""
    many = F.format_number(lines, 0)
    empty = F.lit("")
    if profile == "basic":
        return F.concat(
            F.lit("Analyzed "), files.cast("string"), F.lit(" files with "), many, F.lit(" lines of code. "),
            F.when(critical > 0, F.concat(F.lit("Found "), plural(critical, "critical issue"),
                                          F.lit(" that require immediate attention. "))).otherwise(empty),
            F.when(warnings > 0, F.concat(F.lit("Identified "), plural(warnings, "warning"),
                                          F.lit(" that should be reviewed. "))).otherwise(empty),
            F.when(overall >= 80, F.lit("Overall, the codebase is in good shape."))
            .when(overall >= 60, F.lit("The codebase has room for improvement."))
            .otherwise(F.lit("The codebase needs significant attention.")))
    return F.concat(
        F.lit("Analyzed "), files.cast("string"), F.lit(" files ("), many, F.lit(" lines). "),
        F.when(critical > 0, F.concat(plural(critical, "critical issue"), F.lit(" need immediate attention. "))).otherwise(empty),
        F.when(warnings > 0, F.concat(plural(warnings, "warning"), F.lit(" to review. "))).otherwise(empty),
        F.when(overall >= 80, F.lit("Overall the codebase is in good shape."))
        .when(overall >= 60, F.lit("Room for improvement."))
        .otherwise(F.lit("Significant attention needed.")))
