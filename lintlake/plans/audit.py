"""The audit of a file corpus as one projection per file plus one explode.

scan -> select -> classify (broadcast lookups) -> one array of hits per file -> dedupe
inside the row -> context -> explode.  No stage shuffles file contents, and a repository
of any size is just more rows: skew cannot build up before the final aggregates.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MARK, MARK_SUBSTITUTE, swapped
from ..operators.classify import classify_language
from ..operators.detectors import CANDIDATES, DETECTORS, unused_names
from ..operators.match import code_context, pattern_hits, prepare
from ..operators.selection import select_files
from ..rules import profile_rules
from ..rules.model import Rule


def rules_dim(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Texts of the rules as a table; its size is the number of rules."""
    text = ["id", "type", "severity", "title", "description", "suggestion", "suggestion_code"]
    cols = {"rix": pa.array([r.rix for r in rules], pa.int32())}
    cols |= {c: pa.array([getattr(r, c) for r in rules], pa.string()) for c in text}
    return spark.createDataFrame(pa.table(cols)).withColumnRenamed("id", "rule_id")


def hits_column(rules: tuple[Rule, ...]) -> Column:
    """All raw hits of a prepared file row as one array.

    The column depends on the rules alone, so it is built once per rule set and Spark
    context; the columns of a stopped context are dropped with it.
    """
    context = SparkContext._active_spark_context
    known = _BUILT.setdefault(context, {})
    if rules not in known:
        known[rules] = _build_hits(rules)
    return known[rules]


_BUILT: WeakKeyDictionary = WeakKeyDictionary()


def _build_hits(rules: tuple[Rule, ...]) -> Column:
    patterns = [r for r in rules if r.detector is None]
    names = [r for r in rules if r.detector in CANDIDATES]
    by_detector: dict[str, list[Rule]] = {}
    for r in rules:
        if r.detector in DETECTORS:
            by_detector.setdefault(r.detector, []).append(r)
    parts = [pattern_hits(patterns)] if patterns else []
    parts += [DETECTORS[name](rs) for name, rs in by_detector.items()]
    parts += [unused_names(names)] if names else []
    return F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))


def first_wins(hits: Column) -> Column:
    """Sorted hits without repeats of (line, title); the earliest emitted one stays."""
    return F.filter(hits, lambda h, i: (i == 0) | ~(
        (F.get(hits, i - 1)["line"] == h["line"]) & (F.get(hits, i - 1)["tkey"] == h["tkey"])))


def audit_files(
    files: DataFrame, profile: str = "extended", groups: tuple[str, ...] | None = None,
    rules: list[Rule] | None = None, select: bool = True, keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per analyzed file with its deduplicated hits, and further columns of the files to ``keep``.

    ``files`` has ``repo, path, content`` with one row per (repo, path).  Reducing to
    some rule groups also reduces the work to them.  Count or explode ``hits``; a filter on
    it would be pushed below and evaluate the rules again.
    """
    rules = profile_rules(profile, groups) if rules is None else rules
    chosen = select_files(files, profile, classified=True) if select else files
    ready = prepare(classify_language(chosen, profile))
    # Sorting puts equal (line, title) side by side, earliest first.
    found = ready.select(
        "repo", "path", "language", "family", "content", "lines", *keep, F.sort_array(hits_column(tuple(rules))).alias("sorted"))
    return found.select(
        "repo", "path", "language", "family", "content", "lines", *keep, first_wins(F.col("sorted")).alias("hits"))


HIT_FIELDS = ("line", "tkey", "ord", "seq", "rix", "a", "b", "text")


def _fill(template: Column) -> Column:
    """Put a hit's values into a rule text; free text goes in last."""
    line = F.col("line")
    out = F.replace(template, F.lit("{line}"), line.cast("string"))
    out = F.replace(out, F.lit("{end}"), (line + 3).cast("string"))
    out = F.replace(out, F.lit("{b}"), F.coalesce("b", F.lit("{b}")))
    return F.replace(out, F.lit("{a}"), F.coalesce("a", F.lit("{a}")))


def explode_hits(audited: DataFrame, rules: list[Rule], context: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings, one row each; ``context`` adds the code lines around them, ``keep`` further columns of the audit."""
    spark = audited.sparkSession
    # The outer form, then a test on its output: for the inner one the optimizer infers
    # "array not empty" and pushes it below, which evaluates all rules once more.
    if context:
        around = [0] * (max(r.rix for r in rules) + 1)
        for r in rules:
            around[r.rix] = r.around
        arounds = F.array(*map(F.lit, around))
        lines = F.col("lines")
        item = F.transform("hits", lambda h: F.struct(*[h[c].alias(c) for c in HIT_FIELDS], F.when(
            h["text"].isNull(), code_context(lines, h["line"], F.get(arounds, h["rix"]))).alias("code")))
        rows = audited.select("repo", "path", *keep, swapped(F.col("content")).alias("swapped"), F.inline_outer(item))
    else:
        rows = audited.select("repo", "path", *keep, swapped(F.col("content")).alias("swapped"), F.inline_outer("hits"))
    rows = rows.where("rix IS NOT NULL")
    # characters that matching swapped out come back in what was captured
    rows = rows.withColumns({c: F.when(F.col("swapped"), F.translate(c, MARK_SUBSTITUTE, MARK)).otherwise(F.col(c)) for c in ("a", "b")})
    named = rows.join(F.broadcast(rules_dim(spark, rules)), "rix")
    suggestion = F.when(F.col("suggestion").isNotNull(), F.struct(
        _fill(F.col("suggestion")).alias("text"), _fill(F.col("suggestion_code")).alias("code")))
    cols = [
        F.col("repo"), F.col("rule_id"), F.col("type"), F.col("severity"), F.col("title"),
        _fill(F.col("description")).alias("description"), F.col("path").alias("file"), F.col("line"),
        *([F.col("code")] if context else []),
        F.col("text").alias("code_text"), suggestion.alias("suggestion"), F.col("ord"), F.col("seq"), *keep,
    ]
    return named.select(*cols)


def findings(
    files: DataFrame, profile: str = "extended", groups: tuple[str, ...] | None = None,
    rules: list[Rule] | None = None, context: bool = False, select: bool = True,
) -> DataFrame:
    """Audit a corpus: one row per finding."""
    rules = profile_rules(profile, groups) if rules is None else rules
    return explode_hits(audit_files(files, profile, rules=rules, select=select), rules, context)
