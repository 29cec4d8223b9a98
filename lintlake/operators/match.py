"""Match mechanics shared by all rules.

Everything is a projection over one file row.  A prepared row has ``content``, ``body``
(content without the marker character), ``folded`` (lower-cased body), ``lines``,
``family`` and ``comment``.  A marker is put in front of each match with one
``regexp_replace``; the lines that then hold a marker are the findings' lines, so
locating all matches of a rule is linear in the size of the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARK, line_array, to_java, without_mark
from ..rules.model import Rule

# Ends the note after a marker; only looked for right behind a marker.
STOP = "\u0006"

# A line that looks like one of these defines a pattern itself.
_REGEX_LITERAL = r"/[^/]+/"
_PATTERN_WORD = r"pattern|push\s*\(\s*\{|pats\.push|funcs\.push"
_PATTERN_LINES = [
    r"^\s*\{?\s*pattern\s*:",
    r"(?:const|let|var)\s+\w+(?:Pat(?:tern)?|Re(?:gex)?)\s*=\s*/",
    r"new\s+RegExp\s*\(",
    r"\.push\s*\(\s*\{.*pattern\s*:",
    r"\{\s*pattern\s*:\s*/",
]


def prepare(files: DataFrame) -> DataFrame:
    """Add the columns every rule works on."""
    return (
        files.withColumn("body", without_mark(F.col("content")))
        .withColumn("folded", F.lower("body"))
        .withColumn("lines", line_array(F.col("content")))
    )


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``fn``."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def gate(rule: Rule) -> str:
    """Cheap test that runs before the regex: language family, then required literals."""
    tests = []
    if rule.families is not None:
        tests.append(f"family IN ({', '.join(map(sql_text, rule.families))})")
    text = "folded" if "i" in rule.flags else "body"
    for group in rule.needs:
        # a need that is itself a bar would split into nothing
        options = [o for o in group.split("|") if o] or [group]
        tests.append("(" + " OR ".join(f"contains({text}, {sql_text(o)})" for o in options) + ")")
    return " AND ".join(tests) or "true"


def marked_rule(rule: Rule) -> Column:
    """Marked text of one pattern rule, null where its gate is closed.

    Built as SQL text: one call into the JVM per rule instead of a dozen.
    """
    if rule.linear is not None:
        # real matches become MARK, group 1, STOP; failed attempts MARK, STOP
        tried = f"regexp_replace(body, {sql_text(to_java(rule.linear, rule.flags))}, {sql_text(MARK + '$1' + STOP + '$0')})"
        marked = f"regexp_replace(replace({tried}, {sql_text(MARK + STOP)}, ''), {sql_text(f'{MARK}[^{STOP}]{STOP}')}, {sql_text(MARK)})"
    else:
        marked = f"regexp_replace(body, {sql_text(to_java(rule.pattern, rule.flags))}, {sql_text(MARK + '$0')})"
    if rule.drop is not None:
        excluded = f"{MARK}(?={to_java(rule.drop, rule.flags)})"
        marked = f"regexp_replace({marked}, {sql_text(excluded)}, '')"
    return F.expr(
        f"named_struct('rix', {rule.rix}, 'tkey', {rule.tkey}, 'ord', {rule.ord}, 'suppress', {str(rule.suppress).lower()}, "
        f"'marked', CASE WHEN {gate(rule)} THEN {marked} END)")


def mark(body: Column, pattern: str, flags: str = "") -> Column:
    """Text with a marker before each non-overlapping match, left to right."""
    return F.regexp_replace(body, F.lit(to_java(pattern, flags)), F.lit(MARK + "$0"))


def marked_lines(marked: Column) -> Column:
    """The lines that hold a marker: array<struct<line, text>>, text still marked."""
    numbered = F.transform(F.split(marked, "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    return F.filter(numbered, lambda s: F.contains(s["text"], F.lit(MARK)))


def defines_pattern(line: Column) -> Column:
    """Does the line look like the definition of a rule or a regular expression?"""
    test = line.rlike(to_java(_REGEX_LITERAL)) & line.rlike(to_java(_PATTERN_WORD))
    for p in _PATTERN_LINES:
        test = test | line.rlike(to_java(p))
    return test


def hit(
    rix: Column, tkey: Column, ord_: Column, line: Column, seq: Column,
    a: Column | None = None, b: Column | None = None, text: Column | None = None,
) -> Column:
    """One raw finding; ``a``/``b`` fill the rule's texts, ``text`` is a ready snippet."""
    none = F.lit(None).cast("string")
    return F.struct(
        line.cast("int").alias("line"), tkey.cast("int").alias("tkey"), ord_.cast("int").alias("ord"),
        seq.cast("int").alias("seq"), rix.cast("int").alias("rix"),
        (none if a is None else a.cast("string")).alias("a"),
        (none if b is None else b.cast("string")).alias("b"),
        (none if text is None else text.cast("string")).alias("text"),
    )


def rule_hit(rule: Rule, line: Column, seq: Column, a=None, b=None, text=None) -> Column:
    return hit(F.lit(rule.rix), F.lit(rule.tkey), F.lit(rule.ord), line, seq, a, b, text)


def pattern_hits(rules: list[Rule]) -> Column:
    """Hits of all plain pattern rules in one projection: one scan of the file column."""
    marked = F.array(*[marked_rule(r) for r in rules])
    found = F.filter(marked, lambda e: F.contains(e["marked"], F.lit(MARK)))

    def lines_of(e: Column) -> Column:
        kept = F.filter(
            marked_lines(e["marked"]),
            lambda s: ~(e["suppress"] & defines_pattern(F.replace(s["text"], F.lit(MARK), F.lit("")))),
        )
        return F.transform(kept, lambda s: hit(e["rix"], e["tkey"], e["ord"], s["line"], s["line"]))

    return F.flatten(F.transform(found, lines_of))


def match_lines(marked: Column) -> Column:
    """Start line of every match, one entry per match."""
    return F.flatten(F.transform(
        marked_lines(marked),
        lambda s: F.array_repeat(s["line"], F.length(s["text"]) - F.length(F.replace(s["text"], F.lit(MARK), F.lit("")))),
    ))


def matches(pattern: str, flags: str = "", groups: tuple[int, ...] = (1,)) -> Column:
    """All matches with captured text: array<struct<seq, line, g1, ...>>."""
    body = F.col("body")
    java = F.lit(to_java(pattern, flags))

    def located(marked: Column) -> Column:
        parts = F.struct(
            match_lines(marked).alias("line"),
            *[F.regexp_extract_all(body, java, F.lit(g)).alias(f"g{g}") for g in groups],
        )
        rows = let(parts, lambda p: F.transform(p["line"], lambda line, i: F.struct(
            i.alias("seq"), line.alias("line"), *[F.get(p[f"g{g}"], i).alias(f"g{g}") for g in groups])))
        # most files have no match: leave it at one scan for them
        empty = F.expr(f"cast(array() as array<struct<seq:int,line:int,{','.join(f'g{g}:string' for g in groups)}>>)")
        return F.when(F.contains(marked, F.lit(MARK)), rows).otherwise(empty)

    return let(mark(body, pattern, flags), located)


def lines_where(test: Callable[[Column], Column]) -> Column:
    """Numbered lines that pass a test: array<struct<line, text>>."""
    return F.filter(
        F.transform(F.col("lines"), lambda t, i: F.when(test(t), F.struct((i + 1).alias("line"), t.alias("text")))),
        lambda s: s.isNotNull())


def code_context(lines: Column, line: Column, around: Column) -> Column:
    """The line and its neighbours, clamped to the file."""
    start = F.greatest(F.lit(0), line - around - 1)
    end = F.least(F.size(lines), line + around)
    return F.transform(
        F.slice(lines, start + 1, end - start),
        lambda text, i: F.struct(
            (start + i + 1).cast("int").alias("number"), text.alias("content"),
            ((start + i + 1) == line).alias("highlight")),
    )
