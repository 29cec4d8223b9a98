"""Detectors that need more than one pattern: state across lines, counts, token uses.

Each detector turns one prepared file row into an array of hits with built-in
higher-order functions; no file is split over rows, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import MARK, js_trim, occurrences, to_java, utf16_len, utf16_prefix
from ..rules.model import Rule
from .match import hit, let, lines_where, mark, marked_lines, matches, rule_hit

# Fixed values.
LINE_LIMIT = 120
SNIPPET_UNITS = 80
FUNCTION_LIMIT = 50
NESTING_LIMIT = 5
DUPLICATE_MIN_LINES = 10
DUPLICATE_WINDOW = 4
DUPLICATE_MIN_CHARS = 20
COMMON_NUMBERS = [80, 443, 8080, 3000, 5000, 8000, 8443, 200, 201, 204, 301, 302, 400, 401, 403, 404, 500, 502, 503,
                  100, 1000, 1024, 10, 16, 32, 64, 128, 256, 512, 60, 24, 365, 255, 65535]
COMMON_NUMBERS_BASIC = [80, 443, 8080, 3000, 5000, 200, 201, 204, 301, 302, 400, 401, 403, 404, 500, 100, 1000]
MAGIC = r"""(?<![.\w'"\\])(\d{2,})(?![.\w'"`])"""
MAGIC_BASIC = r"""(?<![.\w])(?<!['"`])(\d{2,})(?!['"`])(?![.\w])"""
DECLARATION = r"(?:const|let|var|final|val)\s"
TODO = r"\b(TODO|FIXME|HACK|XXX|BUG|OPTIMIZE)\b[:\s]*(.*)"
CODE_WORDS = (r"\b(function|class|if|else|for|while|return|import|export|const|let|var|def|end|do|begin|module|require"
              r"|include|use|package|pub|fn|impl|struct|enum)\b")
COMMENT_NOTES = ["TODO", "FIXME", "NOTE", "HACK"]
BRACE_HEADER = (r"(?:function\s+(\w+)|(?:const|let|var|val|fun|func|fn|def|void|int|string|bool|auto|pub)\s+(\w+)\s*"
                r"(?:\([^)]*\)|=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)))")
BASIC_HEADER = r"(?:function\s+(\w+)|const\s+(\w+)\s*=.*(?:function|=>))"
PYTHON_DEF = r"^(\s*)def\s+(\w+)"
RUBY_DEF = r"^def\s+(\w+)"
RUBY_OPENER = r"^(?:def|class|module|do|if|unless|case|begin|while|until|for)\b"
COUNTING_LOOP = (r"for\s*\(\s*(?:let|var)\s+(\w+)\s*=\s*(\d+)\s*;\s*\1\s*<\s*(\d+)\s*;\s*\1\+\+\s*\)\s*"
                 r"\{[^{}]*(\w+)\s*(?:\+\+|\+=\s*1)[^{}]*\}")
SHORT_NAME = r"(?:let|const|var)\s+([a-z])\s*="
SHORT_NAMES_ALLOWED = ["i", "j", "k", "x", "y", "z", "e", "_"]
EXPORTED = r"export\s+(?:async\s+)?function\s+(\w+)"
JS_DEFINITION = r"(?:const|let|var)\s+(\w+)\s*="
BASIC_DEFINITIONS = [JS_DEFINITION, r"function\s+(\w+)\s*\(", r"(\w+)\s*:\s*(?:function|\([^)]*\)\s*=>)"]
IMPORT_JS = r"import\s+(?:\{([^}]+)\}|(\w+))\s+from"
IMPORT_PYTHON = r"^(?:from\s+\S+\s+)?import\s+(.+)"
IMPORT_JAVA = r"^import\s+(?:static\s+)?([^;]+);"
IMPORT_GO = r"import\s*\(\s*([\s\S]*?)\)"
IMPORT_GO_LINE = r"""(?:(\w+)\s+)?"([^"]+)\""""
IMPORT_RUST = r"use\s+([^;]+);"
USING_CSHARP = r"^using\s+([\w.]+);"
ALIAS = r"\s+as\s+"
FROM_TAGGED = r"^FROM\s+\S+:\S+"
FROM_LATEST = r"^FROM\s+\S+:latest"


def _has_any(c: Column, *literals: str) -> Column:
    cond = F.contains(c, F.lit(literals[0]))
    for x in literals[1:]:
        cond = cond | F.contains(c, F.lit(x))
    return cond


def _has(*literals: str, text: str = "body") -> Column:
    return _has_any(F.col(text), *literals)


def _gated(rule: Rule, cond: Column, value: Column) -> Column:
    if rule.families is not None:
        cond = F.col("family").isin(*rule.families) & cond
    return F.when(cond, value)


def _first(found: Column, cap: int | None) -> Column:
    """The first ``cap`` entries; all of them without a cap."""
    return found if cap is None else F.slice(found, 1, cap)


def _starts(c: Column, *prefixes: str) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | F.startswith(c, F.lit(p))
    return cond


# --- line by line ---------------------------------------------------------------------

def _long_lines(rule: Rule, comment_marks: tuple[str, ...]) -> Column:
    # a text has at least as many bytes as units: most lines need no exact count
    long = lines_where(lambda t: (
        (F.octet_length(t) > LINE_LIMIT)
        & ((F.length(t) > LINE_LIMIT) | (utf16_len(t) > LINE_LIMIT))
        & ~F.contains(t, F.lit("http"))
        & ~_starts(js_trim(t), *comment_marks)))
    return F.transform(long, lambda s: rule_hit(
        rule, s["line"], s["line"], a=utf16_len(s["text"]),
        text=F.concat(utf16_prefix(s["text"], SNIPPET_UNITS), F.lit("..."))))


def long_lines(rules: list[Rule]) -> Column:
    return _long_lines(rules[0], ("//", "#"))


def long_lines_basic(rules: list[Rule]) -> Column:
    return _long_lines(rules[0], ("//",))


def commented(rules: list[Rule]) -> Column:
    """Comment lines that hold code; the first few of a file."""
    rule = rules[0]

    def is_code(line: Column) -> Column:
        t = js_trim(line)
        comment = (
            (F.startswith(t, F.lit("//")) & ~F.startswith(t, F.lit("///")))
            | (F.startswith(t, F.lit("#")) & ~_starts(t, "#!", "#include"))
            | (F.startswith(t, F.lit("--")) & F.coalesce(F.col("comment") == "--", F.lit(False)))
        )
        text = js_trim(F.regexp_replace(t, r"^(?://|#|--)", ""))
        return _has_any(line, "//", "#", "--") & comment & (utf16_len(text) > 5) & ~_starts(
            text, *COMMENT_NOTES) & text.rlike(to_java(CODE_WORDS))

    found = _first(lines_where(is_code), rule.cap)
    return _gated(rule, _has("//", "#", "--"), F.transform(found, lambda s: rule_hit(rule, s["line"], s["line"])))


def missing_set_e(rules: list[Rule]) -> Column:
    rule = rules[0]
    return _gated(rule, (F.size("lines") > 2) & ~_has("set -e"), F.array(rule_hit(rule, F.lit(1), F.lit(1))))


def base_image(rules: list[Rule]) -> Column:
    rule = rules[0]
    body = F.col("body")
    loose = ~body.rlike(to_java(FROM_TAGGED, "m")) | body.rlike(to_java(FROM_LATEST, "m"))
    return _gated(rule, loose, F.array(rule_hit(rule, F.lit(1), F.lit(1))))


# --- matches with captured text -------------------------------------------------------

def todo(rules: list[Rule]) -> Column:
    tags = [r.title.split(" ")[0] for r in rules]

    def of(table: list[int], tag: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in table]), F.array_position(F.array(*map(F.lit, tags)), tag).cast("int"))

    def to_hit(m: Column) -> Column:
        tag = F.upper(m["g1"])
        rest = js_trim(m["g2"])
        return hit(of([r.rix for r in rules], tag), of([r.tkey for r in rules], tag), F.lit(rules[0].ord),
                   m["line"], m["seq"], a=F.when(rest == "", F.lit("(no description)")).otherwise(rest))

    # with some of the tags' rules only, matches of other tags are no findings
    own = F.filter(matches(TODO, "i", (1, 2)), lambda m: F.upper(m["g1"]).isin(*tags))
    return F.when(_has(*[t.lower() for t in tags], text="folded"), F.transform(own, to_hit))


def captured_text(rules: list[Rule]) -> Column:
    """Tagged comments, one pattern per tag."""

    def of(r: Rule) -> Column:
        return F.when(
            _has(*r.needs[:1], text="folded") & _has(*r.needs[1:], text="folded"),
            F.transform(matches(r.pattern, r.flags), lambda m: rule_hit(r, m["line"], m["seq"], a=js_trim(m["g1"]))))

    return F.flatten(F.filter(F.array(*map(of, rules)), lambda p: p.isNotNull()))


def short_names(rules: list[Rule]) -> Column:
    rule = rules[0]
    found = F.filter(matches(SHORT_NAME), lambda m: ~m["g1"].isin(*SHORT_NAMES_ALLOWED))
    return F.when(_has("let", "const", "var") & _has("="),
                  F.transform(found, lambda m: rule_hit(rule, m["line"], m["seq"], a=m["g1"])))


def undocumented_exports(rules: list[Rule]) -> Column:
    rule = rules[0]

    def bare(m: Column) -> Column:
        above = F.when(m["line"] > 1, F.get(F.col("lines"), m["line"] - 2)).otherwise(F.lit(""))
        return ~F.contains(above, F.lit("*/")) & ~F.contains(above, F.lit("//"))

    return F.when(_has("export"), F.transform(
        F.filter(matches(EXPORTED), bare), lambda m: rule_hit(rule, m["line"], m["seq"], a=m["g1"])))


def simplifiable_loop(rules: list[Rule]) -> Column:
    rule = rules[0]

    def runs(m: Column) -> Column:
        return m["g3"].try_cast("decimal(38,0)") - m["g2"].try_cast("decimal(38,0)")

    return F.when(_has("++"), F.transform(
        matches(COUNTING_LOOP, "", (2, 3, 4)),
        lambda m: rule_hit(rule, m["line"], m["seq"], a=runs(m), b=m["g4"])))


def _magic(rule: Rule, pattern: str, common: list[int], skip: Callable[[Column], Column]) -> Column:
    """Numbers that are neither common nor small, on lines that are not skipped."""
    with_numbers = F.filter(
        F.transform(marked_lines(mark(F.col("body"), pattern)), lambda s: F.struct(
            s["line"].alias("line"), F.replace(s["text"], F.lit(MARK), F.lit("")).alias("text"),
            F.transform(
                F.regexp_extract_all(s["text"], F.lit(MARK + r"(\d+)"), F.lit(1)),
                lambda d: F.regexp_replace(d, r"^0+(?=\d)", "")).alias("numbers"))),
        lambda s: ~skip(s["text"]))
    return F.flatten(F.transform(with_numbers, lambda s: F.transform(
        F.filter(s["numbers"], lambda d: ~d.isin(*map(str, common)) & ((F.length(d) > 2) | (F.lpad(d, 2, "0") > "10"))),
        lambda d: rule_hit(rule, s["line"], s["line"], a=d))))


def magic(rules: list[Rule]) -> Column:
    rule = rules[0]
    found = _magic(rule, MAGIC, COMMON_NUMBERS, lambda t: (
        _starts(js_trim(t), "//", "#", "*") | t.rlike(to_java(DECLARATION))))
    return _gated(rule, F.lit(True), F.transform(
        _first(found, rule.cap),
        lambda h, i: hit(h["rix"], h["tkey"], h["ord"], h["line"], i, h["a"])))


def magic_basic(rules: list[Rule]) -> Column:
    rule = rules[0]
    found = _magic(rule, MAGIC_BASIC, COMMON_NUMBERS_BASIC, lambda t: (
        F.contains(t, F.lit("const")) | F.contains(t, F.lit("let")) | F.contains(t, F.lit("var"))
        | _starts(js_trim(t), "//", "*")))
    return F.transform(found, lambda h, i: hit(h["rix"], h["tkey"], h["ord"], h["line"], i, h["a"]))


# --- folds over lines -----------------------------------------------------------------

_IDLE = "named_struct('start', -1, 'name', '', 'depth', 0, 'out', array())"
_FOLD_TYPE = "struct<start:int,name:string,depth:int,out:array<struct<start:int,name:string,len:int>>>"


def _idle() -> Column:
    return F.expr(_IDLE).cast(_FOLD_TYPE)


def _state(start: Column, name: Column, depth: Column, out: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), name.alias("name"), depth.cast("int").alias("depth"),
                    out.alias("out")).cast(_FOLD_TYPE)


def _emit(out: Column, close: Column, start: Column, name: Column, length: Column) -> Column:
    item = F.struct(start.cast("int").alias("start"), name.alias("name"), length.cast("int").alias("len"))
    return F.when(close & (length > FUNCTION_LIMIT), F.concat(out, F.array(item))).otherwise(out)


def _long_hits(rule: Rule, found: Column, snippet: Callable[[Column, Column], Column]) -> Column:
    return F.transform(found["out"], lambda f: rule_hit(
        rule, f["start"] + 1, f["start"] + 1, a=f["name"], b=f["len"], text=snippet(f["name"], f["len"].cast("string"))))


def _brace_fold(header: str, closes: Callable[[Column], Column]) -> Column:
    """Functions found by a header line and the brace balance that follows it."""
    java = to_java(header)

    def name_of(t: Column) -> Column:
        first = F.regexp_extract(t, java, 1)
        return F.when(t.rlike(java), F.when(first != "", first).otherwise(F.regexp_extract(t, java, 2)))

    steps = F.transform(F.col("lines"), lambda t, i: F.struct(
        i.alias("i"), name_of(t).alias("name"), (occurrences(t, "{") - occurrences(t, "}")).alias("delta")))

    def step(acc: Column, s: Column) -> Column:
        opens = (acc["start"] == -1) & s["name"].isNotNull()
        start = F.when(opens, s["i"]).otherwise(acc["start"])
        name = F.when(opens, s["name"]).otherwise(acc["name"])
        depth = F.when(start == -1, F.lit(0)).otherwise(F.when(opens, F.lit(0)).otherwise(acc["depth"]) + s["delta"])
        close = (start != -1) & closes(depth) & (s["i"] > start)
        return _state(F.when(close, F.lit(-1)).otherwise(start), name, depth,
                      _emit(acc["out"], close, start, name, s["i"] - start + 1))

    return F.aggregate(steps, _idle(), step)


def _call_snippet(name: Column, length: Column) -> Column:
    return F.concat(F.lit("function "), name, F.lit("() { ... } // "), length, F.lit(" lines"))


def long_brace(rules: list[Rule]) -> Column:
    rule = rules[0]
    return _gated(rule, F.size("lines") > FUNCTION_LIMIT,
                  let(_brace_fold(BRACE_HEADER, lambda d: d <= 0), lambda f: _long_hits(rule, f, _call_snippet)))


def long_basic(rules: list[Rule]) -> Column:
    rule = rules[0]
    return _gated(rule, (F.size("lines") > FUNCTION_LIMIT) & _has("function", "=>"),
                  let(_brace_fold(BASIC_HEADER, lambda d: d == 0), lambda f: _long_hits(rule, f, _call_snippet)))


def long_python(rules: list[Rule]) -> Column:
    rule = rules[0]
    java = to_java(PYTHON_DEF)
    lead = to_java(r"^\s*")
    steps = F.transform(F.col("lines"), lambda t, i: F.struct(
        i.alias("i"),
        F.when(F.contains(t, F.lit("def")), F.nullif(F.regexp_extract(t, java, 2), F.lit(""))).alias("name"),
        F.length(F.regexp_extract(t, lead, 0)).alias("indent"),
        ((js_trim(t) != "") & ~_starts(js_trim(t), "#", "@")).alias("solid")))

    def step(acc: Column, s: Column) -> Column:
        defines = s["name"].isNotNull()
        close = (acc["start"] != -1) & (defines | (s["solid"] & (s["indent"] <= acc["depth"])))
        return _state(
            F.when(defines, s["i"]).when(close, F.lit(-1)).otherwise(acc["start"]),
            F.when(defines, s["name"]).otherwise(acc["name"]),
            F.when(defines, s["indent"]).otherwise(acc["depth"]),
            _emit(acc["out"], close, acc["start"], acc["name"], s["i"] - acc["start"]))

    def snippet(name: Column, length: Column) -> Column:
        return F.concat(F.lit("def "), name, F.lit("(...): # "), length, F.lit(" lines"))

    return _gated(rule, (F.size("lines") > FUNCTION_LIMIT) & _has("def"),
                  let(F.aggregate(steps, _idle(), step), lambda f: _long_hits(rule, f, snippet)))


def long_ruby(rules: list[Rule]) -> Column:
    rule = rules[0]
    java = to_java(RUBY_DEF)
    trimmed = F.transform(F.col("lines"), js_trim)
    steps = F.transform(trimmed, lambda t, i: F.struct(
        i.alias("i"), F.nullif(F.regexp_extract(t, java, 1), F.lit("")).alias("name"),
        (t.rlike(to_java(RUBY_OPENER)).cast("int") - (t == "end").cast("int")).alias("delta")))

    def step(acc: Column, s: Column) -> Column:
        defines = s["name"].isNotNull()
        depth = F.when(defines, F.lit(1)).otherwise(acc["depth"] + s["delta"])
        close = ~defines & (acc["start"] != -1) & (depth == 0)
        return _state(
            F.when(defines, s["i"]).when(close, F.lit(-1)).otherwise(acc["start"]),
            F.when(defines, s["name"]).otherwise(acc["name"]), depth,
            _emit(acc["out"], close, acc["start"], acc["name"], s["i"] - acc["start"] + 1))

    def snippet(name: Column, length: Column) -> Column:
        return F.concat(F.lit("def "), name, F.lit(" ... end # "), length, F.lit(" lines"))

    return _gated(rule, (F.size("lines") > FUNCTION_LIMIT) & _has("def"),
                  let(F.aggregate(steps, _idle(), step), lambda f: _long_hits(rule, f, snippet)))


def nesting(rules: list[Rule]) -> Column:
    """First line on which the brace balance exceeds the limit."""
    rule = rules[0]
    steps = F.transform(F.col("lines"), lambda t, i: F.struct(
        (i + 1).alias("line"), (occurrences(t, "{") - occurrences(t, "}")).alias("delta")))

    def step(acc: Column, s: Column) -> Column:
        depth = acc["depth"] + s["delta"]
        found = acc["line"] > 0
        return F.struct(
            F.when(found, acc["depth"]).otherwise(depth).cast("int").alias("depth"),
            F.when(found, acc["line"]).when(depth > NESTING_LIMIT, s["line"]).otherwise(F.lit(0)).cast("int").alias("line"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("line"))
    deepest = let(F.aggregate(steps, start, step), lambda f: F.when(
        f["line"] > 0, F.array(rule_hit(rule, f["line"], f["line"], a=f["depth"]))))
    slashes = F.coalesce(F.col("comment") == "//", F.lit(False))
    return F.when(slashes & (occurrences(F.col("body"), "{") > NESTING_LIMIT), deepest)


def duplicate_block(rules: list[Rule]) -> Column:
    """First four-line window that repeats an earlier one of the same file."""
    rule = rules[0]

    def windows(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(t) - DUPLICATE_WINDOW)
        return F.transform(starts, lambda i: F.struct(
            F.concat_ws("|", *[F.get(t, i + k) for k in range(DUPLICATE_WINDOW)]).alias("block"), i.alias("i")))

    def first_repeat(w: Column) -> Column:
        # equal blocks are neighbours, the earliest first; only repeats need the length test
        return F.array_min(F.transform(w, lambda x, k: F.when(
            (k > 0) & (F.get(w, k - 1)["block"] == x["block"])
            & (utf16_len(F.regexp_replace(x["block"], to_java(r"\s"), "")) >= DUPLICATE_MIN_CHARS),
            F.struct(x["i"].alias("i"), F.get(w, k - 1)["i"].alias("first")))))

    def report(w: Column) -> Column:
        some = F.size(F.array_distinct(F.transform(w, lambda x: x["block"]))) < F.size(w)
        return F.when(some, let(let(F.sort_array(w), first_repeat), lambda r: F.when(r.isNotNull(), F.array(rule_hit(
            rule, r["i"] + 1, r["i"] + 1, a=r["first"] + 1, b=r["first"] + DUPLICATE_WINDOW)))))

    def repeated(t: Column) -> Column:
        # every line of a repeated window is itself a repeat
        return F.when(F.size(t) - F.size(F.array_distinct(t)) >= DUPLICATE_WINDOW, let(windows(t), report))

    return _gated(rule, F.size("lines") >= DUPLICATE_MIN_LINES, let(F.transform(F.col("lines"), js_trim), repeated))


# --- names that are never used --------------------------------------------------------

def unused_names(rules: list[Rule]) -> Column:
    """Names defined or imported that occur at most once as a whole word of the file.

    The candidates of all rules and the words of the file are sorted together, so that
    each name is followed by its occurrences: one sort per file instead of one scan per
    name.  Names that are not plain words are counted literally.
    """
    body = F.col("body")
    by_detector = {r.detector: [r] for r in rules}
    parts = F.array(*[CANDIDATES[name](rs) for name, rs in by_detector.items()])
    candidates = F.flatten(F.filter(parts, lambda p: p.isNotNull()))

    def to_hit(c: Column) -> Column:
        return hit(c["rix"], c["tkey"], c["ord"], c["line"], c["seq"], a=c["a"])

    def plain(cs: Column) -> Column:
        return let(F.transform(F.filter(cs, lambda c: c["name"].rlike(r"^\w+$")), lambda c: F.struct(
            c["name"].alias("t"), F.lit(0).alias("k"), c.alias("c"))), unused)

    def unused(names: Column) -> Column:
        wanted = F.transform(names, lambda n: n["t"])
        every = F.regexp_extract_all(body, F.lit(r"(\w+)"), F.lit(1))
        # few names: keep only their own words, which leaves little to sort (the result is the same, see the tests)
        few = let(wanted, lambda ws: F.filter(every, lambda w: F.array_contains(ws, w)))
        words = F.transform(F.when(F.size(names) <= FEW_NAMES, few).otherwise(every), lambda w: F.struct(
            w.alias("t"), F.lit(1).alias("k"), F.lit(None).cast(CANDIDATE).alias("c")))

        def once(s: Column) -> Column:
            def at(i: Column, k: int) -> Column:
                return F.get(s, i + k)

            return F.filter(s, lambda x, i: (x["k"] == 0) & ~F.coalesce(
                (at(i, 1)["t"] == x["t"]) & ((at(i, 1)["k"] == 0) | (at(i, 2)["t"] == x["t"])), F.lit(False)))

        return F.when(F.size(names) > 0, F.transform(
            let(F.sort_array(F.concat(names, words)), once), lambda x: to_hit(x["c"])))

    def odd(cs: Column) -> Column:
        edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
        rare = F.filter(cs, lambda c: ~c["name"].rlike(r"^\w+$") & (F.regexp_count(body, F.concat(
            F.lit(edge + r"\Q"), F.replace(c["name"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E" + edge))) <= 1))
        return F.transform(rare, to_hit)

    return let(candidates, lambda cs: F.concat(F.coalesce(plain(cs), F.array().cast(HITS)), odd(cs)))


# Up to this many names, words are looked up in the names; beyond, all words are sorted.
FEW_NAMES = 64
CANDIDATE = "struct<seq:int,line:int,name:string,a:string,rix:int,tkey:int,ord:int>"
HITS = "array<struct<line:int,tkey:int,ord:int,seq:int,rix:int,a:string,b:string,text:string>>"


def _candidate(rule: Rule, seq: Column, line: Column, name: Column, a: Column | None = None) -> Column:
    return F.struct(
        seq.cast("int").alias("seq"), line.cast("int").alias("line"), name.alias("name"),
        (name if a is None else a).alias("a"), F.lit(rule.rix).alias("rix"), F.lit(rule.tkey).alias("tkey"),
        F.lit(rule.ord).alias("ord"))


def _spread(rule: Rule, found: Column, names: Callable[[Column], Column]) -> Column:
    """One candidate per name of an import clause, numbered in order of appearance."""
    each = F.flatten(F.transform(found, lambda m: F.transform(
        F.filter(names(m), lambda n: n != ""), lambda n: F.struct(m["line"].alias("line"), n.alias("name")))))
    return F.transform(each, lambda c, i: _candidate(rule, i, c["line"], c["name"]))


def _last(parts: Column) -> Column:
    return js_trim(F.element_at(parts, -1))


def _js_clause(m: Column) -> Column:
    return F.split(F.when(m["g1"] != "", m["g1"]).otherwise(m["g2"]), ",")


def unused_vars_js(rules: list[Rule]) -> Column:
    rule = rules[0]
    found = F.filter(matches(JS_DEFINITION), lambda m: ~F.startswith(m["g1"], F.lit("_")))
    return _gated(rule, _has("const", "let", "var") & _has("="),
                  F.transform(found, lambda m: _candidate(rule, m["seq"], m["line"], m["g1"])))


def unused_vars_basic(rules: list[Rule]) -> Column:
    rule = rules[0]
    gates = [_has("const", "let", "var") & _has("="), _has("function"), _has(":") & _has("function", "=>")]
    none = F.expr("cast(array() as array<struct<seq:int,line:int,g1:string>>)")
    parts = [F.when(g, matches(p)).otherwise(none) for g, p in zip(gates, BASIC_DEFINITIONS)]
    found = F.filter(F.concat(*parts), lambda m: ~F.startswith(m["g1"], F.lit("_")))
    return F.transform(found, lambda m, i: _candidate(rule, i, m["line"], m["g1"]))


def imports_js(rules: list[Rule]) -> Column:
    rule = rules[0]
    return _gated(rule, _has("import") & _has("from"), _spread(
        rule, matches(IMPORT_JS, "", (1, 2)),
        lambda m: F.transform(_js_clause(m), lambda s: _last(F.split(js_trim(s), to_java(ALIAS))))))


def imports_basic(rules: list[Rule]) -> Column:
    rule = rules[0]
    return _gated(rule, _has("import") & _has("from"), _spread(
        rule, matches(IMPORT_JS, "", (1, 2)),
        lambda m: F.transform(_js_clause(m), lambda s: _last(F.split(js_trim(s), " as ")))))


def imports_python(rules: list[Rule]) -> Column:
    rule = rules[0]
    return _gated(rule, _has("import"), _spread(
        rule, matches(IMPORT_PYTHON, "m"),
        lambda m: F.filter(
            F.transform(F.split(m["g1"], ","), lambda s: _last(F.split(js_trim(s), to_java(ALIAS)))),
            lambda n: n != "*")))


def imports_java(rules: list[Rule]) -> Column:
    rule = rules[0]
    found = F.transform(matches(IMPORT_JAVA, "m"), lambda m: _candidate(
        rule, m["seq"], m["line"], F.element_at(F.split(js_trim(m["g1"]), r"\."), -1), js_trim(m["g1"])))
    return _gated(rule, _has("import"), F.filter(found, lambda c: c["name"] != "*"))


def imports_go(rules: list[Rule]) -> Column:
    rule = rules[0]
    line = to_java(IMPORT_GO_LINE)

    def specs(m: Column) -> Column:
        quoted = F.filter(F.split(m["g1"], "\n"), lambda t: t.rlike(line))
        return F.transform(quoted, lambda t: F.struct(
            m["line"].alias("line"), F.regexp_extract(t, line, 1).alias("alias"),
            F.regexp_extract(t, line, 2).alias("path")))

    each = F.flatten(F.transform(matches(IMPORT_GO), specs))
    found = F.transform(each, lambda s, i: _candidate(
        rule, i, s["line"],
        F.when(s["alias"] != "", s["alias"]).otherwise(F.element_at(F.split(s["path"], "/"), -1)), s["path"]))
    return _gated(rule, _has("import"), F.filter(found, lambda c: c["name"] != "_"))


def imports_rust(rules: list[Rule]) -> Column:
    rule = rules[0]

    def name_of(full: Column) -> Column:
        return js_trim(F.regexp_replace(F.element_at(F.split(full, "::"), -1), r"[{}]", ""))

    found = F.transform(matches(IMPORT_RUST), lambda m: _candidate(
        rule, m["seq"], m["line"], name_of(js_trim(m["g1"])), js_trim(m["g1"])))
    return _gated(rule, _has("use"), F.filter(found, lambda c: ~c["name"].isin("", "*", "self")))


def usings_csharp(rules: list[Rule]) -> Column:
    rule = rules[0]
    found = F.transform(
        F.filter(matches(USING_CSHARP, "m"), lambda m: ~F.startswith(m["g1"], F.lit("System"))),
        lambda m: _candidate(rule, m["seq"], m["line"], F.element_at(F.split(m["g1"], r"\."), -1), m["g1"]))
    return _gated(rule, _has("using"), found)


CANDIDATES: dict[str, Callable[[list[Rule]], Column]] = {
    f.__name__: f for f in [
        unused_vars_js, unused_vars_basic, imports_js, imports_basic, imports_python, imports_java, imports_go,
        imports_rust, usings_csharp,
    ]
}

DETECTORS: dict[str, Callable[[list[Rule]], Column]] = {
    f.__name__: f for f in [
        long_lines, long_lines_basic, commented, missing_set_e, base_image, todo, captured_text, short_names,
        undocumented_exports, simplifiable_loop, magic, magic_basic, long_brace, long_basic, long_python, long_ruby,
        nesting, duplicate_block,
    ]
}
