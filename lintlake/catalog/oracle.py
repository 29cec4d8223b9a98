"""Independent SQL for every query that SQL can express (checked with another engine).

Rule patterns and texts are shared fixed values; the mechanics are not: here matches are
enumerated as rows with the text before and after them, lines are rows, functions are
followed by a recursive query, words are counted by a join, duplicates go by windows.
"""

from __future__ import annotations

from ..functions.paths import GRADES, TIME_UNITS
from ..functions.text import to_re2
from ..operators import detectors as D
from ..operators.match import _PATTERN_LINES, _PATTERN_WORD, _REGEX_LITERAL
from ..operators.scoring import CAPS, POINTS, SCORE_NAMES, WEIGHTS
from ..rules import profile_rules
from ..rules.model import Rule
from ..sources import dims
from .snippets import PATH_CASES, PREPENDED, SNIPPETS

NL, BEL = "chr(10)", "chr(7)"
WS = to_re2(r"\s")


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def values(name: str, cols: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"{name}({cols}) AS (SELECT * FROM (VALUES {body}) AS v({cols}))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def re2(pattern: str, flags: str = "") -> str:
    return lit(to_re2(pattern, flags))


def units(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def inlist(items) -> str:
    return "(" + ", ".join(map(lit, items)) + ")"


# --- files ----------------------------------------------------------------------------

FILES = [
    values("snippets", "k, suffix, body, pre", [(i, s, b, i in PREPENDED) for i, (s, b) in enumerate(SNIPPETS)]),
    f"""files AS (
  SELECT 'r' || (doc_id % 5) AS repo,
    'src/d' || (doc_id % 7) || '/f' || doc_id || CASE WHEN starts_with(suffix, '.') THEN suffix ELSE '/' || suffix END AS path,
    CASE WHEN pre THEN body || {NL} || text ELSE text || {NL} || body END AS content
  FROM documents JOIN snippets ON doc_id % {len(SNIPPETS)} = k
  UNION ALL
  SELECT 'web', 'site/p' || page_id || '.html', html FROM pages)""",
]
DIMS = [
    values("ext_dim", "key, name, family, comment", dims.EXTENSIONS),
    values("file_dim", "key, name, family, comment", dims.FILE_NAMES),
    values("basic_dim", "key, name", dims.BASIC_EXTENSIONS),
]
BASE = "split_part(path, '/', -1)"
LAST_EXT = f"lower(regexp_extract({BASE}, '^(?s:.+)(\\.[^.]*)$', 1))"


def classified(source: str, profile: str) -> str:
    if profile == "basic":
        return f"""SELECT s.*, coalesce(b.name, 'Other') AS language, CAST(NULL AS VARCHAR) AS family, CAST(NULL AS VARCHAR) AS comment
  FROM {source} s LEFT JOIN basic_dim b ON b.key = CASE WHEN contains(s.path, '.') THEN '.' || lower(split_part(s.path, '.', -1)) ELSE '' END"""
    return f"""SELECT s.*, coalesce(f.name, c.name, e.name, 'Other') AS language, coalesce(f.family, c.family, e.family, 'other') AS family,
    CASE WHEN f.key IS NOT NULL THEN f.comment WHEN c.key IS NOT NULL THEN c.comment ELSE e.comment END AS comment
  FROM (SELECT *, {BASE} AS base, {LAST_EXT} AS lext FROM {source}) s
  LEFT JOIN file_dim f ON f.key = s.base
  LEFT JOIN ext_dim c ON contains(s.base, '.') AND c.key = substr(s.base, instr(s.base, '.'))
  LEFT JOIN ext_dim e ON e.key = s.lext"""


def reasons(source: str, profile: str) -> str:
    """Inventory with skip_reason and ignored_root."""
    if profile == "basic":
        ignored = " OR ".join(f"contains(path, {lit(p)})" for p in dims.BASIC_IGNORED)
        binary = " OR ".join(f"ends_with(lower(path), {lit(p)})" for p in dims.BASIC_BINARY)
        known = " OR ".join(f"ends_with(path, {lit(p)})" for p in dims.BASIC_SUPPORTED)
        return f"""SELECT *, CAST(NULL AS VARCHAR) AS ignored_root,
    CASE WHEN {ignored} THEN 'ignored' WHEN {binary} THEN 'binary' WHEN NOT ({known}) THEN 'unsupported' END AS skip_reason FROM {source}"""
    inner = f"({classified(source, 'extended')})"
    if profile == "remote":
        return f"""SELECT *, CAST(NULL AS VARCHAR) AS ignored_root,
    CASE WHEN family = 'other' THEN 'unknown_language' WHEN coalesce(size_bytes, 0) > 1048576 THEN 'too_big' END AS skip_reason FROM {inner}"""
    suffixes = " OR ".join(f"ends_with(lower(base), {lit(s)})" for s in dims.BUNDLE_SUFFIXES)
    return f"""SELECT *, CASE WHEN ignored_root IS NOT NULL THEN 'ignored_dir'
      WHEN lext IN {inlist(dims.BINARY_EXTENSIONS)} OR lower(base) IN {inlist(dims.LOCK_FILES)} OR {suffixes} THEN 'binary'
      WHEN family = 'other' THEN 'unknown_language' WHEN coalesce(size_bytes, 0) > 1048576 THEN 'too_big' END AS skip_reason
  FROM (SELECT q.*, (SELECT min_by(array_to_string(string_split(q.path, '/')[1:i], '/'), i)
      FROM unnest(range(1, len(string_split(q.path, '/')))) AS t(i)
      WHERE string_split(q.path, '/')[i] IN {inlist(dims.IGNORED_DIRS)} OR starts_with(string_split(q.path, '/')[i], '.')) AS ignored_root
    FROM {inner} q)"""


def selected(profile: str) -> list[str]:
    sized = "sized AS (SELECT *, strlen(content) AS size_bytes FROM files)"
    return [*FILES, *DIMS, sized, f"reasoned AS ({reasons('sized', profile)})",
            f"chosen AS (SELECT repo, path, replace(content, {BEL}, chr(1)) AS content FROM reasoned WHERE skip_reason IS NULL)",
            f"sel AS MATERIALIZED (SELECT repo, path, content, language, family, comment, string_split(content, {NL}) AS ls FROM ({classified('chosen', profile)}))"]


INVENTORY = [
    values("paths", "k, case_path", list(enumerate(PATH_CASES))),
    f"""inventory AS (SELECT 'r' || (doc_id % 5) AS repo, 'p' || doc_id || '/' || case_path AS path, n_chars * 200 AS size_bytes
  FROM documents JOIN paths ON doc_id % {len(PATH_CASES)} = k)""",
]


def with_(ctes: list[str], query: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + query


# --- matches --------------------------------------------------------------------------

def match_rows(pattern: str, flags: str = "", families=None) -> str:
    """One row per match: number, line, text before (pre) and from the match on (suf)."""
    gate = f"family IN {inlist(families)} AND " if families else ""
    p = re2(pattern, flags)
    return f"""(SELECT repo, path, k, ls, pre, suf, CAST(1 + length(pre) - length(replace(pre, {NL}, '')) AS INTEGER) AS line FROM (
    SELECT repo, path, ls, i AS k, array_to_string(ps[1:i], '') AS pre, array_to_string(ps[i+1:], '') AS suf FROM (
      SELECT repo, path, ls, string_split(regexp_replace(content, {p}, {BEL} || '\\0', 'g'), {BEL}) AS ps FROM sel
      WHERE {gate}regexp_matches(content, {p})) x, unnest(range(1, len(x.ps))) AS t(i)))"""


def group_of(pattern: str, flags: str, n: int) -> str:
    return f"regexp_extract(suf, {lit(_anchored(pattern, flags))}, {n})"


def _anchored(pattern: str, flags: str) -> str:
    # RE2 takes the case flag in front, before the anchor
    p = to_re2(pattern, flags)
    return "(?i)^(?:" + p[4:] + ")" if p.startswith("(?i)") else "^(?:" + p + ")"


# Patterns whose look-ahead becomes a condition on the text after the match.
_LOOKAHEAD = {
    "SEC-60": (r"yaml\.load\s*\([^)]*\)", "Loader"),
    "PERF-17": (r"malloc\s*\([^)]+\)", "free"),
    "Q-14": (r"^RUN\s+apt-get\s+install", "--no-install-recommends"),
}


def pattern_sql(r: Rule) -> str:
    cond = "true"
    pattern, flags = r.pattern, r.flags
    if r.id in _LOOKAHEAD:
        pattern, word = _LOOKAHEAD[r.id]
        cond = f"NOT regexp_matches(suf, {lit('^(?:' + to_re2(pattern, flags) + ')' + '[^' + chr(92) + 'n' + chr(92) + 'r]*' + word)})"
    elif r.id in ("SEC-40", "B-20"):
        pattern = r"\.innerHTML\s*="
        quoted = "['\"`]<" if r.id == "SEC-40" else "['\"`]"
        cond = f"NOT regexp_matches(suf, {lit('^' + to_re2(pattern) + quoted)})"
    elif r.drop is not None:
        cond = f"NOT regexp_matches(suf, {lit('^(?:' + to_re2(r.drop) + ')')})"
    if r.suppress:
        line = "ls[line]"
        tests = [f"(regexp_matches({line}, {re2(_REGEX_LITERAL)}) AND regexp_matches({line}, {re2(_PATTERN_WORD)}))"]
        tests += [f"regexp_matches({line}, {re2(p)})" for p in _PATTERN_LINES]
        cond += " AND NOT (" + " OR ".join(tests) + ")"
    return hit_sql(r, match_rows(pattern, flags, r.families), "line", "k", cond=cond)


def hit_sql(r: Rule, source: str, line: str, seq: str, a: str = "NULL", b: str = "NULL", text: str = "NULL", cond: str = "true") -> str:
    return f"""SELECT repo, path, CAST({line} AS INTEGER) AS line, CAST({seq} AS BIGINT) AS seq, {r.rix} AS rix, {r.ord} AS ord, {r.tkey} AS tkey,
  CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, CAST({text} AS VARCHAR) AS code_text FROM {source} WHERE {cond}"""


def gated_lines(r: Rule) -> str:
    gate = f" AND family IN {inlist(r.families)}" if r.families else ""
    return f"""(SELECT repo, path, comment, t.text AS text, CAST(t.n AS INTEGER) AS line, content, len(ls) AS n_lines
  FROM sel, unnest(ls) WITH ORDINALITY AS t(text, n) WHERE true{gate})"""


# --- detectors ------------------------------------------------------------------------

def d_long_lines(r: Rule, marks=("//", "#")) -> str:
    spared = " OR ".join(f"starts_with({trim('text')}, {lit(m)})" for m in marks)
    return hit_sql(r, gated_lines(r), "line", "line", a=units("text"), cond=f"{units('text')} > 120 AND NOT ({spared}) AND NOT contains(text, 'http')")


def d_commented(r: Rule) -> str:
    t = trim("text")
    src = f"""(SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS rn FROM (
    SELECT *, {trim("regexp_replace(tt, '^(?://|#|--)', '')")} AS body FROM (SELECT *, {t} AS tt FROM {gated_lines(r)})
    WHERE (starts_with(tt, '//') AND NOT starts_with(tt, '///'))
      OR (starts_with(tt, '#') AND NOT starts_with(tt, '#!') AND NOT starts_with(tt, '#include'))
      OR (starts_with(tt, '--') AND comment = '--'))
  WHERE regexp_matches(body, {re2(D.CODE_WORDS)}) AND {units('body')} > 5 AND NOT regexp_matches(body, '^(?:TODO|FIXME|NOTE|HACK)'))"""
    return hit_sql(r, src, "line", "line", cond="rn <= 5")


def d_set_e(r: Rule) -> str:
    return hit_sql(r, "sel", "1", "1", cond=f"family IN {inlist(r.families)} AND len(ls) > 2 AND NOT contains(content, 'set -e')")


def d_base_image(r: Rule) -> str:
    return hit_sql(r, "sel", "1", "1", cond=f"family IN {inlist(r.families)} AND (NOT regexp_matches(content, {re2(D.FROM_TAGGED, 'm')}) OR regexp_matches(content, {re2(D.FROM_LATEST, 'm')}))")


def d_todo(r: Rule) -> str:
    rest = trim(group_of(D.TODO, "i", 2))
    return hit_sql(r, match_rows(D.TODO, "i"), "line", "k", a=f"coalesce(nullif({rest}, ''), '(no description)')",
                   cond=f"upper({group_of(D.TODO, 'i', 1)}) = {lit(r.title.split(' ')[0])}")


def d_captured(r: Rule) -> str:
    return hit_sql(r, match_rows(r.pattern, r.flags), "line", "k", a=trim(group_of(r.pattern, r.flags, 1)))


def d_short_names(r: Rule) -> str:
    g = group_of(D.SHORT_NAME, "", 1)
    return hit_sql(r, match_rows(D.SHORT_NAME), "line", "k", a=g, cond=f"{g} NOT IN {inlist(D.SHORT_NAMES_ALLOWED)}")


def d_exports(r: Rule) -> str:
    above = "coalesce(CASE WHEN line > 1 THEN ls[line - 1] END, '')"
    return hit_sql(r, match_rows(D.EXPORTED), "line", "k", a=group_of(D.EXPORTED, "", 1),
                   cond=f"NOT contains({above}, '*/') AND NOT contains({above}, '//')")


def d_magic(r: Rule, basic: bool = False) -> str:
    digits = "regexp_extract(suf, '^[0-9]+')"
    before = "['\"`.0-9A-Za-z_]" if basic else "['\"\\\\.0-9A-Za-z_]"
    text = "ls[line]"
    skip = (f"contains({text}, 'const') OR contains({text}, 'let') OR contains({text}, 'var') OR regexp_matches({trim(text)}, '^(?://|[*])')"
            if basic else f"regexp_matches({trim(text)}, '^(?://|#|[*])') OR regexp_matches({text}, {re2(D.DECLARATION)})")
    common = D.COMMON_NUMBERS_BASIC if basic else D.COMMON_NUMBERS
    src = f"""(SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY k) AS rn FROM (
    SELECT *, {digits} AS d, ltrim({digits}, '0') AS num FROM {match_rows('[0-9]+', '', r.families)})
  WHERE length(d) >= 2 AND NOT regexp_matches(right(pre, 1), {lit('^' + before)}) AND NOT regexp_matches(substr(suf, length(d) + 1, 1), '^[''"`.0-9A-Za-z_]')
    AND NOT ({skip}) AND num NOT IN {inlist([str(n) for n in common])} AND (length(num) > 2 OR (length(num) = 2 AND num > '10')))"""
    return hit_sql(r, src, "line", "rn", a="num", cond="true" if basic else "rn <= 10")


# The counting loop with the repeated name as three captures that must be equal.
_COUNTING = (r"for\s*\(\s*(?:let|var)\s+(\w+)\s*=\s*(\d+)\s*;\s*(\w+)\s*<\s*(\d+)\s*;\s*(\w+)\+\+\s*\)\s*"
             r"\{[^{}]*(\w+)\s*(?:\+\+|\+=\s*1)[^{}]*\}")
_CALL = r"\w+\([^)]*\)"


def d_counting(r: Rule) -> str:
    g = [group_of(_COUNTING, "", n) for n in range(7)]
    runs = f"TRY_CAST({g[4]} AS DECIMAL(38,0)) - TRY_CAST({g[2]} AS DECIMAL(38,0))"
    return hit_sql(r, match_rows(_COUNTING), "line", "k", a=f"CAST({runs} AS VARCHAR)", b=g[6], cond=f"{g[1]} = {g[3]} AND {g[1]} = {g[5]}")


def d_repeated(r: Rule) -> str:
    """Calls that follow each other are numbered; equal neighbours are islands.  An island of three is a match, and one of
    two if the call before it ends with the same text (a match may begin inside a word)."""
    run = rf"{_CALL};\s*(?:{_CALL};\s*){{2,}}"
    one = rf"({_CALL});\s*"
    text = f"regexp_extract(suf, {lit('^(?:' + to_re2(run) + ')')})"
    src = f"""(SELECT repo, path, CAST(1 + length(before) - length(replace(before, {NL}, '')) AS INTEGER) AS line FROM (
    SELECT repo, path, pre || left(run, CASE WHEN n >= 3 AND NOT (ends_with(last_c, c) AND last_n < 3) THEN off ELSE last_end - length(c) END) AS before FROM (
      SELECT *, lag(c) OVER w AS last_c, coalesce(lag(n) OVER w, 3) AS last_n, lag(stop) OVER w AS last_end FROM (
        SELECT repo, path, k, any_value(pre) AS pre, any_value(run) AS run, island, min(off) AS off, max(off) + length(any_value(c)) AS stop, any_value(c) AS c, count(*) AS n FROM (
          SELECT *, sum(fresh) OVER (PARTITION BY repo, path, k ORDER BY i) AS island FROM (
            SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY repo, path, k ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM (
              SELECT repo, path, k, pre, run, i, cs[i] AS c, length(array_to_string(ps[1:i - 1], '')) AS off FROM (
                SELECT repo, path, k, pre, run, regexp_extract_all(run, {re2(one)}, 1) AS cs, regexp_extract_all(run, {re2(one)}) AS ps FROM (
                  SELECT repo, path, k, pre, {text} AS run FROM {match_rows(run)}))
              x, unnest(range(1, len(x.cs) + 1)) AS t(i)))) GROUP BY repo, path, k, island) WINDOW w AS (PARTITION BY repo, path, k ORDER BY island))
    WHERE n >= 3 OR (n = 2 AND ends_with(last_c, c) AND last_n < 3)))"""
    return hit_sql(r, src, "line", "line")


def d_nesting(r: Rule) -> str:
    src = f"""(SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS rn FROM (
    SELECT *, sum(length(replace(text, '}}', '')) - length(replace(text, '{{', '')))
      OVER (PARTITION BY repo, path ORDER BY line) AS depth FROM {gated_lines(r)} WHERE comment = '//') WHERE depth > 5)"""
    return hit_sql(r, src, "line", "line", a="CAST(depth AS BIGINT)", cond="rn = 1")


def d_duplicate(r: Rule) -> str:
    src = f"""(SELECT repo, path, line, first, row_number() OVER (PARTITION BY repo, path ORDER BY line) AS rn FROM (
    SELECT *, min(line) OVER (PARTITION BY repo, path, block) AS first FROM (
      SELECT repo, path, line, t || '|' || t1 || '|' || t2 || '|' || t3 AS block FROM (
        SELECT *, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(t, 3) OVER w AS t3 FROM (
          SELECT repo, path, line, {trim('text')} AS t FROM {gated_lines(r)} WHERE n_lines >= 10) WINDOW w AS (PARTITION BY repo, path ORDER BY line)))
    WHERE block IS NOT NULL AND {units(f"regexp_replace(block, '{WS}', '', 'g')")} >= 20) WHERE line > first)"""
    return hit_sql(r, src, "line", "line", a="first", b="first + 3", cond="rn = 1")


def fold(r: Rule) -> list[str]:
    """CTEs of a recursive walk over the lines of a file; ends with <id>_hits."""
    n = r.id.lower().replace("-", "_")
    lines = gated_lines(r)
    kind = r.detector
    if kind in ("long_brace", "long_basic"):
        header = re2(D.BRACE_HEADER if kind == "long_brace" else D.BASIC_HEADER)
        facts = f"""CASE WHEN regexp_matches(text, {header}) THEN coalesce(nullif(regexp_extract(text, {header}, 1), ''), regexp_extract(text, {header}, 2)) END AS name,
      length(replace(text, '}}', '')) - length(replace(text, '{{', '')) AS delta, 0 AS solid"""
        opens = "(s.start = -1 AND l.name IS NOT NULL)"
        start = f"CASE WHEN {opens} THEN l.line - 1 ELSE s.start END"
        depth = f"CASE WHEN {opens} THEN l.delta ELSE s.depth + l.delta END"
        close = f"(({start}) <> -1 AND ({depth}) {'<=' if kind == 'long_brace' else '='} 0 AND l.line - 1 > ({start}))"
        name = f"CASE WHEN {opens} THEN l.name ELSE s.name END"
        after = f"CASE WHEN {close} THEN -1 ELSE {start} END"
        length = f"l.line - ({start})"
        es = start
        snippet = "'function ' || en || '() { ... } // ' || el || ' lines'"
    elif kind == "long_python":
        d = re2(D.PYTHON_DEF)
        facts = f"""nullif(regexp_extract(text, {d}, 2), '') AS name, length(text) - length(regexp_replace(text, '^{WS}+', '')) AS delta,
      CASE WHEN {trim('text')} <> '' AND NOT regexp_matches({trim('text')}, '^[#@]') THEN 1 ELSE 0 END AS solid"""
        close = "(s.start <> -1 AND (l.name IS NOT NULL OR (l.solid = 1 AND l.delta <= s.depth)))"
        start = "s.start"
        es, name_e = "s.start", "s.name"
        after = f"CASE WHEN l.name IS NOT NULL THEN l.line - 1 WHEN {close} THEN -1 ELSE s.start END"
        depth = "CASE WHEN l.name IS NOT NULL THEN l.delta ELSE s.depth END"
        length = "l.line - 1 - s.start"
        snippet = "'def ' || en || '(...): # ' || el || ' lines'"
        name = "CASE WHEN l.name IS NOT NULL THEN l.name ELSE s.name END"
    else:
        t = trim("text")
        facts = f"""nullif(regexp_extract({t}, {re2(D.RUBY_DEF)}, 1), '') AS name,
      CASE WHEN regexp_matches({t}, {re2(D.RUBY_OPENER)}) THEN 1 ELSE 0 END - CASE WHEN {t} = 'end' THEN 1 ELSE 0 END AS delta, 0 AS solid"""
        depth = "CASE WHEN l.name IS NOT NULL THEN 1 ELSE s.depth + l.delta END"
        close = "(l.name IS NULL AND s.start <> -1 AND s.depth + l.delta = 0)"
        es = "s.start"
        after = f"CASE WHEN l.name IS NOT NULL THEN l.line - 1 WHEN {close} THEN -1 ELSE s.start END"
        length = "l.line - s.start"
        snippet = "'def ' || en || ' ... end # ' || el || ' lines'"
        name = "CASE WHEN l.name IS NOT NULL THEN l.name ELSE s.name END"
    emitted = "s.name" if kind in ("long_python", "long_ruby") else name
    return [
        f"{n}_lines AS MATERIALIZED (SELECT repo, path, line, {facts} FROM {lines})",
        f"""{n}_walk AS (
    SELECT DISTINCT repo, path, 0 AS line, -1 AS start, '' AS name, 0::BIGINT AS depth, -1 AS es, '' AS en, 0::BIGINT AS el FROM {n}_lines
    UNION ALL
    SELECT s.repo, s.path, l.line, CAST({after} AS INTEGER), {name}, {depth}, CASE WHEN {close} AND {length} > 50 THEN CAST({es} AS INTEGER) ELSE -1 END,
      {emitted}, {length} FROM {n}_walk s JOIN {n}_lines l ON l.repo = s.repo AND l.path = s.path AND l.line = s.line + 1)""",
        f"{n}_hits AS ({hit_sql(r, f'{n}_walk', 'es + 1', 'es + 1', a='en', b='el', text=snippet, cond='es >= 0')})",
    ]


_SPLIT_AS = to_re2(D.ALIAS)


def _pieces(clause: str) -> str:
    return f"unnest(string_split({clause}, ',')) WITH ORDINALITY AS t(piece, j)"


def candidates(r: Rule) -> str:
    """Names defined or imported: (repo, path, line, seq, name, a)."""
    det = r.detector

    def one(pattern, flags, name, a, seq="k", cond="true"):
        return f"SELECT repo, path, line, {seq} AS seq, {name} AS name, {a} AS a, suf FROM {match_rows(pattern, flags, r.families)} WHERE {cond}"

    def named(inner, name, a, cond="true"):
        return f"SELECT repo, path, line, seq, name, a FROM (SELECT repo, path, line, seq, {name} AS name, {a} AS a FROM ({inner})) WHERE {cond}"

    if det == "unused_vars_js":
        return named(one(D.JS_DEFINITION, "", group_of(D.JS_DEFINITION, "", 1), "NULL"), "name", "name", "NOT starts_with(name, '_')")
    if det == "unused_vars_basic":
        parts = [one(p, "", group_of(p, "", 1), "NULL", seq=f"{n * 1000000} + k") for n, p in enumerate(D.BASIC_DEFINITIONS)]
        return named(" UNION ALL ".join(parts), "name", "name", "NOT starts_with(name, '_')")
    if det in ("imports_js", "imports_basic", "imports_python"):
        python = det == "imports_python"
        p, f = (D.IMPORT_PYTHON, "m") if python else (D.IMPORT_JS, "")
        clause = group_of(p, f, 1) if python else f"coalesce(nullif({group_of(p, f, 1)}, ''), {group_of(p, f, 2)})"
        last = (f"split_part({trim('piece')}, ' as ', -1)" if det == "imports_basic"
                else f"regexp_replace({trim('piece')}, '^(?s:.*){_SPLIT_AS}', '')")
        inner = f"""SELECT repo, path, line, k * 1000 + j AS seq, {trim(last)} AS name, NULL AS a FROM (
      SELECT *, {clause} AS clause FROM {match_rows(p, f, r.families)}) x, {_pieces('x.clause')}"""
        return named(inner, "name", "name", "name NOT IN ('', '*')" if python else "name <> ''")
    if det == "imports_go":
        inner = f"""SELECT repo, path, line, k * 1000 + j AS seq, regexp_extract(piece, {re2(D.IMPORT_GO_LINE)}, 1) AS alias, regexp_extract(piece, {re2(D.IMPORT_GO_LINE)}, 2) AS a
      FROM (SELECT *, {group_of(D.IMPORT_GO, '', 1)} AS clause FROM {match_rows(D.IMPORT_GO, '', r.families)}) x, unnest(string_split(x.clause, {NL})) WITH ORDINALITY AS t(piece, j)
      WHERE regexp_matches(piece, {re2(D.IMPORT_GO_LINE)})"""
        return named(inner, "CASE WHEN alias <> '' THEN alias ELSE split_part(a, '/', -1) END", "a", "name <> '_'")
    p, f = {"imports_java": (D.IMPORT_JAVA, "m"), "imports_rust": (D.IMPORT_RUST, ""), "usings_csharp": (D.USING_CSHARP, "m")}[det]
    full = trim(group_of(p, f, 1))
    inner = f"SELECT repo, path, line, k AS seq, {full} AS a FROM {match_rows(p, f, r.families)}"
    if det == "imports_rust":
        return named(inner, trim("replace(replace(split_part(a, '::', -1), '{', ''), '}', '')"), "a", "name NOT IN ('', '*', 'self')")
    return named(inner, "split_part(a, '.', -1)", "a", "name <> '*'" if det == "imports_java" else "NOT starts_with(a, 'System')")


def d_unused(r: Rule) -> str:
    uses = f"len(regexp_extract_all(content, '\\b' || regexp_escape(name) || '\\b'))"
    src = f"""(SELECT c.*, CASE WHEN regexp_matches(name, '^\\w+$') THEN coalesce(w.n, 0) ELSE {uses} END AS uses
    FROM ({candidates(r)}) c JOIN sel s USING (repo, path) LEFT JOIN (
      SELECT repo, path, word, count(*) AS n FROM (SELECT repo, path, unnest(regexp_extract_all(content, '\\w+')) AS word FROM sel) GROUP BY ALL) w
    ON w.repo = c.repo AND w.path = c.path AND w.word = c.name)"""
    return hit_sql(r, src, "line", "seq", a="a", cond="uses <= 1")


_DETECTORS = {
    "long_lines": d_long_lines, "long_lines_basic": lambda r: d_long_lines(r, ("//",)), "commented": d_commented,
    "missing_set_e": d_set_e, "base_image": d_base_image, "todo": d_todo, "captured_text": d_captured,
    "short_names": d_short_names, "undocumented_exports": d_exports, "magic": d_magic,
    "magic_basic": lambda r: d_magic(r, True), "nesting": d_nesting, "simplifiable_loop": d_counting, "duplicate_block": d_duplicate,
}


def found_ctes(profile: str, groups: tuple[str, ...] | None = None, exclude: tuple[str, ...] = ()) -> list[str]:
    """CTEs up to ``found``: deduplicated findings with their texts."""
    rules = [r for r in profile_rules(profile, groups) if r.group not in exclude]
    ctes = selected(profile)
    parts = []
    for r in rules:
        if r.id == "B-31":
            parts.append(d_repeated(r))
        elif r.detector is None:
            parts.append(pattern_sql(r))
        elif r.detector in ("long_brace", "long_basic", "long_python", "long_ruby"):
            cs = fold(r)
            ctes += cs
            parts.append(f"SELECT * FROM {cs[-1].split(' ', 1)[0]}")
        elif r.detector in D.CANDIDATES:
            parts.append(d_unused(r))
        else:
            parts.append(_DETECTORS[r.detector](r))
    table = [(r.rix, r.id, r.type, r.severity, r.title, r.description, r.suggestion, r.suggestion_code) for r in rules]

    def fill(x: str) -> str:
        return (f"replace(replace(replace(replace({x}, '{{line}}', line::VARCHAR), '{{end}}', (line + 3)::VARCHAR), "
                f"'{{b}}', coalesce(b, '{{b}}')), '{{a}}', coalesce(a, '{{a}}'))")

    return [
        *ctes,
        "raw AS (" + "\nUNION ALL\n".join(parts) + ")",
        values("rules", "rix, rule_id, type, severity, title, description, suggestion, suggestion_code", table),
        f"""found AS MATERIALIZED (
    SELECT repo, rule_id, type, severity, title, {fill('description')} AS description, path AS file, line, ord, seq, code_text,
      {fill('suggestion')} AS suggestion, {fill('suggestion_code')} AS suggestion_code
    FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, line, tkey ORDER BY ord, seq) AS rn FROM raw) JOIN rules USING (rix) WHERE rn = 1)""",
    ]


FINDING_COLS = "repo, rule_id, type, severity, title, description, file, line, suggestion, suggestion_code"


def group_query(profile: str, groups: tuple[str, ...], extra: str = "") -> str:
    return with_(found_ctes(profile, groups), f"SELECT {FINDING_COLS}{extra} FROM found", recursive=True)


def on_found(query: str, profile: str = "extended", groups=None, exclude=(), more: list[str] | None = None) -> str:
    return with_(found_ctes(profile, groups, exclude) + (more or []), query, recursive=True)


# --- scores ---------------------------------------------------------------------------

def grade_case(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {s} THEN '{g}'" for s, g in GRADES) + " ELSE 'F' END"


def report_ctes(profile: str) -> list[str]:
    points = f"CASE severity WHEN 'critical' THEN {POINTS['critical']} WHEN 'warning' THEN {POINTS['warning']} ELSE 1 END"
    sums = ", ".join(f"sum(CASE WHEN type = '{t}' THEN {points} ELSE 0 END) AS p_{t}" for t in CAPS)
    score = ", ".join(f"CAST(greatest(0, 100 - least(coalesce(p_{t}, 0), {c})) AS INTEGER) AS {SCORE_NAMES[t]}" for t, c in CAPS.items())
    overall = " + ".join(f"CAST({n} AS DOUBLE) * CAST({w} AS DOUBLE)" for n, w in WEIGHTS.items())

    def plural(n, word, rest):
        return f"CASE WHEN {n} > 0 THEN {n}::VARCHAR || ' {word}' || CASE WHEN {n} > 1 THEN 's' ELSE '' END || '{rest}' ELSE '' END"

    if profile == "basic":
        summary = f"""'Analyzed ' || analyzed_files || ' files with ' || format('{{:,}}', analyzed_lines) || ' lines of code. ' ||
      CASE WHEN critical_issues > 0 THEN 'Found ' ELSE '' END || {plural('critical_issues', 'critical issue', ' that require immediate attention. ')} ||
      CASE WHEN warnings > 0 THEN 'Identified ' ELSE '' END || {plural('warnings', 'warning', ' that should be reviewed. ')} ||
      CASE WHEN overall >= 80 THEN 'Overall, the codebase is in good shape.' WHEN overall >= 60 THEN 'The codebase has room for improvement.' ELSE 'The codebase needs significant attention.' END"""
    else:
        summary = f"""'Analyzed ' || analyzed_files || ' files (' || format('{{:,}}', analyzed_lines) || ' lines). ' ||
      {plural('critical_issues', 'critical issue', ' need immediate attention. ')} || {plural('warnings', 'warning', ' to review. ')} ||
      CASE WHEN overall >= 80 THEN 'Overall the codebase is in good shape.' WHEN overall >= 60 THEN 'Room for improvement.' ELSE 'Significant attention needed.' END"""
    return [
        "file_stats AS (SELECT repo, count(*) AS analyzed_files, CAST(sum(len(ls)) AS BIGINT) AS analyzed_lines FROM sel GROUP BY repo)",
        f"""issue_stats AS (SELECT repo, count(*) AS total_issues, count(*) FILTER (severity = 'critical') AS critical_issues,
    count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS suggestions, {sums} FROM found GROUP BY repo)""",
        f"""scored AS (SELECT repo, analyzed_files, analyzed_lines, coalesce(total_issues, 0) AS total_issues, coalesce(critical_issues, 0) AS critical_issues,
    coalesce(warnings, 0) AS warnings, coalesce(suggestions, 0) AS suggestions, {score} FROM file_stats LEFT JOIN issue_stats USING (repo))""",
        f"overalls AS (SELECT *, CAST(floor({overall} + 0.5) AS INTEGER) AS overall FROM scored)",
        f"""report AS (SELECT repo, analyzed_files AS total_files, analyzed_files, analyzed_lines, total_issues, critical_issues, warnings, suggestions,
    security, performance, quality, cleanliness, overall, {grade_case('overall')} AS grade,
    CASE WHEN overall >= 80 THEN 'good' WHEN overall >= 60 THEN 'fair' ELSE 'poor' END AS band, {summary} AS summary FROM overalls)""",
    ]


def time_ago_sql(ts: str, now: str) -> str:
    secs = f"floor(epoch_us({now} - {ts}) / 1000000.0)"
    cases = " ".join(
        f"WHEN floor({secs} / {size}) >= 1 THEN CAST(CAST(floor({secs} / {size}) AS BIGINT) AS VARCHAR) || ' {unit}' || CASE WHEN floor({secs} / {size}) > 1 THEN 's' ELSE '' END || ' ago'"
        for unit, size in TIME_UNITS)
    return f"CASE {cases} ELSE 'just now' END"
