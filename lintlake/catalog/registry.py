"""Registered queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import findings as FD
from ..operators import scoring as SC
from ..operators import selection as SEL
from ..operators.classify import classify_language, file_stats
from ..plans.audit import audit_files, explode_hits, findings
from ..rules import profile_rules
from ..sources.readers import decode_payloads, read_table, scan_directory, tree_blobs
from ..sources.sinks import report_documents, write_files, write_findings, write_report_json
from ..streaming import audit_stream as ST
from ..streaming import reaudit as RA
from . import oracle as O
from .corpus import corpus, inventory
from .snippets import SNIPPETS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


FINDING = ["repo", "rule_id", "type", "severity", "title", "description", "file", "line"]


def flat(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*FINDING, F.col("suggestion.text").alias("suggestion"), F.col("suggestion.code").alias("suggestion_code"), *extra)


# --- one query per group of rules -----------------------------------------------------

GROUPS: dict[str, tuple[str, ...]] = {}
for _profile in ("extended", "basic"):
    for _g in dict.fromkeys(r.group for r in profile_rules(_profile)):
        GROUPS[_g] = (_profile, (_g,))

for _name, (_profile, _groups) in GROUPS.items():
    _extra = ("code_text",) if _name.startswith("long_functions") else ()
    _add(
        _name,
        lambda s, d, p=_profile, g=_groups, e=_extra: flat(findings(corpus(s, d), p, g), *e),
        O.group_query(_profile, _groups, "".join(f", {c}" for c in _extra)),
    )

# --- languages and selection ----------------------------------------------------------


def _chosen(s: SparkSession, d: str, profile: str = "extended") -> DataFrame:
    return SEL.select_files(corpus(s, d), profile)


_HIST = "SELECT repo, language, count(*) AS files, min(path) AS first_seen FROM sel GROUP BY repo, language"
_add("language_histogram", lambda s, d: SC.language_histogram(file_stats(_chosen(s, d))).drop("first_seen"),
     O.with_(O.selected("extended"), f"SELECT repo, language, files FROM ({_HIST})"))
_add("language_share_top15", lambda s, d: SC.language_share(file_stats(_chosen(s, d))),
     O.with_(O.selected("extended"), f"""SELECT * FROM (SELECT repo, language, files, round(files / sum(files) OVER (PARTITION BY repo) * 100, 1) AS pct,
  CAST(row_number() OVER (PARTITION BY repo ORDER BY files DESC, first_seen) AS INTEGER) AS position,
  greatest(count(*) OVER (PARTITION BY repo) - 15, 0) AS more FROM ({_HIST})) WHERE position <= 15"""))
_STAT_SQL = f"SELECT repo, path, language, family, CAST(len(ls) AS INTEGER) AS lines, CAST({O.units('content')} AS INTEGER) AS size FROM sel"
_add("file_stats", lambda s, d: file_stats(_chosen(s, d)), O.with_(O.selected("extended"), _STAT_SQL))
_add("file_stats_basic", lambda s, d: file_stats(_chosen(s, d, "basic"), "basic"), O.with_(O.selected("basic"), _STAT_SQL))
_add("language_extended", lambda s, d: classify_language(inventory(s, d)).select("path", "language", "family", "comment"),
     O.with_([*O.INVENTORY, *O.DIMS], f"SELECT path, language, family, comment FROM ({O.classified('inventory', 'extended')})"))
_add("language_basic", lambda s, d: classify_language(inventory(s, d), "basic").select("path", "language"),
     O.with_([*O.INVENTORY, *O.DIMS], f"SELECT path, language FROM ({O.classified('inventory', 'basic')})"))
for _p in ("extended", "basic", "remote"):
    _add(f"scan_filter_{_p}", lambda s, d, p=_p: SEL.skip_reason(inventory(s, d), p).select("repo", "path", "ignored_root", "skip_reason"),
         O.with_([*O.INVENTORY, *O.DIMS], f"SELECT repo, path, ignored_root, skip_reason FROM ({O.reasons('inventory', _p)})"))
_add("skip_reasons", lambda s, d: SEL.skip_counts(inventory(s, d)),
     O.with_([*O.INVENTORY, *O.DIMS], f"""SELECT repo, skip_reason, CAST(count(DISTINCT coalesce(ignored_root, path)) AS BIGINT) AS skipped
  FROM ({O.reasons('inventory', 'extended')}) WHERE skip_reason IS NOT NULL GROUP BY repo, skip_reason"""))


def _hosted(s: SparkSession, d: str) -> DataFrame:
    """Page addresses as repository addresses of several spellings."""
    pages = read_table(s, f"{d}/pages.parquet", "page_id", "url")
    tail = F.regexp_replace("url", r"^https?://[^/]+/", "")
    first = F.regexp_extract(tail, r"^([^/?#]+)/([^/?#]+)", 1)
    second = F.regexp_extract(tail, r"^([^/?#]+)/([^/?#]+)", 2)
    return pages.select("page_id", F.explode(F.array(
        F.concat(F.lit("https://github.com/"), tail), F.concat(F.lit("git@github.com/"), first, F.lit("/r"), second, F.lit(".git")),
        F.concat(first, F.lit("/"), second, F.lit(".git")), F.concat(first, F.lit("/ "), second), F.col("url"))).alias("target"))


def _repo_key_sql() -> str:
    hosted = "'github[.]com/([^/]+)/([^/]+?)(?:[.]git)?(?:/|$)'"

    def key(literal: str) -> str:
        return f"""CASE WHEN regexp_matches(target, {hosted}) THEN regexp_extract(target, {hosted}, 1) || '/' || regexp_replace(regexp_extract(target, {hosted}, 2), '[.]git$', '')
      WHEN regexp_matches(target, {literal}) THEN regexp_extract(target, {literal}, 1) || '/' || regexp_replace(regexp_extract(target, {literal}, 2), '[.]git$', '') END"""

    strict, loose = key("'^([^/\\s]+)/([^/\\s]+)$'"), key("'^([^/]+)/([^/]+)$'")
    return f"""WITH parts AS (SELECT page_id, url, regexp_replace(url, '^https?://[^/]+/', '') AS tail FROM pages),
named AS (SELECT *, regexp_extract(tail, '^([^/?#]+)/([^/?#]+)', 1) AS a, regexp_extract(tail, '^([^/?#]+)/([^/?#]+)', 2) AS b FROM parts),
targets AS (SELECT page_id, unnest(['https://github.com/' || tail, 'git@github.com/' || a || '/r' || b || '.git', a || '/' || b || '.git', a || '/ ' || b, url]) AS target FROM named)
SELECT page_id, target, {strict} AS repo_key, {loose} AS repo_key_basic FROM targets"""


_add("repo_key", lambda s, d: _hosted(s, d).select(
    "page_id", "target", P.repo_key(F.col("target")).alias("repo_key"), P.repo_key(F.col("target"), strict=False).alias("repo_key_basic")),
    _repo_key_sql())
_add("repo_search", lambda s, d: SEL.search_repos(read_table(s, f"{d}/documents.parquet", "doc_id", "source").select(
    "doc_id", F.initcap("source").alias("repo")), "RC1"),
    "SELECT doc_id, upper(left(source, 1)) || lower(substr(source, 2)) AS repo FROM documents WHERE contains(lower(source), 'rc1')")
_NOW = "2024-01-20 12:00:00"
_add("time_ago", lambda s, d: read_table(s, f"{d}/events.parquet", "event_id", "ts").select(
    "event_id", P.time_ago(F.col("ts"), F.lit(_NOW).cast("timestamp")).alias("ago"),
    P.time_ago(F.col("ts"), F.lit("2031-06-01").cast("timestamp")).alias("ago_late")),
    f"""SELECT event_id, {O.time_ago_sql('ts', f"TIMESTAMP '{_NOW}'")} AS ago, {O.time_ago_sql('ts', "TIMESTAMP '2031-06-01 00:00:00'")} AS ago_late FROM events""")
_add("env_names", lambda s, d: read_table(s, f"{d}/documents.parquet", "doc_id", "source").select(
    "doc_id", P.env_name(F.concat("source", F.lit(" key/v2"))).alias("env_name")),
    "SELECT doc_id, regexp_replace(upper(source || ' key/v2'), '[^A-Z]', '_', 'g') AS env_name FROM documents")


# --- landed listings and payloads -----------------------------------------------------


def _payloads(s: SparkSession, d: str) -> DataFrame:
    docs = read_table(s, f"{d}/documents.parquet", "doc_id", "text")
    kind = F.col("doc_id") % 4
    return docs.select(
        F.lit("landed").alias("repo"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.when(kind < 2, "base64").when(kind == 2, "none").alias("encoding"),
        F.when(kind < 2, F.base64(F.encode("text", "UTF-8"))).when(kind == 2, F.col("text")).alias("content"))


_add("payload_decode", lambda s, d: decode_payloads(_payloads(s, d)),
     "SELECT 'landed' AS repo, 'f' || doc_id || '.md' AS path, CASE WHEN doc_id % 4 < 3 THEN text ELSE '' END AS content FROM documents")


def _trees(s: SparkSession, d: str) -> DataFrame:
    """Tree listings: one document of entries per page, as landed JSON text."""
    pages = read_table(s, f"{d}/pages.parquet", "page_id")
    p = F.col("page_id").cast("string")
    entry = lambda path, type_, size: F.struct(path.alias("path"), F.lit(type_).alias("type"), size.alias("size"), F.lit("0").alias("sha"))
    return pages.select(F.lit("landed").alias("repo"), F.to_json(F.array(
        entry(F.concat(F.lit("src/a"), p, F.lit(".py")), "blob", F.col("page_id") * 10000),
        entry(F.lit("src"), "tree", F.lit(None).cast("bigint")),
        entry(F.concat(F.lit("b"), p, F.lit(".unknown")), "blob", F.lit(5).cast("bigint")),
        entry(F.concat(F.lit("node_modules/c"), p, F.lit(".js")), "blob", F.lit(None).cast("bigint")))).alias("tree"))


_add("tree_listing", lambda s, d: SEL.skip_reason(tree_blobs(_trees(s, d)), "remote").select("repo", "path", "size_bytes", "skip_reason"),
     O.with_([*O.DIMS, """tree AS (SELECT 'landed' AS repo, unnest([
  {'path': 'src/a' || page_id || '.py', 'size_bytes': page_id * 10000}, {'path': 'b' || page_id || '.unknown', 'size_bytes': 5},
  {'path': 'node_modules/c' || page_id || '.js', 'size_bytes': 0}], recursive := true) FROM pages)"""],
             f"SELECT repo, path, CAST(size_bytes AS BIGINT) AS size_bytes, skip_reason FROM ({O.reasons('tree', 'remote')})"))

# --- findings -------------------------------------------------------------------------


def _found(s: SparkSession, d: str, profile: str = "extended", context: bool = False, wanted: Callable | None = None) -> DataFrame:
    rules = profile_rules(profile) if wanted is None else FD.rules_for(profile_rules(profile), wanted)
    return findings(corpus(s, d), profile, rules=rules, context=context)


_COLS = O.FINDING_COLS
_add("findings_dedup", lambda s, d: flat(_found(s, d)), O.on_found(f"SELECT {_COLS} FROM found"))
_add("findings_basic", lambda s, d: flat(_found(s, d, "basic")), O.on_found(f"SELECT {_COLS} FROM found", "basic"))
_ID = "row_number() OVER (PARTITION BY repo ORDER BY file, ord, seq)"
_add("finding_ids", lambda s, d: FD.assign_ids(_found(s, d)).select("repo", "id", "rule_id", "file", "line", "title"),
     O.on_found(f"SELECT repo, {_ID} AS id, rule_id, file, line, title FROM found"))
_add("merged_runs", lambda s, d: FD.dedupe_findings(
    flat(_found(s, d), "ord", "seq").unionByName(flat(findings(corpus(s, d), "extended", ("secrets",)), "ord", "seq"))).select(*FINDING),
    O.on_found("SELECT repo, rule_id, type, severity, title, description, file, line FROM found"))
_add("new_findings", lambda s, d: FD.new_findings(
    flat(_found(s, d)), findings(corpus(s, d), "extended", ("secrets", "todo_comments", "magic_numbers"))).select(*FINDING),
    O.on_found("""SELECT repo, rule_id, type, severity, title, description, file, line FROM found
  WHERE NOT (starts_with(title, 'Exposed ') OR title LIKE '% Comment' OR title = 'Magic Number')"""))
_add("code_context", lambda s, d: _found(s, d, context=True).where("code IS NOT NULL").select(
    "repo", "file", "line", "title", F.posexplode("code").alias("pos", "c")).select(
    "repo", "file", "line", "title", "c.number", "c.content", "c.highlight"),
    O.on_found("""SELECT f.repo, f.file, f.line, f.title, CAST(i AS INTEGER) AS number, s.ls[i] AS content, i = f.line AS highlight
  FROM found f JOIN sel s ON s.repo = f.repo AND s.path = f.file, unnest(range(greatest(1, f.line - 1), least(len(s.ls), f.line + 1) + 1)) AS t(i)
  WHERE f.title NOT IN ('Line Too Long', 'Long Function', 'Long Method')"""))

# --- scores and rollups ---------------------------------------------------------------


def _audited(s: SparkSession, d: str, profile: str = "extended"):
    rules = profile_rules(profile)
    return audit_files(corpus(s, d), profile, rules=rules), rules


def repo_report(s: SparkSession, d: str, profile: str = "extended") -> DataFrame:
    audited, rules = _audited(s, d, profile)
    return SC.repo_report(audited, rules, profile)


def _counts(s: SparkSession, d: str) -> DataFrame:
    return SC.file_counts(*_audited(s, d))


_REPORT = O.report_ctes("extended")
_add("severity_counts", lambda s, d: SC.severity_counts(_found(s, d)),
     O.on_found("""SELECT repo, count(*) FILTER (severity = 'critical') AS critical_issues, count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'info') AS suggestions FROM found GROUP BY repo"""))
_add("repo_report", repo_report, O.on_found("SELECT * FROM report", more=_REPORT))
_add("repo_report_basic", lambda s, d: repo_report(s, d, "basic"),
     O.on_found("SELECT * FROM report", "basic", more=O.report_ctes("basic")))
_add("mean_scores", lambda s, d: SC.mean_scores(repo_report(s, d)),
     O.on_found("SELECT count(*) AS repos, " + ", ".join(f"round(avg({n}), 4) AS mean_{n}" for n in ("security", "performance", "quality", "cleanliness", "overall")) + " FROM report", more=_REPORT))
_add("report_of_findings", lambda s, d: SC.report_of_findings(FD.stored(_found(s, d)), file_stats(_chosen(s, d))),
     O.on_found("SELECT * FROM report", more=_REPORT))
_add("scores", lambda s, d: SC.score_findings(_found(s, d)),
     O.on_found("SELECT repo, security, performance, quality, cleanliness, overall, grade, band FROM report WHERE total_issues > 0", more=_REPORT))
_add("grades", lambda s, d: read_table(s, f"{d}/documents.parquet", "doc_id").select(
    "doc_id", (F.col("doc_id") % 101).alias("score"), P.letter_grade(F.col("doc_id") % 101).alias("grade"), P.score_band(F.col("doc_id") % 101).alias("band")),
    f"""SELECT doc_id, doc_id % 101 AS score, {O.grade_case('(doc_id % 101)')} AS grade,
  CASE WHEN doc_id % 101 >= 80 THEN 'good' WHEN doc_id % 101 >= 60 THEN 'fair' ELSE 'poor' END AS band FROM documents""")
_add("penalties", lambda s, d: SC.penalties(_found(s, d)).select("repo", "type", F.col("points").cast("bigint").alias("points")),
     O.on_found("SELECT repo, type, CAST(sum(CASE severity WHEN 'critical' THEN 15 WHEN 'warning' THEN 5 ELSE 1 END) AS BIGINT) AS points FROM found GROUP BY ALL"))
_BADGE = """SELECT repo, file, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning,
  count(*) FILTER (severity = 'info') AS info FROM found GROUP BY repo, file"""
_add("file_badges", lambda s, d: SC.file_badges(_counts(s, d)),
     O.on_found(f"""SELECT *, critical + warning + info AS total, CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' ELSE 'info' END AS worst FROM ({_BADGE})"""))
_TREE = f"""SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' WHEN info > 0 THEN 'info' END AS worst FROM (SELECT repo, node, CAST(depth AS INTEGER) AS depth, depth = n AS is_file, count(*) AS files, CAST(sum(critical) AS BIGINT) AS critical,
  CAST(sum(warning) AS BIGINT) AS warning, CAST(sum(info) AS BIGINT) AS info, split_part(node, '/', -1) AS name FROM (
    SELECT s.repo, array_to_string(string_split(s.path, '/')[1:i], '/') AS node, i AS depth, len(string_split(s.path, '/')) AS n,
      coalesce(b.critical, 0) AS critical, coalesce(b.warning, 0) AS warning, coalesce(b.info, 0) AS info
    FROM sel s LEFT JOIN ({_BADGE}) b ON b.repo = s.repo AND b.file = s.path, unnest(range(1, len(string_split(s.path, '/')) + 1)) AS t(i)) GROUP BY repo, node, depth, depth = n)"""
_add("dir_rollup", lambda s, d: SC.dir_rollup(_counts(s, d)), O.on_found(_TREE))
_add("tree_positions", lambda s, d: SC.tree_positions(SC.dir_rollup(_counts(s, d))).select("repo", "node", "is_file", "position"),
     O.on_found(f"SELECT repo, node, is_file, row_number() OVER (PARTITION BY repo ORDER BY replace(node, '/', chr(1)), is_file) AS position FROM ({_TREE})"))
_add("type_severity_rollup", lambda s, d: SC.type_severity_rollup(_found(s, d)),
     O.on_found("SELECT type, severity, count(*) AS issues FROM found GROUP BY ROLLUP (type, severity)"))
_add("rule_matrix", lambda s, d: SC.rule_matrix(_found(s, d)),
     O.on_found("SELECT type, severity, title, count(*) AS issues, count(DISTINCT repo) AS repos FROM found GROUP BY ALL"))
_add("corpus_rollup", lambda s, d: SC.corpus_rollup(*_audited(s, d)),
     O.on_found("""SELECT rule_id, title, count(*) AS issues, round(count(*) * 1000 / (SELECT sum(len(ls)) FROM sel), 4) AS per_1k_lines FROM found GROUP BY rule_id, title"""))

# --- filters, orderings, short lists --------------------------------------------------

_SHORT = "repo, rule_id, severity, title, file, line"
_PICK = _SHORT.split(", ")
_add("min_severity", lambda s, d: FD.min_severity(_found(s, d, wanted=lambda r: r.severity != "info"), "warning").select(*_PICK),
     O.on_found(f"SELECT {_SHORT} FROM found WHERE severity <> 'info'"))
_add("type_filter", lambda s, d: FD.of_type(_found(s, d, wanted=lambda r: r.type == "performance"), "performance").select(*_PICK),
     O.on_found(f"SELECT {_SHORT} FROM found WHERE type = 'performance'"))
_add("severity_filter", lambda s, d: FD.of_severity(_found(s, d, wanted=lambda r: r.severity == "critical"), "critical").select(*_PICK),
     O.on_found(f"SELECT {_SHORT} FROM found WHERE severity = 'critical'"))
_add("path_prefix", lambda s, d: FD.under_path(_found(s, d), "src/d1/f1").select(*_PICK),
     O.on_found(f"SELECT {_SHORT} FROM found WHERE starts_with(file, 'src/d1/f1')"))
_add("ci_gate", lambda s, d: FD.ci_gate(_counts(s, d)),
     O.on_found("""SELECT a.repo, coalesce(c.n, 0) AS critical_issues, coalesce(c.n, 0) > 0 AS gate FROM (SELECT DISTINCT repo FROM sel) a
  LEFT JOIN (SELECT repo, count(*) AS n FROM found WHERE severity = 'critical' GROUP BY repo) c USING (repo)"""))
_add("fixable_top20", lambda s, d: FD.fixable(_found(s, d, "basic")).select(*_PICK, "position"),
     O.on_found(f"""SELECT * FROM (SELECT {_SHORT}, CAST({_ID} AS INTEGER) AS position FROM found WHERE suggestion_code IS NOT NULL) WHERE position <= 20""", "basic"))
_ONE = "src/d1/f1" + (SNIPPETS[1][0] if SNIPPETS[1][0].startswith(".") else "/" + SNIPPETS[1][0])
_add("file_findings", lambda s, d: FD.of_severity(_found(s, d), "all", file=_ONE).select(*_PICK),
     O.on_found(f"SELECT {_SHORT} FROM found WHERE file = {O.lit(_ONE)}"))
_add("info_top20", lambda s, d: FD.info_top(_found(s, d)).select(*_PICK, "position"),
     O.on_found(f"SELECT * FROM (SELECT {_SHORT}, CAST({_ID} AS INTEGER) AS position FROM found WHERE severity = 'info') WHERE position <= 20"))
_SEV = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
_add("sorted_by_severity", lambda s, d: FD.sorted_by(_found(s, d), "severity").select(*_PICK, "position"),
     O.on_found(f"SELECT {_SHORT}, row_number() OVER (PARTITION BY repo ORDER BY {_SEV}, file, ord, seq) AS position FROM found"))
# The Unicode collation puts these signs first, in this order, and ignores case at first.
_UCA = "translate(lower(file), '_-./', chr(1) || chr(2) || chr(3) || chr(4))"
_add("sorted_by_file", lambda s, d: FD.sorted_by(_found(s, d), "file").select(*_PICK, "position"),
     O.on_found(f"SELECT {_SHORT}, row_number() OVER (PARTITION BY repo ORDER BY {_UCA}, file, ord, seq) AS position FROM found"))
_add("sorted_by_type", lambda s, d: FD.sorted_by(_found(s, d), "type").select(*_PICK, "position"),
     O.on_found(f"SELECT {_SHORT}, row_number() OVER (PARTITION BY repo ORDER BY type, file, ord, seq) AS position FROM found"))
_LABEL = "CASE severity WHEN 'critical' THEN 'Critical' WHEN 'warning' THEN 'Warnings' ELSE 'Info' END"
_add("compact_report", lambda s, d: FD.compact_lines(_found(s, d)),
     O.on_found(f"""SELECT repo, {_SEV} AS section, position, text FROM (
  SELECT repo, severity, row_number() OVER (PARTITION BY repo, severity ORDER BY file, ord, seq) AS position, file || ':' || line || ' — ' || title AS text FROM found)
  WHERE severity <> 'info' OR position <= 20
UNION ALL SELECT repo, {_SEV}, 0, {_LABEL} || ' (' || count(*) || '):' FROM found GROUP BY repo, severity
UNION ALL SELECT repo, {_SEV}, 21, '... and ' || (count(*) - 20) || ' more' FROM found WHERE severity = 'info' GROUP BY repo, severity HAVING count(*) > 20"""))


def _report_json(s: SparkSession, d: str) -> DataFrame:
    # Numbering writes the findings once; the report is computed from what was written.
    audited, rules = _audited(s, d)
    issues = FD.assign_ids(explode_hits(audited, rules, context=True))
    stats = file_stats(_chosen(s, d))
    return _report_rows(report_documents(SC.report_of_findings(issues, stats), issues, stats))


def _report_rows(docs: DataFrame) -> DataFrame:
    """The JSON documents read back as rows: ``repo, section, page, entry, field, value``."""
    text = lambda c: F.col(c).cast("string")
    head = docs.where("section = 'header'").select("repo", F.from_json("json", "statistics struct<totalIssues:bigint, languages:map<string,bigint>>, scores struct<overall:int>, summary string").alias("h"))
    fields = F.map_concat(
        F.create_map(F.lit("totalIssues"), text("h.statistics.totalIssues"), F.lit("overall"), text("h.scores.overall"), F.lit("summary"), F.col("h.summary")),
        F.transform_values(F.transform_keys("h.statistics.languages", lambda k, v: F.concat(F.lit("language "), k)), lambda k, v: v.cast("string")))
    zero = F.lit(0).cast("bigint")
    rows = head.select("repo", F.lit("header").alias("section"), zero.alias("page"), zero.alias("entry"), F.explode(fields).alias("field", "value"))
    issues = docs.where("section = 'issues'").select("repo", "section", "page", F.inline(F.from_json("json", "array<struct<id:bigint, title:string, file:string, line:int, code:string>>")))
    shown = F.when(F.startswith("code", F.lit("[")), F.size(F.from_json("code", "array<struct<number:int>>")).cast("string")).otherwise(F.lit("text"))
    rows = rows.unionByName(issues.select("repo", "section", "page", F.col("id").alias("entry"), F.explode(F.create_map(
        F.lit("title"), F.col("title"), F.lit("at"), F.concat_ws(":", "file", text("line")), F.lit("code"), shown)).alias("field", "value")))
    files = docs.where("section = 'files'").select("repo", "section", "page", F.posexplode(F.from_json("json", "array<struct<path:string, lines:int>>")).alias("k", "f"))
    return rows.unionByName(files.select("repo", "section", "page", (F.col("page") * 1000 + F.col("k") + 1).alias("entry"), F.lit("path").alias("field"), F.concat_ws(":", "f.path", text("f.lines")).alias("value")))


_add("report_json", _report_json, O.on_found(f"""
SELECT repo, 'header' AS section, 0::BIGINT AS page, 0::BIGINT AS entry, u.field, u.value FROM (
  SELECT repo, unnest([{{'field': 'totalIssues', 'value': total_issues::VARCHAR}}, {{'field': 'overall', 'value': overall::VARCHAR}}, {{'field': 'summary', 'value': summary}}]) AS u FROM report)
UNION ALL SELECT repo, 'header', 0, 0, 'language ' || language, files::VARCHAR FROM ({_HIST})
UNION ALL SELECT repo, 'issues', (id - 1) // 1000, id, u.field, u.value FROM (
  SELECT repo, id, unnest([{{'field': 'title', 'value': title}}, {{'field': 'at', 'value': file || ':' || line}}, {{'field': 'code', 'value': code}}]) AS u FROM (
    SELECT f.repo, title, file, line, row_number() OVER (PARTITION BY f.repo ORDER BY file, ord, seq) AS id,
      CASE WHEN title IN ('Line Too Long', 'Long Function', 'Long Method') THEN 'text' ELSE (least(len(s.ls), line + 1) - greatest(1, line - 1) + 1)::VARCHAR END AS code
    FROM found f JOIN sel s ON s.repo = f.repo AND s.path = f.file))
UNION ALL SELECT repo, 'files', (n - 1) // 1000, n, 'path', path || ':' || lines FROM (
  SELECT repo, path, len(ls) AS lines, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM sel)""", more=_REPORT))

# --- sinks and folders: written to a fresh shared folder and read back --------------------


def _written_findings(s: SparkSession, d: str) -> DataFrame:
    path = ST.run_folder(s, "findings")
    write_findings(FD.assign_ids(_found(s, d)), path)
    return s.read.parquet(path).select("repo", "id", "rule_id", "file", "line", "title")


_add("written_findings", _written_findings, O.on_found(f"SELECT repo, {_ID} AS id, rule_id, file, line, title FROM found"))


def _written_report(s: SparkSession, d: str) -> DataFrame:
    path = ST.run_folder(s, "report")
    issues, stats = FD.assign_ids(_found(s, d)), file_stats(_chosen(s, d))
    write_report_json(report_documents(SC.report_of_findings(issues, stats), issues, stats), path)
    return s.read.json(path).groupBy("repo", "section").agg(F.count("*").alias("documents"))


_add("written_report", _written_report, O.on_found("""SELECT repo, 'header' AS section, count(*) AS documents FROM report GROUP BY repo
UNION ALL SELECT repo, 'issues', (count(*) + 999) // 1000 FROM found GROUP BY repo
UNION ALL SELECT repo, 'files', (count(*) + 999) // 1000 FROM sel GROUP BY repo""", more=_REPORT))


def _directory_scan(s: SparkSession, d: str) -> DataFrame:
    """Every document as a file of a folder tree, walked and read."""
    root = ST.run_folder(s, "tree")
    docs = read_table(s, f"{d}/documents.parquet", "doc_id", "text")
    path = F.concat(F.lit("d"), (F.col("doc_id") % 13).cast("string"), F.lit("/_part/f "), F.col("doc_id").cast("string"), F.lit(".md"))
    write_files(docs.select(path.alias("path"), F.col("text").alias("content")), root)
    return scan_directory(s, root, "landed").select("repo", "path", "size_bytes", F.md5("content").alias("digest"))


_add("directory_scan", _directory_scan,
     "SELECT 'landed' AS repo, 'd' || (doc_id % 13) || '/_part/f ' || doc_id || '.md' AS path, CAST(strlen(text) AS BIGINT) AS size_bytes, md5(text) AS digest FROM documents WHERE strlen(text) <= 1048576")

# --- references between files ---------------------------------------------------------

_add("dead_files", lambda s, d: SC.dead_files(_chosen(s, d)), O.with_(O.selected("extended"), r"""
SELECT repo, path FROM sel f WHERE NOT EXISTS (SELECT 1 FROM (
  SELECT repo, path, regexp_replace(split_part(t, '/', -1), '[.][^.]+$', '') AS stem FROM (
    SELECT repo, path, unnest(list_concat(regexp_extract_all(content, '(?:from|import|require\s*\()\s*[''"]([^''"\n]+)[''"]', 1),
      list_transform(regexp_extract_all(content, '(?m)^(?:from|import)\s+([\w.]+)', 1), lambda x: replace(x, '.', '/')))) AS t FROM sel)) e
  WHERE e.repo = f.repo AND e.path <> f.path AND e.stem = regexp_replace(split_part(f.path, '/', -1), '[.][^.]+$', ''))"""))

# --- streams --------------------------------------------------------------------------


def _arriving(s: SparkSession, d: str) -> DataFrame:
    """Conversation turns arriving as text files."""
    turns = ST.read_arriving(s, d, "conversations", "conv_id bigint, turn bigint, role string, text string")
    return turns.select(
        F.concat(F.lit("chat-"), "role").alias("repo"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/t"), F.col("turn").cast("string"), F.lit(".md")).alias("path"),
        F.concat("text", F.lit("\n# TODO: if asked for turn "), F.col("turn").cast("string"), F.lit("\n")).alias("content"))


_CHAT = O.selected("extended")
_CHAT = [f"files AS (SELECT 'chat-' || role AS repo, 'c' || conv_id || '/t' || turn || '.md' AS path, text || chr(10) || '# TODO: if asked for turn ' || turn || chr(10) AS content FROM conversations)"
         if c.startswith("files AS") else c for c in _CHAT]


def _chat_sql(query: str) -> str:
    ctes = O.found_ctes("extended")
    ctes = [_CHAT[1] if c.startswith("files AS") else c for c in ctes]
    return O.with_(ctes, query, recursive=True)


_add("stream_findings", lambda s, d: ST.drain(ST.dedupe_stream(ST.stream_findings(_arriving(s, d))).select(*FINDING)),
     _chat_sql("SELECT repo, rule_id, type, severity, title, description, file, line FROM found"))
_add("stream_progress", lambda s, d: ST.progress(ST.observed(_arriving(s, d)).select("repo", "path")),
     f"WITH {_CHAT[1]} SELECT count(*) AS files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM files")
_add("stream_counts", lambda s, d: ST.drain(ST.running_counts(ST.stream_findings(ST.observed(_arriving(s, d)))), "complete"),
     _chat_sql("SELECT repo, type, severity, count(*) AS count FROM found GROUP BY ALL"))


def _versions(s: SparkSession, d: str) -> DataFrame:
    """Every conversation as a file of which each turn is a version."""
    turns = ST.read_arriving(s, d, "conversations", "conv_id bigint, turn bigint, role string, text string")
    return turns.select(
        F.concat(F.lit("chat"), (F.col("conv_id") % 5).cast("string")).alias("repo"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("turn").alias("version"), F.concat("text", F.lit("\n# TODO: if asked for turn "), F.col("turn").cast("string"), F.lit("\n")).alias("content"))


_LAST = ("files AS (SELECT 'chat' || (conv_id % 5) AS repo, 'c' || conv_id || '.md' AS path, text || chr(10) || '# TODO: if asked for turn ' || turn || chr(10) AS content "
         "FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)")


def _last_sql(query: str, more: list[str] | tuple[str, ...] = ()) -> str:
    ctes = [_LAST if c.startswith("files AS") else c for c in [*O.found_ctes("extended"), *more]]
    return O.with_(ctes, query, recursive=True)


def reaudited(s: SparkSession, d: str) -> DataFrame:
    """What is left of all additions and retractions."""
    changes = s.read.schema(RA.CHANGES).parquet(RA.landed_changes(_versions(s, d)))
    left = RA.signed_findings(changes).groupBy(*FINDING).agg(F.sum("sign").alias("n"))
    return left.where("n <> 0").select(*FINDING)


_add("stream_reaudit", reaudited, _last_sql("SELECT repo, rule_id, type, severity, title, description, file, line FROM found"))
_add("stream_scores", lambda s, d: ST.drain(RA.running_scores(RA.read_changes(s, RA.landed_changes(_versions(s, d)))), "complete"), _last_sql("SELECT * FROM report", _REPORT))
