"""The registered queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, periodic, quality, secrets, sharding, simhash, spelling, spotsigs, suffix_tree, toxicity, url_filters
from .common import read
from .labelled import held_out


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True, ids=False)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_filters.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    rows = sharding.interleave(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.digests(read(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return spotsigs.fingerprints(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit by benchmark windows, and the items they come from, of every document."""
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document."""
    docs, kept = read(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2)
    told = suffix_tree.score(docs, ~kept)
    return told.select("doc_id", kept.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: of every tenth document by CRC-32, the words from some place on repeat with a period that follows from the id."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.expr("(n - a) div (3 + g % 8)"))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int")))
    spun = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a").cast("int")), tail)
    return rows.select("doc_id", F.when(F.col("n") > 0, spun).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document."""
    return periodic.digests(periodic.periodic(_with_repeats(read(spark, sf_dir, "documents"))))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent enough word of the documents."""
    runs = spelling.runs_of_letters(read(spark, sf_dir, "documents"), 7)
    words = spelling.with_typos(runs, 31).groupBy("word").agg(F.count("*").alias("n"))
    return spelling.variants(words.where((F.char_length("word") >= 7) & (F.col("n") >= 2)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of what the corpus pipeline keeps."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_url_filters": op2_url_filters,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_html": op5_html,
    "op6_spotsigs": op6_spotsigs,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_suffix_tree": op11_suffix_tree,
    "op12_periodic": op12_periodic,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}

# Words of the benchmark's windows in SQL: windows are joined to windows, positions counted once.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, gram)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS digest
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

def _url_filters_sql(turns: int = url_filters.TURNS) -> str:
    """The rules, the links and both rankings in SQL, a table per turn."""
    head = r"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
rows_ AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(text, rhost, rpath, rverdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, text, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(text) DESC) AS k
  FROM rows_ JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
judged AS (
  SELECT r.page_id, r.host, r.path, f.text AS rule, f.rverdict AS verdict FROM rows_ r LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON r.page_id = f.page_id),
hosts AS (
  SELECT host, sum(CASE WHEN verdict = 'allow' THEN 1 ELSE 0 END) / count(*) AS allowed, sum(CASE WHEN verdict = 'block' THEN 1 ELSE 0 END) / count(*) AS blocked
  FROM judged GROUP BY host),
targets AS (
  SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^<>]*?href\s*=\s*["'']?\s*(?:https?:)?//([^"''\s>]+)', 1)) AS t FROM rows_),
pairs AS (
  SELECT src, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path
  FROM targets),
links AS (SELECT src, dst, count(*) AS n FROM pairs WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
fwd AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links),
bwd AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links),
away AS (
  SELECT dst, path, row_number() OVER () AS k FROM pairs WHERE src <> dst AND src <> '' AND dst <> '' AND dst NOT IN (SELECT host FROM hosts)),
away_rule AS (
  SELECT k, arg_max(rverdict, length(text)) AS v FROM away JOIN rules ON (dst = rhost OR ends_with(dst, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k),
seeds AS (
  SELECT * FROM hosts UNION ALL
  SELECT dst, sum(CASE WHEN v = 'allow' THEN 1 ELSE 0 END) / count(*), sum(CASE WHEN v = 'block' THEN 1 ELSE 0 END) / count(*)
  FROM away LEFT JOIN away_rule USING (k) GROUP BY dst),
t0 AS (SELECT host, allowed * 0.15 AS r FROM seeds), d0 AS (SELECT host, blocked * 0.15 AS r FROM seeds)"""
    for i in range(1, turns + 1):
        for name, edges in (("t", "fwd"), ("d", "bwd")):
            head += f""",
{name}{i} AS (SELECT host, sum(r) AS r FROM (
  SELECT host, r FROM {name}0 UNION ALL SELECT dst, r * share * 0.85 FROM {name}{i - 1} JOIN {edges} ON host = src) GROUP BY host)"""
    return head + f"""
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN d.r - t.r >= 0.75 * 0.15 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j JOIN t{turns} t ON j.host = t.host JOIN d{turns} d ON j.host = d.host
"""


# CRC-32 by a table of all bytes, folded over the bytes of each text; ranks and places by windows.
OP3_SQL = r"""
WITH RECURSIVE turns AS (
  SELECT i, i AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM turns WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM turns WHERE k = 8),
hexed AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
summed AS (
  SELECT doc_id, source, CAST(length(h) // 2 + 8 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
                    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM hexed, tab),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY md5('lintlake|' || doc_id)) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS place FROM summed),
placed AS (SELECT *, row_number() OVER (ORDER BY place, source, md5('lintlake|' || doc_id)) - 1 AS p, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * 24 // n AS INTEGER) AS shard, CAST(p - (((p * 24 // n) * n + 23) // 24) AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""


def _secrets_sql() -> str:
    """Every rule over every text: matches are set off by a mark, places are sums of lengths."""
    rules = secrets.BASE + secrets.MORE
    parts = []
    for n, r in enumerate(rules):
        pattern = ("(?i)" if r.fold else "") + r.pattern
        quoted = pattern.replace("'", "''")
        long = f"length(regexp_extract(ps[i], '{quoted}', {r.group})) >= {r.least}" if r.least else "true"
        parts.append(f"""
  SELECT doc_id, {n} AS k, '{r.kind}' AS kind, length(array_to_string(ps[1:i - 1], '')) AS s, length(array_to_string(ps[1:i], '')) AS e
  FROM (SELECT doc_id, ps, unnest(range(2, len(ps), 2)) AS i FROM (
    SELECT doc_id, string_split(regexp_replace(text, '{quoted}', chr(6) || '\\0' || chr(6), 'g'), chr(6)) AS ps FROM documents WHERE regexp_matches(text, '{quoted}')))
  WHERE {long}""")
    counts = ", ".join(f"count(*) FILTER (k = {n}) AS n_{r.kind}" for n, r in enumerate(secrets.BASE))
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH spans AS ({" UNION ALL ".join(parts)}),
told AS (
  SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(secrets.BASE)}) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN told USING (doc_id)
"""


SQL: dict[str, str] = {
    "op3_sharding": OP3_SQL,
    "op4_secrets": _secrets_sql(),
    "op2_url_filters": _url_filters_sql(),
    "op8_decontamination": OP8_SQL,
}
