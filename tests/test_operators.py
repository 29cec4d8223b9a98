"""Selection, scores, ranking, sources, sinks and streams on small inputs."""

import base64
import json

from pyspark.sql import functions as F

from lintlake.functions import paths as P
from lintlake.functions.text import js_trim, utf16_len
from lintlake.operators import findings as FD
from lintlake.operators import scoring as SC
from lintlake.operators import selection as SEL
from lintlake.operators.classify import classify_language
from lintlake.operators.rank import row_numbers
from lintlake.plans.audit import audit_files, findings
from lintlake.rules import profile_rules
from lintlake.sources import readers, sinks
from lintlake.streaming import audit_stream as ST

FILES = "repo string, path string, content string"


def test_text_helpers(spark):
    row = spark.createDataFrame([("a\U0001F600", "\u00a0 x\ufeff\n")], "a string, b string").select(
        utf16_len(F.col("a")).alias("n"), js_trim(F.col("b")).alias("t")).first()
    assert (row.n, row.t) == (3, "x")


def test_selection_and_languages(spark):
    cases = {
        "src/cabinet.js": (None, "ignored"), ".github/x.yml": ("ignored_dir", "ignored"), "a/app.min.js": ("binary", None),
        "img/logo.svg": ("binary", "binary"), ".env": (None, None), "x.R": (None, "unsupported"), "MyDockerfile": ("unknown_language", None),
        "notes.unknown": ("unknown_language", "unsupported"), "Cargo.lock": ("binary", "unsupported"), "tmp/a/b/c.py": ("ignored_dir", None),
    }
    df = spark.createDataFrame([("r", p, 10) for p in cases] + [("r", "big.py", 1048577), ("r", "max.py", 1048576)], "repo string, path string, size_bytes bigint")
    ext = {r.path: r.skip_reason for r in SEL.skip_reason(df).collect()}
    basic = {r.path: r.skip_reason for r in SEL.skip_reason(df, "basic").collect()}
    assert {p: (ext[p], basic[p]) for p in cases} == cases
    assert (ext["big.py"], ext["max.py"], basic["big.py"]) == ("too_big", None, None)
    langs = {r.path: (r.language, r.family) for r in classify_language(spark.createDataFrame(
        [(p,) for p in ("v/x.blade.php", "v/a.b.blade.php", ".env", "A.PY", "Dockerfile", "x.R", "a.d/b")], "path string")).collect()}
    assert langs == {"v/x.blade.php": ("Blade", "html"), "v/a.b.blade.php": ("PHP", "php"), ".env": ("Environment", "env"),
                     "A.PY": ("Python", "python"), "Dockerfile": ("Dockerfile", "docker"), "x.R": ("R", "r"), "a.d/b": ("Other", "other")}


def test_ignored_directory_counts_once(spark):
    df = spark.createDataFrame([("r", "dist/a.js", 1), ("r", "dist/b/c.js", 1), ("r", "x/dist/a.js", 1), ("r", "a.png", 1), ("r", "b.png", 1)],
                               "repo string, path string, size_bytes bigint")
    assert {(r.skip_reason, r.skipped) for r in SEL.skip_counts(df).collect()} == {("ignored_dir", 2), ("binary", 2)}


def test_repo_key_and_grades(spark):
    df = spark.createDataFrame([("https://github.com/o/r.git",), ("git@x:github.com/o/r/tree/main",), ("o/r",), ("o/ r",), ("nothing",)], "u string")
    assert [r[0] for r in df.select(P.repo_key(F.col("u"))).collect()] == ["o/r", "o/r", "o/r", None, None]
    assert [r[0] for r in df.select(P.repo_key(F.col("u"), strict=False)).collect()][3] == "o/ r"
    got = [r[0] for r in spark.range(55, 101).select(P.letter_grade(F.col("id"))).collect()]
    assert (got[0], got[60 - 55], got[97 - 55], got[96 - 55]) == ("F", "D-", "A+", "A")


def _scores(spark, rows):
    df = spark.createDataFrame([("r", t, s) for t, s, n in rows for _ in range(n)], "repo string, type string, severity string")
    r = SC.score_findings(df).first()
    return r.security, r.performance, r.quality, r.cleanliness, r.overall


def test_score_cases(spark):
    assert _scores(spark, [("security", "critical", 1), ("security", "warning", 1)]) == (80, 100, 100, 100, 93)
    assert _scores(spark, [(t, "info", 1) for t in SC.CAPS]) == (99, 99, 99, 99, 99)
    assert _scores(spark, [(t, "critical", 9) for t in SC.CAPS]) == (40, 60, 60, 70, 55)
    assert _scores(spark, [("other", "odd", 2)]) == (100, 100, 98, 100, 100)


def test_report_includes_clean_repositories(spark):
    files = spark.createDataFrame([("a", "x.js", "eval(1)\n"), ("b", "y.md", "fine")], FILES)
    rules = profile_rules("extended")
    audited = audit_files(files, rules=rules)
    rows = {r.repo: r for r in SC.repo_report(audited, rules).collect()}
    assert (rows["b"].overall, rows["b"].grade, rows["b"].total_issues) == (100, "A+", 0)
    assert rows["a"].summary == "Analyzed 1 files (2 lines). 1 critical issue need immediate attention. Overall the codebase is in good shape."
    again = {r.repo: r for r in SC.report_of_findings(findings(files), audited.withColumn("lines", F.size("lines"))).collect()}
    assert again == rows


def test_row_numbers_with_one_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 70).cast("string"))).alias("g"),
                                  F.hash("id").alias("h"), "id")
    got = row_numbers(df, "rn", ["g"], ["h", "id"]).collect()
    expected = {}
    for r in sorted(got, key=lambda r: (r.g, r.h, r.id)):
        expected[r.g] = expected.get(r.g, 0) + 1
        assert r.rn == expected[r.g]
    assert len(got) == 5000


def test_row_numbers_without_groups(spark):
    got = sorted(r.rn for r in row_numbers(spark.range(1000), "rn", [], ["id"]).collect())
    assert got == list(range(1, 1001))


def _sample(spark):
    return spark.createDataFrame([
        ("r", "b.js", "// TODO x\neval(1)\nf(99)\n" * 3), ("r", "a.js", "".join(f"f({n})\nx\n" for n in range(70, 79))), ("q", "c.py", "eval(1)\n")], FILES)


def test_dedupe_is_idempotent_and_independent_of_partitioning(spark):
    f = findings(_sample(spark)).select("repo", "file", "line", "title", "rule_id", "ord", "seq")
    once = sorted(map(tuple, f.collect()))
    assert sorted(map(tuple, FD.dedupe_findings(f.unionByName(f)).collect())) == once
    assert sorted(map(tuple, findings(_sample(spark).repartition(7)).select(*f.columns).collect())) == once


def test_filters_ids_and_order(spark):
    f = findings(_sample(spark))
    ids = FD.assign_ids(f).orderBy("repo", "id").collect()
    assert [(r.repo, r.id) for r in ids][:1] == [("q", 1)]
    r_ids = [(r.id, r.file, r.ord, r.seq) for r in ids if r.repo == "r"]
    assert [x[0] for x in r_ids] == list(range(1, len(r_ids) + 1)) and [x[1:] for x in r_ids] == sorted(x[1:] for x in r_ids)
    assert {r.severity for r in FD.min_severity(f, "critical").collect()} == {"critical"}
    assert FD.min_severity(f, "nonsense").count() == f.count()
    assert FD.under_path(f, "a").select("file").distinct().count() == 1
    gate = {r.repo: r.gate for r in FD.ci_gate(SC.file_counts(audit_files(_sample(spark)), profile_rules("extended"))).collect()}
    assert gate == {"r": True, "q": True}
    top = FD.info_top(f, 3).collect()
    assert [(r.file, r.position) for r in sorted(top, key=lambda r: r.position)] == [("a.js", 1), ("a.js", 2), ("a.js", 3)]
    order = FD.sorted_by(f, "severity").where("repo = 'r'").orderBy("position").collect()
    assert [r.severity for r in order] == sorted((r.severity for r in order), key=FD.SEVERITY_SORT.get)


def test_unicode_collation_order(spark):
    rows = [("r", p, "info", "t", 1, 0, 0) for p in ("a", "B", "_x", "A")]
    df = spark.createDataFrame(rows, "repo string, file string, severity string, type string, line int, ord int, seq int")
    assert [r.file for r in FD.sorted_by(df, "file").orderBy("position").collect()] == ["_x", "a", "A", "B"]


def test_directory_scan(spark, tmp_path):
    root = tmp_path / "my repo"
    for name, data in {"a/b c.js": b"eval(1)\n", "n.bin": b"\0", "dist/x.js": b"eval(2)", "dist/y/z.js": b"", ".git/c": b"", "bad.py": b"x = '\xff'\neval(1)\n", "p%q.md": b"ok"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "link.js").symlink_to(root / "a/b c.js")
    (root / "pkg").mkdir()
    (root / "pkg/__init__.py").write_text("x")
    (root / ".env").write_text("A=1")
    listed = readers.list_directory(spark, str(root), "mine")
    assert {(r.skip_reason, r.skipped) for r in SEL.skip_counts(listed).collect()} == {("ignored_dir", 2), ("binary", 1)}
    kept = readers.scan_directory(spark, str(root), "mine")
    assert sorted((r.path, r.size_bytes) for r in kept.collect()) == [
        (".env", 3), ("a/b c.js", 8), ("bad.py", 16), ("p%q.md", 2), ("pkg/__init__.py", 1)]
    assert {r.file for r in findings(kept).where("type = 'security'").collect()} == {"a/b c.js", "bad.py"}
    assert "\ufffd" in kept.where("path = 'bad.py'").first().content


def test_payloads_and_trees(spark):
    text = "h\u00e9llo\n"
    packed = base64.encodebytes(text.encode()).decode()
    df = spark.createDataFrame([("r", "a", "base64", packed), ("r", "b", None, None), ("r", "c", "utf-8", "raw"), ("r", "d", "base64", "")],
                               "repo string, path string, encoding string, content string")
    assert [r.content for r in readers.decode_payloads(df).orderBy("path").collect()] == [text, "", "raw", ""]
    tree = json.dumps([{"path": "a.py", "type": "blob", "size": 3}, {"path": "d", "type": "tree"}, {"path": "b.js", "type": "blob"}])
    blobs = readers.tree_blobs(spark.createDataFrame([("r", tree)], "repo string, tree string"))
    assert sorted(map(tuple, blobs.collect())) == [("r", "a.py", 3), ("r", "b.js", 0)]


def test_report_documents_are_paged_and_whole(spark, tmp_path):
    files = _sample(spark)
    rules = profile_rules("extended")
    audited = audit_files(files, rules=rules)
    found = FD.assign_ids(findings(files, context=True))
    stats = audited.select("repo", "path", "language", "family", F.size("lines").alias("lines"), F.length("content").alias("size"))
    docs = sinks.report_documents(SC.repo_report(audited, rules), found, stats, page=4)
    pages = [r for r in docs.collect() if r.repo == "r" and r.section == "issues"]
    ids = [x["id"] for r in sorted(pages, key=lambda r: (r.page, r.part)) for x in json.loads(r.json)]
    assert ids == list(range(1, found.where("repo = 'r'").count() + 1)) and max(len(json.loads(r.json)) for r in pages) == 4
    small = [r for r in sinks.report_documents(SC.repo_report(audited, rules), found, stats, page=4, page_bytes=600).collect()
             if r.repo == "r" and r.section == "issues"]
    assert [x["id"] for r in sorted(small, key=lambda r: (r.page, r.part)) for x in json.loads(r.json)] == ids and len(small) > len(pages)
    sinks.write_report_json(docs, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == docs.count()
    sinks.write_findings(found, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == found.count()
    sinks.write_compact(FD.compact_lines(found), str(tmp_path / "t"))
    text = [r.value for r in spark.read.text(str(tmp_path / "t")).where("repo = 'q'").collect()]
    assert text == ["Critical (1):", "c.py:1 — Dangerous Function: eval()"]


def test_dead_files(spark):
    df = spark.createDataFrame([("r", "a.js", "import x from './lib/b'"), ("r", "lib/b.js", "1"), ("r", "self.py", "import self"), ("q", "b.js", "1")], FILES)
    assert sorted((r.repo, r.path) for r in SC.dead_files(df).collect()) == [("q", "b.js"), ("r", "a.js"), ("r", "self.py")]


def test_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    _sample(spark).repartition(3).write.parquet(src)
    _sample(spark).coalesce(1).write.mode("append").parquet(src)  # every file arrives twice
    stream = ST.read_files(spark, src, files_per_batch=1)
    cols = ["repo", "file", "line", "title"]
    got = sorted(map(tuple, ST.drain(ST.dedupe_stream(ST.stream_findings(stream)).select(*cols)).collect()))
    assert got == sorted(map(tuple, findings(_sample(spark)).select(*cols).collect()))
    counts = ST.drain(ST.running_counts(ST.dedupe_stream(ST.stream_findings(ST.read_files(spark, src)))), "complete")
    assert sum(r["count"] for r in counts.collect()) == len(got)
