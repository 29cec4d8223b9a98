"""One pass over the corpus, linear rule forms, caps, reports, skipped files, restarted streams."""

import json
import os
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.functions.text import MARK
from lintlake.operators import findings as FD
from lintlake.operators import rank
from lintlake.operators import scoring as SC
from lintlake.operators.classify import file_stats
from lintlake.plans.audit import audit_files, findings
from lintlake.rules import profile_rules
from lintlake.sources import readers, sinks
from lintlake.streaming import audit_stream as ST

FILES = "repo string, path string, content string"
RULES = profile_rules("extended")
SAMPLE = [("r", "b.js", "// TODO x\neval(1)\nf(99)\n" * 3), ("r", "s/a.js", "".join(f"f({n})\nx\n" for n in range(70, 79))), ("q", "c.py", "eval(1)\n"), ("p", "clean.py", "x = 1\n")]


def counted(spark, rows):
    """The rows as a table that counts how often it is read."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return spark.createDataFrame(rows, FILES).mapInPandas(run, FILES), seen


@pytest.mark.parametrize("use", [
    lambda f: FD.assign_ids(findings(f)), lambda f: FD.sorted_by(findings(f), "file"), lambda f: FD.compact_lines(findings(f)),
    lambda f: SC.file_badges(SC.file_counts(audit_files(f), RULES)), lambda f: SC.dir_rollup(SC.file_counts(audit_files(f), RULES)),
    lambda f: FD.ci_gate(SC.file_counts(audit_files(f), RULES)), lambda f: SC.corpus_rollup(audit_files(f), RULES), lambda f: SC.repo_report(audit_files(f), RULES),
], ids=["ids", "sorted", "compact", "badges", "dirs", "gate", "corpus", "report"])
def test_the_corpus_is_read_once(spark, use):
    files, seen = counted(spark, SAMPLE)
    assert use(files).collect() and seen.value == len(SAMPLE)


def test_no_folder_of_one_machine(spark):
    assert rank.ensure_checkpoint_dir(spark)
    assert all("tempfile" not in open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(os.path.dirname(rank.__file__) + "/..") for f in fs if f.endswith(".py"))


BASIC_LOOP = r"(?:for|while)\s*\([^)]*\)\s*\{"
CODE = st.sampled_from(["for (", "while(", "{", "}", ")", "(", " ", "\n", "s += 'x'", "'a' + 'b'", "x", ") {", "for (;;) {", "/*", "*/", "if ", "return\n", "const ", "import time", "time.sleep", " import "])
PLAIN = {
    ("basic", "perf_basic"): {"B-29": BASIC_LOOP + r"[^{}]*" + BASIC_LOOP, "B-32": BASIC_LOOP + r"""[^}]*(?:\+=\s*['"`]|['"`]\s*\+\s*['"`])"""},
    ("basic", "commented_code_basic"): {"B-44": r"/\*[\s\S]*?(?:const|let|var|function|if|for|while|return)\s+[\s\S]*?\*/"},
    ("extended", "perf_python"): {"PERF-06": r"\bimport\s+time[\s\S]*?time\.sleep"},
}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(CODE, max_size=18).map("".join), min_size=1, max_size=60))
def test_linear_forms_equal_the_plain_patterns(audit, texts):
    for (profile, group), patterns in PLAIN.items():
        found = audit({f"f{i}.py": t for i, t in enumerate(texts)}, profile=profile, groups=(group,))
        want = {(f"f{i}.py", rule, 1 + t.count("\n", 0, m.start())) for i, t in enumerate(texts) for rule, p in patterns.items() for m in re.finditer(p, t, re.A)}
        assert {(f["file"], f["rule_id"], f["line"]) for f in found if f["rule_id"] in patterns} == want


def test_long_hard_texts_take_seconds(audit):
    texts = {"a.py": "for (x " * 60_000, "b.py": "for (x) {" * 50_000, "c.py": "/* if x\n" * 60_000, "d.py": "import time\n" * 40_000, "e.py": "while (a) { x " * 30_000}
    begin = time.time()
    for profile, groups in (("basic", ("perf_basic", "commented_code_basic")), ("extended", ("perf_python",))):
        audit(texts, profile=profile, groups=groups)
    assert time.time() - begin < 60


@pytest.mark.parametrize("n", [63, 64, 65])
def test_unused_names_around_the_switch(audit, n):
    text = "\n".join(f"const name{i} = 1;" for i in range(n)) + "\n" + " ".join(f"name{i}" for i in range(0, n, 2)) + "\n"
    got = {f["line"] for f in audit({"a.js": text}, groups=("unused_variables",))}
    assert got == {i + 1 for i in range(1, n, 2)}


def test_caps_are_arguments(spark):
    from dataclasses import replace

    text = "\n".join(f"f({n});" for n in range(1200, 1230)) + "\n"
    df = spark.createDataFrame([("r", "a.js", text)], FILES)
    for cap, n in ((10, 10), (None, 30), (3, 3)):
        rules = [replace(r, cap=cap) if r.detector == "magic" else r for r in RULES]
        found = findings(df, rules=rules)
        assert found.where("title = 'Magic Number'").count() == n
    assert FD.info_top(found, None).count() == found.where("severity = 'info'").count()
    assert FD.compact_lines(findings(df, rules=[replace(r, cap=None) for r in RULES]), cap=None).where("text LIKE '... and%'").count() == 0


def test_rules_are_chosen_by_what_is_asked_for(spark):
    df = spark.createDataFrame(SAMPLE, FILES)
    for keep in (lambda r: r.severity == "critical", lambda r: r.type == "performance", lambda r: r.severity != "info"):
        rules = FD.rules_for(RULES, keep)
        titles = {r.title for r in RULES if keep(r)}
        some = findings(df, rules=rules).select("repo", "file", "line", "rule_id", "title")
        every = findings(df).select("repo", "file", "line", "rule_id", "title")
        assert {tuple(r) for r in some.collect() if r.title in titles} == {tuple(r) for r in every.collect() if r.title in titles}


def test_report_header_and_code(spark):
    files = spark.createDataFrame(SAMPLE, FILES)
    audited = audit_files(files, rules=RULES)
    issues = FD.assign_ids(findings(files, context=True))
    docs = {(r.repo, r.section): json.loads(r.json) for r in sinks.report_documents(SC.repo_report(audited, RULES), issues, file_stats(files), timestamp="2024-01-01T00:00:00.000Z").collect()}
    head = docs["r", "header"]
    assert head["repository"] == "r" and head["timestamp"] == "2024-01-01T00:00:00.000Z" and head["statistics"]["languages"] == {"JavaScript": 2}
    assert head["statistics"]["totalIssues"] == len(docs["r", "issues"]) and set(head["scores"]) == {"security", "performance", "quality", "cleanliness", "overall"}
    item = next(x for x in docs["q", "issues"])
    assert item["code"][0] == {"number": 1, "content": "eval(1)", "highlight": True} and "code_text" not in item
    assert ("p", "issues") not in docs and docs["p", "header"]["statistics"]["languages"] == {"Python": 1}


def test_compact_heading_of_a_clean_repository(spark):
    files = spark.createDataFrame(SAMPLE, FILES)
    rows = FD.compact_lines(findings(files), SC.repo_report(audit_files(files, rules=RULES), RULES)).where("repo = 'p'").orderBy("section", "position").collect()
    assert [r.text for r in rows] == ["Files: 1", "Lines: 2", "Score: 100 (A+)", "Security 100, Performance 100, Quality 100, Cleanliness 100", "No issues found."]


def test_findings_are_written_and_read_back(spark, tmp_path):
    found = FD.assign_ids(findings(spark.createDataFrame(SAMPLE, FILES)))
    sinks.write_findings(found, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f")).drop("bucket")
    cols = ["repo", "id", "rule_id", "file", "line", "title"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, found.select(*cols).collect()))


def test_missing_files_are_told_and_other_errors_fail(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for i in range(5):
        (tmp_path / "a" / f"f{i}.py").write_text(f"x = {i}\n")
    listed = readers.list_directory(spark, str(tmp_path), "r").persist()
    assert listed.count() == 5
    os.rename(tmp_path / "a" / "f0.py", tmp_path / "a" / "gone.txt")
    rows = {r.path: (r.content, r.error) for r in readers.read_contents(listed.drop("error"), skipped=True).collect()}
    assert rows["a/f0.py"] == (None, "FileNotFoundError") and rows["a/f1.py"] == ("x = 1\n", None)
    assert readers.read_contents(listed.drop("error")).count() == 4
    missing = readers.list_directory(spark, str(tmp_path / "none"), "r").collect()
    assert [(r.error, r.path) for r in missing] == [("FileNotFoundError", "")]
    with pytest.raises(Exception):
        readers.read_contents(listed.drop("error").limit(1).selectExpr("repo", "path", "size_bytes", "'nosuch://x/y' AS uri")).collect()


def test_texts_written_as_files_are_read_back(spark, tmp_path):
    rows = [("r", f"d{i % 3}/f{i}.py", f"print({i})\n\u00e9") for i in range(20)]
    for _, p, c in rows:
        path = tmp_path / "src" / p
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(c, encoding="utf-8")
    got = readers.scan_directory(spark, str(tmp_path / "src"), "r").select("repo", "path", "content").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_bell_characters_come_back(audit):
    found = audit({"a.py": f"# TODO ring the {MARK} bell\n"}, groups=("todo_comments",))
    assert [f["description"] for f in found] == [f"ring the {MARK} bell"]


def test_stream_stops_and_goes_on(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    cols = ["repo", "file", "line", "title"]

    def go():
        stream = ST.dedupe_stream(ST.stream_findings(ST.read_files(spark, src, files_per_batch=1))).select(*cols)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    spark.createDataFrame(SAMPLE[:2], FILES).write.parquet(src)
    go()
    spark.createDataFrame(SAMPLE[1:], FILES).write.mode("append").parquet(src)  # one file comes again
    q = go()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, findings(spark.createDataFrame(SAMPLE, FILES)).select(*cols).collect()))
    ST.cancel(q)
    assert not q.isActive


def test_badges_evaluate_the_rules_once(spark):
    """A filter on the counters must not be pushed below the hits, which would find them again."""
    seen = spark.sparkContext.accumulator(0)

    def hits(n):
        seen.add(1)
        return [{"rix": r.rix} for r in RULES[:n]]

    found = F.udf(hits, "array<struct<rix:int>>")("n").alias("hits")
    audited = spark.createDataFrame([("r", f"f{n}", n) for n in range(5)] + [("r", None, 2), (None, "f", 1)], "repo string, path string, n int").select("repo", "path", found)
    got = {(r.repo, r.file): r.total for r in SC.file_badges(SC.file_counts(audited, RULES)).collect()}
    assert got == {("r", "f1"): 1, ("r", "f2"): 2, ("r", "f3"): 3, ("r", "f4"): 4, ("r", None): 2, (None, "f"): 1}
    assert seen.value == 7
