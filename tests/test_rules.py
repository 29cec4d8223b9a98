"""Every rule fires on its snippet; boundaries and quirks of single rules."""

import pytest

from lintlake.catalog.snippets import SNIPPETS
from lintlake.rules import PROFILES


def lines(found, rule):
    return [(f["file"], f["line"]) for f in found if f["rule_id"] == rule]


@pytest.mark.parametrize("profile", ["extended", "basic"])
def test_every_rule_fires_somewhere(audit, profile):
    files = {(f"f{i}{s}" if s.startswith(".") else f"f{i}/{s}"): b for i, (s, b) in enumerate(SNIPPETS)}
    fired = {(f["rule_id"], f["title"]) for f in audit(files, profile)}
    assert {(r.id, r.title) for r in PROFILES[profile]} - fired == set()


def test_prefilters_never_lose_a_match(spark):
    """With and without required literals and first bytes, the same lines are found."""
    from dataclasses import replace

    from lintlake.plans.audit import findings

    df = spark.createDataFrame(
        [("r", f"f{i}{s}" if s.startswith(".") else f"f{i}/{s}", b) for i, (s, b) in enumerate(SNIPPETS)],
        "repo string, path string, content string")
    for profile, rules in PROFILES.items():
        plain = [r for r in rules if r.detector is None]
        key = ["rule_id", "file", "line"]
        with_needs = {tuple(x) for x in findings(df, profile, rules=plain, select=False).select(*key).collect()}
        without = {tuple(x) for x in findings(
            df, profile, rules=[replace(r, needs=()) for r in plain], select=False).select(*key).collect()}
        assert with_needs == without


def test_line_length_boundary(audit):
    smile = "\U0001F600"
    found = audit({"a.txt": "\n".join(["w" * 120, "w" * 121, smile * 60, smile * 60 + "w", "# " + "w" * 200, "http" + "w" * 200])})
    assert lines(found, "Q-01") == [("a.txt", 2), ("a.txt", 4)]
    by_line = {f["line"]: f for f in found if f["rule_id"] == "Q-01"}
    assert by_line[2]["description"] == "Line 2 is 121 chars (>120)."
    assert by_line[2]["code_text"] == "w" * 80 + "..."
    assert by_line[4]["code_text"] == smile * 40 + "..."


def test_long_function_boundary(audit):
    def js(n):
        return "function f() {\n" + "x();\n" * (n - 2) + "}\n"

    found = audit({"a50.js": js(50), "b51.js": js(51), "c.js": "function f() {\n" + "x();\n" * 80})
    assert lines(found, "DET-01") == [("b51.js", 1)]
    f = next(f for f in found if f["rule_id"] == "DET-01")
    assert f["description"] == '"f" is 51 lines. Consider splitting it.'
    assert f["code_text"] == "function f() { ... } // 51 lines" and f["code"] is None if "code" in f else True


def test_python_function_is_closed_by_dedent_or_def(audit):
    body = "  x = 1\n" * 50
    found = audit({
        "a.py": "def f():\n" + body + "# c\n@d\ny = 1\n", "b.py": "def f():\n" + body, "c.py": "async def f():\n" + body + "y\n",
        "d.py": "def f():\n" + body + "  def g():\n    pass\n"})
    assert lines(found, "DET-02") == [("a.py", 1), ("d.py", 1)]
    assert [f["description"] for f in found if f["rule_id"] == "DET-02"] == ['"f" is 53 lines.', '"f" is 51 lines.']


def test_nesting_reports_first_line_only(audit):
    found = audit({"a.js": "{{{{{\n{\n{{\n", "b.js": "{{{{{", "c.py": "{{{{{{{", "d.scss": "{{{{{{"})
    assert [(f["file"], f["line"], f["description"]) for f in found if f["rule_id"] == "DET-04"] == [
        ("a.js", 2, "Nesting depth 6 at line 2. Hard to read/maintain."), ("d.scss", 1, "Nesting depth 6 at line 1. Hard to read/maintain.")]


def test_duplicate_block(audit):
    block = "alpha one\nbeta two\ngamma three\ndelta four\n"
    found = audit({
        "a.txt": block + "mid\n" + block + "end\nend2\n", "short.txt": block + block.rstrip("\n"),
        "tiny.txt": ("aaaa\nbbbb\ncccc\ndddd\nx\n" * 2).strip(), "trivial.txt": "a\nb\nc\nd\n" * 4})
    assert [(f["file"], f["line"], f["description"]) for f in found if f["rule_id"] == "DET-05"] == [
        ("a.txt", 6, "Lines 6-9 duplicate lines 1-4.")]


def test_magic_numbers_are_capped_and_filtered(audit):
    many = "".join(f"f({n})\n" for n in range(70, 90))
    found = audit({"a.js": many, "b.js": "f(10, 255, 443)\nconst a = 99\nf(1.25)\nf('77')\nf(007)\nf(11)\n// 55\nf(33); g(34)\n"})
    assert [l for f, l in lines(found, "Q-03") if f == "a.js"] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [l for f, l in lines(found, "Q-03") if f == "b.js"] == [6, 8]


def test_quirks(audit):
    found = audit({
        "a.js": "x.innerHTML = '<b>'\nx.innerHTML ='<b>'\nhashlib.md5(x)\n",
        "b.py": "yaml.load(f, Loader=X)\nyaml.load(f) # Loader\nmalloc(x)\n",
        "c.c": "malloc(n); free(p)\nmalloc(n)\n",
    })
    assert lines(found, "SEC-40") == [("a.js", 1)]
    assert lines(found, "SEC-43") == [("a.js", 3)] and lines(found, "SEC-47") == [("a.js", 3)]
    assert lines(found, "SEC-60") == [("b.py", 1)]
    assert lines(found, "PERF-17") == [("c.c", 2)]


def test_non_ascii_space_and_word_boundary(audit):
    found = audit({"a.py": "eval\u00a0(x)\n\u00e9eval(x)\ndef\n# TODO\u3000: x\n"})
    # ECMAScript: no-break space is white space, an accented letter is no word character
    assert lines(found, "SEC-32") == [("a.py", 1), ("a.py", 2)]
    assert [f["description"] for f in found if f["rule_id"] == "Q-02"] == ["x"]


def test_pattern_definitions_are_spared_but_secrets_are_not(audit):
    token = "ghp" + "_" + "a" * 36
    found = audit({"a.js": f"{{ pattern: /eval(x)/g }}\nnew RegExp('eval(')\neval(1)\n{{ pattern: /{token}/ }}\n"})
    assert lines(found, "SEC-32") == [("a.js", 3)]
    assert lines(found, "SEC-05") == [("a.js", 4)]


def test_unused_names(audit):
    found = audit({
        "a.js": "const used = 1; let once = 2; var twice = 3\nused\nconst _p = 4\n",
        "b.ts": "import { A, B as C } from 'm'\nimport D from 'n'\nD()\n",
        "c.py": "import os, sys\nimport x # note\nfrom m import (n,\nsys\n",
        "d.go": "import (\n \"a/fmt\"\n al \"b/c\"\n _ \"d\"\n)\nfmt.X\n",
        "e.rs": "use a::{B, C};\nuse a::*;\n",
        "f.cs": "using System.IO;\nusing Lib.Core;\n",
        "g.java": "import a.B;\nimport a.*;\nimport static a.c.D;\nD\n",
    })
    got = [(f["file"], f["line"], f["description"]) for f in found if f["type"] == "unused"]
    assert got == [
        ("a.js", 1, '"once" is defined but not used elsewhere in this file.'),
        ("b.ts", 1, '"A" is imported but never used.'),
        ("c.py", 1, '"os" is imported but not used.'), ("c.py", 2, '"x # note" is imported but not used.'),
        ("c.py", 3, '"(n" is imported but not used.'),
        ("d.go", 1, '"b/c" appears unused.'), ("e.rs", 1, '"a::{B, C}" appears unused.'),
        ("f.cs", 2, '"using Lib.Core" may be unused.'), ("g.java", 1, '"a.B" appears unused.'),
    ]


def test_many_names_use_the_sorted_path(audit):
    text = "".join(f"const n{i} = {i}\n" for i in range(200)) + "".join(f"n{i}\n" for i in range(0, 200, 2))
    found = audit({"a.js": text}, groups=("unused_variables",))
    assert [f["line"] for f in found] == [i + 1 for i in range(1, 200, 2)]


def test_basic_back_references(audit):
    found = audit({"a.js": "for (let i = 2; i < 12; i++) { n++; }\nfor (let i = 2; j < 12; i++) { n++; }\nf(a); f(a); f(a);\ng(); g();\n"}, "basic")
    loop = next(f for f in found if f["rule_id"] == "B-30")
    assert (loop["line"], loop["suggestion"]["code"]) == (1, "n += 10; // Instead of looping 10 times")
    assert loop["description"] == "This loop runs 10 times and increments a counter by 1 each time. This can be simplified."
    assert lines(found, "B-30") == [("a.js", 1)] and lines(found, "B-31") == [("a.js", 3)]


def test_context_is_clamped_and_highlighted(audit):
    found = audit({"a.js": "eval(1)\nx\n", "b.js": "y\neval(2)"}, groups=("dangerous_functions",), context=True)
    assert [[(c["number"], c["highlight"]) for c in f["code"]] for f in found] == [[(1, True), (2, False)], [(1, False), (2, True)]]


def test_marker_character_in_the_text_is_harmless(audit):
    found = audit({"a.js": "\u0007x\neval(1)\n\u0007\n"}, groups=("dangerous_functions",))
    assert [f["line"] for f in found] == [2]


def test_long_spans_and_many_repeats_do_not_exhaust_the_stack(audit):
    gap = "x\n" * 100_000
    found = audit({
        "a.cs": "new SqlCommand(" + gap + "+ y", "b.py": "import time\n" + gap + "time.sleep(1)",
        "c.go": "defer f.Close()\n" + gap + "for", "d.go": "import (\n" + '"a/b"\n' * 20_000 + ")"})
    assert lines(found, "SEC-30") == [("a.cs", 1)] and lines(found, "PERF-06") == [("b.py", 1)]
    assert lines(found, "PERF-14") == [("c.go", 1)]
    found = audit({"e.js": "f(a);\n" * 30_000, "f.css": "/*" + gap + "return \n*/"}, "basic")
    assert lines(found, "B-31") == [("e.js", 1)] and lines(found, "B-44") == [("f.css", 1)]


def test_loop_rules_are_linear_in_the_text(audit):
    found = audit({"a.js": "for x " * 150_000 + "{", "b.js": "for (x) {" * 100_000 + " s"}, groups=("perf_loops",))
    assert lines(found, "PERF-01") == [("b.js", 1)]
