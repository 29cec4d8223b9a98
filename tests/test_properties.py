"""Properties of matching on random texts, against a plain Python reading of the rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

PIECES = st.sampled_from(["eval(", "medieval(", "x", " ", "\n", "// TODO", ": y", "99", "100", "'", ".", "\u00e9", "{", "}", "const a = 1", "\n\n"])
TEXTS = st.lists(st.lists(PIECES, max_size=14).map("".join), min_size=1, max_size=12)


LOOP = r"(?:for|while)\s*[\s(]"
CODE = st.sampled_from(["for ", "for(", "while", "{", "}", "(", " ", "\n", "s += 'x'", "'a' + 'b'", "x", "+=", "'"])
LOOPS = st.lists(st.lists(CODE, max_size=16).map("".join), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(LOOPS)
def test_linear_loop_rules_equal_the_plain_patterns(audit, texts):
    found = audit({f"f{i}.js": t for i, t in enumerate(texts)}, groups=("perf_loops",))
    plain = {"PERF-01": LOOP + r"[^{}]*\{[^{}]*" + LOOP + r"[^{}]*\{",
             "PERF-02": LOOP + r"""[^{}]*\{[^}]*(?:\+=\s*['"`]|['"`]\s*\+\s*['"`])"""}
    want = {(f"f{i}.js", rule, 1 + t.count("\n", 0, m.start()))
            for i, t in enumerate(texts) for rule, p in plain.items() for m in re.finditer(p, t, re.A)}
    assert {(f["file"], f["rule_id"], f["line"]) for f in found} == want


def by_hand(text):
    out = set()
    for m in re.finditer(r"\beval\s*\(", text, re.A):
        out.add(("SEC-32", 1 + text.count("\n", 0, m.start())))
    for m in re.finditer(r"\b(TODO|FIXME|HACK|XXX|BUG|OPTIMIZE)\b[:\s]*(.*)", text, re.A | re.I):
        out.add(("Q-02", 1 + text.count("\n", 0, m.start())))
    depth = 0
    for i, line in enumerate(text.split("\n"), 1):
        depth += line.count("{") - line.count("}")
        if depth > 5:
            out.add(("DET-04", i))
            break
    n = 0
    for m in re.finditer(r"(?<![.\w'\"\\])(\d{2,})(?![.\w'\"`])", text, re.A):
        i = 1 + text.count("\n", 0, m.start())
        line = text.split("\n")[i - 1].strip()
        if int(m[1]) in (100,) or line.startswith(("//", "#", "*")) or re.search(r"(?:const|let|var|final|val)\s", line):
            continue
        n += 1
        if n <= 10:
            out.add(("Q-03", i))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_lines_of_matches(audit, texts):
    found = audit({f"f{i}.js": t for i, t in enumerate(texts)}, groups=("dangerous_functions", "todo_comments", "deep_nesting", "magic_numbers"))
    got = {}
    for f in found:
        got.setdefault(f["file"], set()).add((f["rule_id"], f["line"]))
        assert 1 <= f["line"] <= texts[int(f["file"][1:-3])].count("\n") + 1
    assert got == {f"f{i}.js": by_hand(t) for i, t in enumerate(texts) if by_hand(t)}
