import random
import re
from collections import Counter

from lintlake.llm import secrets as S

KINDS = {r.kind: r for r in S.BASE + S.MORE}


def plain(text):
    """Spans by searching every text with every rule, the base ones as their definition says."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for n, r in enumerate(S.MORE, 3):
        out += [(m.start(), n, m.end()) for m in re.compile(r.pattern, re.A | (re.I if r.fold else 0)).finditer(text)]
    return sorted(out)


EXAMPLES = [
    "password=hunter22", "Passwd : 'abcdef'", 'api_key"="a.b-c/d=', "APIKEY:123456", "token = 12345", "secret==abcdef", "ſecret=abcdef", "toKen=abcdef", "passwordpassword:longer1",
    "AKIA" + "A" * 16, "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 20, "a" * 24, "f" * 23, "é" + "0123456789abcdef" * 2 + "g", "-----BEGIN RSA PRIVATE KEY-----",
    "ghp_" + "a" * 36, "xoxb-" + "1" * 20, "AIza" + "b" * 35, "sk_live_" + "9" * 20, "Authorization: Bearer " + "t" * 20, "https://user:pass1@host.example", "eyJhbGciOi.eyJ", "漢字 token:  \"日本\" token:abcdefg",
    "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12,
]


def test_index_finds_what_a_full_search_finds():
    rng = random.Random(2)
    texts = EXAMPLES + [None, ""] + ["".join(rng.choice(EXAMPLES + [" ", "x", "\n", "É", "pass", "key", ":", "="]) for _ in range(6)) for _ in range(1500)]
    import pyarrow as pa

    got = S.index(S.BASE + S.MORE).scan(pa.array(texts, pa.string()))
    assert got == [plain(t) for t in texts]
    assert {n for spans in got for _, n, _ in spans} == set(range(len(S.BASE + S.MORE)))


def test_queries():
    assert S.trigram_query("abcd") == ("and", frozenset({"abc", "bcd"}))
    assert S.trigram_query("(abc|xyz)+") == ("or", frozenset({"abc", "xyz"}))
    assert S.trigram_query("ab?cde") == ("or", frozenset({("and", frozenset({"abc", "bcd", "cde"})), ("and", frozenset({"acd", "cde"}))}))
    assert S.trigram_query("[0-9a-f]{24,}") is True and S.trigram_query("a.b|cde") is True
    assert S.trigrams_of(S.trigram_query(S.BASE[0].pattern)) >= {"pas", "tok", "sec", "api"}


def test_odd_rows(odd, none):
    got = Counter((r.doc_id, tuple((x.kind, x.start, x.end) for x in r.secrets)) for r in S.find(odd).collect())
    kinds = list(KINDS)
    assert got == Counter((r.doc_id, tuple((kinds[n], a, b) for a, n, b in plain(r.text))) for r in odd.collect())
    assert S.digests(none).collect() == []
    r = next(r for r in S.digests(odd).collect() if r.doc_id == 3)
    assert (r.n_assign, r.spans, r.base_sha256[:8]) == (0, "", "e3b0c442")


def test_redaction(odd, none):
    out = S.redact(odd)
    assert out.columns == odd.columns and S.redact(none).collect() == []
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == "The quick brown fox. [secret]!" and got[1].n_chars == len(got[1].text)
    assert got[4].text is None and got[3].text == "" and "AKIA" not in got[8].text
