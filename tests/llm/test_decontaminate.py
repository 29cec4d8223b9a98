import re
from collections import Counter

import pytest

from lintlake.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(10, len(b))
        for s in range(len(b) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[s : s + n]:
                    hit.update(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


P = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(10, P), (9, P), (9, P), (2, "two words"), (3, ""), (4, None), (5, "?!"), (None, "null item of more than ten words that is long enough here")]
TEXTS = [
    (1, "Well: " + P.upper().replace(" ", ", ") + ". End"), (2, "two, WORDS and two words two words"), (3, P[:-9] + " other"), (4, "alpha beta gamma"),
    (5, None), (6, ""), (7, "... ,,"), (None, "some two words"), (8, P + " " + P), (8, P + " " + P), (9, "É two words é"), (10, "xx null item of more than ten words that is long enough here yy"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "r", 1, "k") for i, t in TEXTS], "doc_id bigint, text string, `row` string, width int, words string")
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("most", [D.BROADCAST_BYTES, 0])
def test_hits(tables, most):
    docs, items = tables
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in D.scan(docs, items, broadcast_bytes=most).collect())
    assert got == Counter((i, *plain(t, ITEMS)[:2], tuple(plain(t, ITEMS)[2])) for i, t in TEXTS)


@pytest.mark.parametrize("most", [D.BROADCAST_BYTES, 0])
def test_documents_and_spans_go(tables, most):
    docs, items = tables
    kept = D.remove(docs, items, broadcast_bytes=most)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter(t for _, t in TEXTS if not plain(t, ITEMS)[1])
    cut = {r.doc_id: r.text for r in D.remove(docs, items, spans=True, broadcast_bytes=most).collect()}
    assert cut[1] == "Well: . End" and cut[2] == " and " and cut[9] == "É  é" and cut[4] == "alpha beta gamma" and cut[5] is None
    assert D.remove(docs, items, spans=True).count() == len(TEXTS)


def test_no_items_and_no_documents(spark, tables, odd, none):
    docs, items = tables
    assert {r.n_hit for r in D.scan(docs, items.limit(0)).collect()} == {0}
    assert D.contamination(none, items).collect() == [] and D.remove(none, items).collect() == []
    got = Counter((r.doc_id, r.n_words, r.contaminated) for r in D.contamination(odd, items).collect())
    assert got == Counter((r.doc_id, len(words(r.text)), False) for r in odd.collect())
