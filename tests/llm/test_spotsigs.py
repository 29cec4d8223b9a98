import bisect
import hashlib
import random
import re

from lintlake.llm import spotsigs as S

ANCHORS = {a.encode() for a in S.ANCHORS}


def plain(text):
    words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    content = [(i, w) for i, w in enumerate(words) if w not in ANCHORS]
    places = [i for i, _ in content]
    out = {(b"", tuple(w for _, w in content[:3]))} if content else set()
    for i, w in enumerate(words):
        chain = tuple(c for _, c in content[bisect.bisect_right(places, i) :][:3])
        if w in ANCHORS and chain:
            out.add((w, chain))
    return out


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_a_plain_version(spark, odd, none, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 4096)  # texts in pieces, rows over batches
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for (k, t), (_, u) in zip(rows, [*rows[1:], rows[0]]):
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), round(likeness(plain(t), plain(e)), 9), round(likeness(plain(t), plain(u)), 9), len(plain(t))))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9), len(S.unpacked(r.fingerprint))) for r in S.fingerprints(odd).collect()]
    order = lambda x: (x[0] is not None, x)
    assert sorted(got, key=lambda x: str(x)) == sorted(want, key=lambda x: str(x))
    assert S.fingerprints(none).collect() == []


def test_one_row_and_equal_texts(spark):
    one = spark.createDataFrame([(5, "the only text of the table is its own next one")], "doc_id bigint, text string")
    r = S.fingerprints(one).first()
    assert r.near_next == 1.0 and r.n_chars == 46
    many = spark.createDataFrame([(i * 7 % 101, f"a text of some words {i % 3} in the {i % 3} row") for i in range(101)], "doc_id bigint, text string").repartition(7)
    rows = {r.doc_id: r for r in S.fingerprints(many).collect()}
    texts = {r.doc_id: r.text for r in many.collect()}
    assert len(rows) == 101 and len({(texts[i], rows[i].fingerprint) for i in rows}) == 3
    for i in rows:
        e = S.edited(texts[i], texts[(i + 1) % 101])
        assert rows[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()


def test_null_ids_alone(spark):
    df = spark.createDataFrame([(None, "b text of it"), (None, "a text of it")], "doc_id bigint, text string")
    got = {r.edited_sha256 for r in S.fingerprints(df).collect()}
    assert got == {hashlib.sha256(S.edited(x, y).encode()).hexdigest() for x, y in (("a text of it", "b text of it"), ("b text of it", "a text of it"))}


def test_pruning():
    import numpy as np

    a, b = np.arange(10, dtype=np.uint32), np.arange(4, dtype=np.uint32)
    assert S.jaccard(a, b) == 0.4 and S.jaccard(a, b, 0.5) == 0.0 and S.jaccard(a[:0], b[:0]) == 1.0 and S.jaccard(a, b[:0]) == 0.0


def test_similar_pairs_against_all_pairs(spark, none):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "to"] * 12
    texts = []
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.choice((3, 12, 60, 300)))]
        for _ in range(4):
            texts.append(" ".join(text))
            text = [rng.choice(words) if rng.random() < 0.04 else w for w in text][: len(text) - rng.randint(0, len(text) // 5)]
    texts += [texts[0], "", None]
    sets, first = [plain(t) for t in texts], {}
    for i, x in enumerate(sets):
        first.setdefault(frozenset(x), i)
    pairs = [(a, b, likeness(sets[a], sets[b])) for a in first.values() for b in first.values() if a < b and sets[a] and sets[b]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    for least in (0.3, 0.8):
        want = {(a, b, round(x, 9)) for a, b, x in pairs if x >= least}
        got = [(r.a, r.b, round(r.likeness, 9)) for r in S.similar(df, least).collect()]
        assert len(want) > 5 and len(got) == len(set(got)) and set(got) == want
    assert S.similar(none, 0.5).collect() == []


def test_length_partitions():
    for least in (0.1, 0.3, 0.5, 0.7, 0.8, 0.9, 1.0):
        bounds = S.length_bounds(500, least)
        part = [bisect.bisect_right(bounds, n) for n in range(501)]
        assert all(part[y] - part[x] <= 1 for x in range(1, 501) for y in range(x, 501) if x >= least * y)
