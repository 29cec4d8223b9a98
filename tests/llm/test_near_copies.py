import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lintlake.llm import near_copies as N


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return frozenset(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def plain_print(shingles):
    h = [int.from_bytes(xxhash.xxh3_128_digest(s, N.SEED), "little") for s in shingles]
    return sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in h) > len(h))


def likeness(x, y):
    return 1.0 if x == y else len(x & y) / len(x | y)


def candidate(a, b):
    d = a ^ b
    return d.bit_count() <= 32 and any((d >> s & 0xFFFF).bit_count() <= 1 for s in range(0, 128, 16))


def groups(texts, all_pairs=False):
    """Sets of places of texts: links of likeness 0.8 among candidates, or among all pairs."""
    sets = [plain_shingles(t) for t in texts]
    prints = [plain_print(s) for s in sets]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or (all_pairs or candidate(prints[i], prints[j])) and likeness(sets[i], sets[j]) >= 0.8:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


def corpus(rng, n=40, copies=3, words=120):
    out = []
    for _ in range(n):
        text = [f"w{rng.randrange(5000)}" for _ in range(words)]
        out.append(" ".join(text))
        for _ in range(copies):
            other = list(text)
            for _ in range(rng.randrange(1, 6)):
                other[rng.randrange(words)] = f"x{rng.randrange(5000)}"
            out.append(" ".join(other))
    return out


def test_fingerprints_against_plain_ones():
    for text in ("", "one", "A b c", "a b c d e f", " ".join(f"w{i % 50}" for i in range(400))):
        found = N.hashes(text.encode().lower().split())
        assert len(found) == len(plain_shingles(text))
        assert int.from_bytes(N.fingerprint(found).tobytes(), "little") == plain_print(plain_shingles(text))


def test_forest_spans_what_is_near():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, (3, 2), dtype=np.uint64)
    rows = np.concatenate([np.repeat(base, 40, axis=0)])
    for r in rows:
        for _ in range(rng.integers(0, 5)):
            r[rng.integers(2)] ^= np.uint64(1 << int(rng.integers(62)))
    out = N.forest(rows[:, 0], rows[:, 1], np.arange(120))
    assert len(out) == 117 and all(i // 40 == j // 40 for i, j in out)
    # parts of equal labels are joined by one link
    assert len(N.forest(rows[:, 0], rows[:, 1], np.arange(120) // 20)) == 3


def test_one_of_each_group_stays(spark):
    rng = random.Random(3)
    texts = corpus(rng)
    # a crowd of near copies, and a chain whose ends are no copies of one another
    hub = [f"h{k}" for k in range(150)]
    for _ in range(90):
        other = list(hub)
        for _ in range(3):
            other[rng.randrange(150)] = f"y{rng.randrange(9000)}"
        texts.append(" ".join(other))
    chain = [f"c{k}" for k in range(200)]
    for k in range(60):
        chain[k * 3] = f"z{k}"
        texts.append(" ".join(chain))
    texts += texts[:20] + ["", None, "  ", "a b", "A  b", "a c"]
    docs = spark.createDataFrame([(1000 + i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, node string").repartition(5)
    out = N.deduplicate(docs)
    assert out.columns == docs.columns
    got = {r.doc_id - 1000: r.text for r in out.collect()}
    root = groups(texts)
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    assert set(got) == set(first.values()) and all(texts[i] == t for i, t in got.items())
    # against all pairs: at least nine of ten rows that should go are gone
    want = len(texts) - len(set(groups(texts, all_pairs=True)))
    assert len(texts) - len(got) >= 0.9 * want


def test_odd_rows(spark, odd, none):
    rows = N.deduplicate(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert N.deduplicate(none).collect() == []


def test_sketches_lose_no_pair(spark):
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (3, 9, 60, 300, 3000)]
    for words in list(texts):
        for share in (0.002, 0.01, 0.02, 0.04, 0.1):
            texts.append([w if rng.random() > share else "other" for w in words])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(len(texts), "")]
    sets = N.with_hashes(spark.createDataFrame(rows, "row bigint, text string"))
    own = [set(N.hashes(t.encode().split())[:, 0].tolist()) for _, t in rows]
    every = [(i, j, False) for i in range(len(rows)) for j in range(i + 1, len(rows))]
    pairs = spark.createDataFrame(every, "a bigint, b bigint, crowd boolean")
    want = {(i, j) for i, j, _ in every if own[i] | own[j] and len(own[i] & own[j]) / len(own[i] | own[j]) >= 0.8}
    kept = {(r.a, r.b) for r in N.possible(pairs, sets).collect()}
    assert want <= kept and len(kept) < len(want) + 20
    assert {(r.a, r.b) for r in N.alike(pairs, sets).collect()} == want and len(want) > 8


def test_pairs_of_a_dense_group_are_ruled_out_before_they_are_rows(spark):
    rng = random.Random(4)
    hub, texts = [f"h{k}" for k in range(150)], []
    for _ in range(160):
        other = list(hub)
        for _ in range(3):
            other[rng.randrange(150)] = f"y{rng.randrange(9000)}"
        texts.append(" ".join(other))
    texts += [" ".join([*t.split(), "end"]) for t in texts[:20]]
    table = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    found = N.with_fingerprints(table, "text", ["row"]).select(F.col("row").alias("node"), "f1", "f2")
    nodes = found.withColumn("label", F.col("node")).localCheckpoint()
    sets = N.with_hashes(table).localCheckpoint()
    every = N.candidates(nodes, whole=True)
    few = N.candidates(nodes.join(sets.withColumnRenamed("row", "node").drop("shingles"), "node"), whole=True)
    links = {(r.a, r.b) for r in N.alike(every, sets).collect()}
    assert len(links) > 15 and {(r.a, r.b) for r in N.alike(few, sets).collect()} == links
    assert every.count() > 5_000 and few.count() < len(links) + 400
    # exactly those that the later step would keep
    assert {(r.a, r.b) for r in few.collect()} == {(r.a, r.b) for r in N.possible(every, sets).collect()}
