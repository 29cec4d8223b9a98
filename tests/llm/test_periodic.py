import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from lintlake.llm import periodic, queries


def plain(w, length=6, exponent=4):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, n = i, j + q - i
            if n >= max(length, exponent * q) and not any(all(w[k] == w[k + r] for k in range(s, s + n - r)) for r in range(1, q)):
                out.add((s, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    """A row of the query, from its definition."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = periodic.find(w) if len(w) > 400 else plain(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("length, exponent", [(6, 4), (2, 2), (6, 3), (9, 2)])
def test_runs_equal_a_search_of_all_periods(length, exponent):
    rng = random.Random(1)
    for _ in range(800):
        n, k = rng.randint(0, 40), rng.randint(1, 4)
        w = [str(rng.randrange(k)) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert periodic.find(w, length, exponent) == plain(w, length, exponent)


def test_many_runs_and_long_texts():
    a, b = "a", "ab"
    for _ in range(12):
        a, b = b, b + a
    assert periodic.find(list(b), 6, 3) == plain(list(b), 6, 3)
    assert periodic.find(["x"] * 50_000) == [(0, 50_000, 1)]  # sets of many pieces
    assert periodic.find([str(i % 5000) for i in range(50_000)]) == [(0, 50_000, 5000)]


def test_ordered_sets_of_many_pieces():
    rng = random.Random(2)
    numbers = rng.sample(range(100_000), 5_000)
    held, seen = periodic.Positions(numbers[0]), [numbers[0]]
    for x in numbers[1:]:
        before, after = held.add(x)
        assert before == max((y for y in seen if y < x), default=-1) and after == min((y for y in seen if y > x), default=-1) if len(seen) < 500 else True
        seen.append(x)
    assert list(held) == sorted(numbers) and all(len(p) <= periodic.CHUNK for p in held.pieces)


def test_odd_rows(spark, odd, none):
    got = periodic.periodic(odd.withColumn("runs", odd.part)).collect()
    assert len(got) == odd.count() and [c for c in got[0].asDict()][-2:] == ["runs", "collapsed"]
    assert periodic.periodic(none).collect() == []
    texts = {r.doc_id: r for r in got}
    assert texts[4].runs == [] and texts[4].collapsed == "" and texts[5].collapsed == ""


def test_query_equals_its_definition(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab c dé".split(" ")) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (None, "a a a a a a a b"), (None, None), (7, "x " * 100), (7, "x " * 100)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, queries.op12_periodic(spark, str(tmp_path)).collect()), key=key) == sorted((digest(i, t) for i, t in rows), key=key)
