import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lintlake.llm import queries, spelling


def plain(words, times=10):
    """word -> form, root, n, n_near, form_n, from the neighbourhood of one edit."""
    met, around = {}, {w: set() for w in words}
    for w in words:
        for v in {w[:i] + "\0" + w[i:] for i in range(len(w) + 1)} | {w[:i] + "\0" + w[i + 1 :] for i in range(len(w))}:
            met.setdefault(v, []).append(w)
    for group in met.values():
        for a in group:
            around[a].update(b for b in group if a != b and spelling.near(a, b))
    form = {}
    for w, others in around.items():
        f = min(others, key=lambda x: (-words[x], x), default=None)
        if f is not None and words[f] >= times * words[w]:
            form[w] = f
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(around[w]), words[form[w]] if w in form else None)
    return out


def table(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def random_words(rng, letters, sizes, many):
    words = {}
    for _ in range(many):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(*sizes)))
        if words and rng.random() < 0.6:
            w, c = rng.choice(list(words)), rng.choice(letters)
            i = rng.randint(0, len(w))
            w = rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])
        words[w] = int(10 ** rng.uniform(0, 5))
    return words


def test_near():
    cases = {("abc", "abc"): False, ("abc", "abd"): True, ("abc", "ab"): True, ("abc", "axbc"): True, ("abc", "xbd"): False, ("", "a"): True, ("", "ab"): False, ("ab", "ba"): False}
    for (a, b), want in cases.items():
        assert spelling.near(a, b) is want and spelling.near(b, a) is want


def test_no_edit_affects_more_grams_than_the_bound():
    rng = random.Random(5)
    words = sorted(random_words(rng, "abc", (3, 16), 600))
    codes, cuts = spelling._codes(pa.array(words))
    h, grams, counts = None, [], []
    left = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(len(codes))
    for q in range(1, spelling.MOST):
        h = spelling._hashes(codes, q, h)
        if q >= spelling.LEAST:
            g, n = np.unique(h[left >= q], return_counts=True)
            grams.append(g[n > 40])
            counts.append(n[n > 40])
    grams, counts = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(grams)
    keys = {}
    word, key, longer = spelling.listed(pa.array(words), grams[order], counts[order])
    for w, k, s in zip(word, key, longer):
        keys.setdefault((words[w], bool(s)), set()).add(k)
    for a in words:
        for b in words:
            if len(a) <= len(b) and spelling.near(a, b):
                assert keys[a, False] & keys[b, len(b) > len(a)], (a, b)


@pytest.mark.parametrize("letters, sizes, many, dictionary, block", [
    ("ab", (0, 9), 900, 40_000, 2_000), ("abc", (5, 14), 1_500, 300, 20), ("ab漢", (0, 20), 900, 100, 5), ("abcdeé", (7, 9), 1_500, 200, 2_000)])
def test_equals_a_plain_version(spark, letters, sizes, many, dictionary, block):
    words = random_words(random.Random(2), letters, sizes, many)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    assert table(spelling.variants(df, dictionary=dictionary, block=block).collect()) == plain(words)


def test_lists_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BROADCAST_ROWS", -1)
    words = random_words(random.Random(8), "abcd", (7, 9), 600)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert table(spelling.variants(df, block=10).collect()) == plain(words)


def test_odd_rows(spark):
    rows = [(None, 5), ("", 1), ("a", 10), ("a", 10), ("ab", 300), ("x" * 5_000, 2), ("x" * 5_001, 20)]
    df = spark.createDataFrame([(w, n, "c", 1) for w, n in rows], "word string, n bigint, key string, parts int")
    assert table(spelling.variants(df).collect()) == plain({"": 1, "a": 20, "ab": 300, "x" * 5_000: 2, "x" * 5_001: 20})
    assert spelling.variants(df.where("false")).collect() == []


def test_query_equals_its_definition(spark, odd, none, tmp_path):
    rng = random.Random(9)
    stems = ["colours", "honoured", "señoritas", "ÀéîØÞlongword", "programme", "catalogue", "Neighbour"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "", ",", "s", "2"]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(None, "Colours colours"), (None, None), (400, ""), (5, rows[5][1]), (5, rows[5][1])]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    words = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    want = plain({w: n for w, n in words.items() if len(w) >= 7 and n >= 2})
    assert any(v[0] for v in want.values())
    assert table(queries.op13_spelling(spark, str(tmp_path)).collect()) == want
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        queries.op13_spelling(spark, f"{tmp_path}/{name}").collect()
