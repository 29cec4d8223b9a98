import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lintlake.llm import queries, suffix_tree
from lintlake.llm.labelled import held_out


def symbols(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return " ".join([*words, "\n"]).encode(), [w.encode() for w in words] + [b"\n"]


def plain(rows, train, depth, gain):
    """n_tokens, n_known, train_tokens, base_score, score of every row, with dictionaries."""
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    words = Counter()
    for (_, text), mark in zip(rows, train):
        if mark:
            data, tokens = symbols(text)
            words.update(tokens)
            padded = b"\n" * depth + data
            for i in range(depth, len(padded)):
                for k in range(depth + 1):
                    counts[k][padded[i - k : i]][padded[i]] += 1
    below = math.log10(sum(words.values()) + len(words) + 1)
    known = {}

    def state(context):
        """Whether the context is a state."""
        if context not in known:
            own = counts[len(context)].get(context)
            total = sum(own.values()) if own else 0
            known[context] = bool(own) and (not context or sum(c * math.log(c / total / prob(context[1:], a)) for a, c in own.items()) >= gain)
        return known[context]

    def prob(context, symbol):
        while not state(context):
            if not context:
                return 1 / 256
            context = context[1:]
        own = counts[len(context)][context]
        above = prob(context[1:], symbol) if context else 1 / 256
        return (own[symbol] + len(own) * above) / (sum(own.values()) + len(own))

    total = sum(words.values())
    out = []
    for i, text in rows:
        data, tokens = symbols(text)
        padded = b"\n" * depth + data
        at, told = depth, 0.0
        for w in tokens:
            token = w if w == b"\n" else w + b" "
            by_tree = math.prod(prob(padded[at + j - depth : at + j], b) for j, b in enumerate(token))
            at += len(token)
            if words[w]:
                told += math.log10(total / (total + len(words)) * (0.5 * by_tree + 0.5 * words[w] / total))
            elif total:
                told += math.log10(len(words) / (total + len(words)))
        base = sum(math.log10(words.get(w, 0) + 1) - below for w in tokens)
        out.append((i, len(tokens), sum(w in words for w in tokens), sum(words.values()), base, told))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4:] for r in got] == [pytest.approx(r[4:], rel=1e-9, abs=1e-9) for r in want]


@pytest.mark.parametrize("depth, gain", [(5, 2.0), (2, 30.0), (0, 2.0)])
def test_equals_a_plain_tree(spark, depth, gain):
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choice("abcÀé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, rows[1][1]), (101, "A  aB\tc\x0b\x0c x\x85y")]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)  # a block each
    same(suffix_tree.score(docs, ~held_out(F.col("doc_id"), 7, 2), depth=depth, gain=gain).collect(), plain(rows, train, depth, gain))


def test_outcomes_share_one(spark):
    """Over all texts of one token after a given one: known words, the unknown one and the end."""
    docs = spark.createDataFrame([(1, "ab abc b"), (2, "abc abc cab"), (3, "")], "doc_id bigint, text string")
    told = suffix_tree.tree(suffix_tree.contexts(suffix_tree.packed(docs, F.lit(True), "doc_id", "text"), 2).select("gram", "n"), 2, 0.0).collect()
    by_context = {}
    for r in told:
        by_context[r.gram >> 8] = by_context.get(r.gram >> 8, 0) + r.p
    assert by_context and all(0.5 < p <= 1 + 1e-9 for p in by_context.values())  # the rest is left to bytes not seen


def test_held_out_documents_beat_the_unigram_base(spark):
    got = [r for r in queries.op11_suffix_tree(spark, "/root/testdata/sf0.001").collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(r.base_score for r in got)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    train = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, _ in rows]
    same(suffix_tree.score(odd, ~held_out(F.col("doc_id"), 7, 2)).collect(), plain(rows, train, suffix_tree.DEPTH, suffix_tree.GAIN))
    assert suffix_tree.score(none, F.lit(True)).collect() == []
    untrained = suffix_tree.score(odd.where("doc_id = 6"), F.lit(None).cast("boolean")).collect()
    assert [tuple(r) for r in untrained] == [(6, 2, 0, 0, 0.0, 0.0)]
