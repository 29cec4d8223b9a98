import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lintlake.llm import labelled, quality, toxicity

WORDS = [a + b + c for a in ("th", "er", "on", "an") for b in ("ea", "in", "ti", "or") for c in ("st", "nd", "", "ly")]
RUDE = ["zorbag", "Klumpft", "vexnor"]


def corpus(n=900):
    rng, rows = random.Random(4), []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.choice([5, 40, 200]))]
        toxic, junk = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            for _ in range(1 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        if junk:
            words = [w + rng.choice(["###", "%%%"]) for w in words]
        rows.append((i, " ".join(words), int(toxic), int(not junk)))
    return rows


@pytest.fixture(autouse=True)
def few_steps(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 150)


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _, _ in rows], "doc_id bigint, text string, lang string, score double").repartition(3)
    labels = spark.createDataFrame([(i, q, x) for i, _, x, q in rows if i % 5], "doc_id bigint, quality int, toxic int")
    return rows, docs, labels


@pytest.mark.parametrize("module, column, parts, part", [(toxicity, 2, 4, 2), (quality, 3, 5, 0)])
def test_held_out_rows(tables, module, column, parts, part):
    rows, docs, labels = tables
    got = {r.doc_id: r for r in module.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    right = Counter()
    for row in rows:
        r = got[row[0]]
        assert r.held_out == (zlib.crc32(str(row[0]).encode()) % parts == part) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out:
            right[r.predicted == row[column]] += 1
    assert right[True] / sum(right.values()) > 0.95


def test_labels_of_held_out_rows_are_not_used(spark, tables):
    rows, docs, labels = tables
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) toxic")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]
    x, y = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(x.table, y.table) and np.array_equal(x.last, y.last)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, tables, odd, none, module):
    _, docs, labels = tables
    model = module.train(docs, labels)
    got = module.score(odd, model)
    assert set(got.columns) == set(odd.columns) and got.count() == odd.count()
    by = Counter((r.doc_id, r.score) for r in got.collect())
    assert by[2, next(r.score for r in got.collect() if r.doc_id == 2)] == 2
    assert module.score(none, model).collect() == [] and module.judge(none, labels).collect() == []
    nothing = module.judge(docs.limit(5), labels.limit(0)).collect()
    assert len({r.score for r in nothing}) == 1 and len(nothing) == 5
    strange = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 0, 0), (1, 1, 1), (2, 5, 5)], "doc_id bigint, quality int, toxic int")
    assert module.judge(odd, strange).count() == odd.count()


def test_pieces_of_a_text_count_once(monkeypatch):
    rng = np.random.default_rng(1)
    weights = (rng.normal(size=1 << toxicity.BITS) * (rng.random(1 << toxicity.BITS) < 0.5)).astype(np.float32)
    texts = ["abcd efgh " * 50, None, "", "ab", "É漢字x" * 30, "x"]
    want = [weights[toxicity.features(t)].astype(float).sum() for t in texts]
    monkeypatch.setattr(toxicity, "PIECE", 37)
    assert np.allclose(toxicity.sums(texts, weights), want)


def test_civil_documents_stay(tables):
    rows, docs, labels = tables
    kept = toxicity.keep_civil(docs.withColumnRenamed("lang", "score_of_toxicity"), labels)
    assert kept.columns == ["doc_id", "text", "score_of_toxicity", "score"]
    ids = {r.doc_id for r in kept.collect()}
    assert sum((r[2] == 0) == (r[0] in ids) for r in rows) / len(rows) > 0.95


def test_every_byte_counts_and_chunks_overlap():
    net = quality.fit_filters(np.zeros((2, 512), np.uint8), np.array([0.0, 1.0]), np.zeros((20, 8), int))
    text = bytes(range(1, 200)) * 20
    base, starts = net.pooled(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert starts.tolist() == [0, -(-len(text) // 256) - 1]
    both, s2 = net.pooled(np.frombuffer(b"abc" + text + b"z" * 9, np.uint8), np.array([0, 3, 3, 3 + len(text), 12 + len(text)]))
    assert np.array_equal(both[s2[2] : s2[3]], base) and len(both) == s2[-1] == len(base) + 3
    assert not both[s2[1]].any() and not both[s2[0], : quality.FILTERS].any()


def test_repeated_ids_do_not_make_the_sample_grow(spark, tables):
    rows, docs, labels = tables
    many = docs.crossJoin(spark.range(30)).selectExpr("doc_id", "concat(text, if(id = 0, '', cast(id as string))) text")
    got = labelled.training_rows(many, labels, "toxic", 4, 2, 5).collect()
    assert len(got) == len({r.id for r in got}) == 10
    again = labelled.training_rows(many.repartition(7), labels, "toxic", 4, 2, 5).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}


def test_toxicity_against_dictionaries(tables):
    rows, docs, labels = tables
    weights, intercept = toxicity.train(docs, labels)
    learned = [(set(toxicity.features(t).tolist()), x) for i, t, x, _ in rows if i % 5 and zlib.crc32(str(i).encode()) % 4 != 2]
    n = Counter(x for _, x in learned)
    count = Counter((f, x) for fs, x in learned for f in fs)
    ratio = {}
    for f in {f for fs, _ in learned for f in fs}:
        p, q = count[f, 1], count[f, 0]
        r = math.log((p + 1) / (n[1] + 2)) - math.log((q + 1) / (n[0] + 2))
        if p + q >= 6 and abs(r) >= 1:
            ratio[f] = r
    w, speed, b = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 1e-6), math.log((n[1] + 1) / (n[0] + 1))
    texts = [([f for f in fs if f in ratio], x) for fs, x in learned]
    for _ in range(toxicity.ROUNDS):
        slope = dict.fromkeys(ratio, 0.0)
        for fs, x in texts:
            z = max(-30.0, min(30.0, b + sum(w[f] * ratio[f] for f in fs)))
            error = 1 / (1 + math.exp(-z)) - x
            for f in fs:
                slope[f] += error
        for f in ratio:
            g = slope[f] * ratio[f] / len(texts) + w[f] / len(texts)
            speed[f] += g * g
            w[f] -= 0.3 * g / math.sqrt(speed[f])
    assert set(np.flatnonzero(weights).tolist()) <= set(ratio)
    assert np.allclose([weights[f] for f in ratio], [w[f] * ratio[f] for f in ratio], atol=1e-4)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, (weights, intercept)).collect()}
    for i, t, _, _ in rows[:60]:
        z = intercept + sum(w.get(f, 0) * ratio.get(f, 0) for f in set(toxicity.features(t).tolist()))
        assert abs(scores[i] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-3


def test_quality_against_loops(tables):
    rows, docs, labels = tables
    net = quality.train(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    for i, t, _, _ in sorted(rows, key=lambda r: len(r[1]))[:: len(rows) // 8]:
        text, z = t.encode(), []
        for c in range(quality.chunks_of(len(text))):
            # a filter lies in the text and begins in the chunk
            starts = range(c * 256, min(c * 256 + 512, len(text) - quality.WIDTH + 1))
            best = [max([0.0, *(sum(float(net.table[k, text[s + k], f]) for k in range(quality.WIDTH)) + float(net.bias[f]) for s in starts)]) for f in range(quality.FILTERS)]
            full = max(0, min(len(text) - c * 256, 512) - quality.WIDTH + 1) / 512
            hidden = [max(0.0, sum(x * float(net.w1[j, h]) for j, x in enumerate([*best, full])) + float(net.b1[h])) for h in range(quality.HIDDEN)]
            z.append(max(-20.0, min(20.0, sum(x * float(w) for x, w in zip(hidden, net.w2)) + net.b2)))
        three = [sum(z) / len(z), min(z), max(z)]
        total = net.intercept + sum((x - m) / s * w for x, m, s, w in zip(three, net.mean, net.scale, net.last))
        assert abs(scores[i] - 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))) < 1e-3


def test_draws_reach_all_chunks_and_both_classes():
    y, counts = np.array([0.0] * 9 + [1.0]), np.array([1] * 9 + [400])
    text, chunk = quality.draws(y, counts)
    assert abs(y[text].mean() - 0.5) < 0.02 and (chunk < counts[text]).all()
    assert len(np.unique(chunk[text == 9])) == 400
