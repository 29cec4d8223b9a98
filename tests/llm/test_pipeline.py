from collections import Counter

import pytest

import corpus_pipeline
from lintlake.llm import toxicity

from .test_bpe import plain as plain_tokens
from .test_decontaminate import plain as plain_hits
from .test_near_copies import groups
from .test_secrets import plain as plain_secrets

DOC = "{} plain and harmless words number {} of a text that is long enough to be told from every other text by its shingles, you are a reader and a friend indeed {}"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rude = "you are a zorbag and a klumpft vexnor indeed"
    docs = [(i, DOC.format(f"w{i * i}", i, " ".join(f"x{i * k % 97}" for k in range(30))), "en", f"s{i % 3}") for i in range(120)]
    docs = [(i, t + " " + rude if i % 6 == 0 else t, a, b) for i, t, a, b in docs]
    docs += [(200 + i, docs[i][1], "en", "s0") for i in (1, 2, 3)] + [(300, None, None, None), (301, "", "en", "s"), (None, "a text without id", "en", "s")]
    bench = " ".join(f"item{k}" for k in range(14))
    docs += [(400, "before it " + bench + " after it all the rest of the words", "en", "s"), (401, "my password = hunter2222 is here, you are a reader and a friend indeed, harmless words", "en", "s")]
    spark.createDataFrame([(i, t, a, b, None if t is None else len(t)) for i, t, a, b in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, [r.asDict() for r in docs.collect()]
    weights, intercept = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = []
    for r in rows:
        z = sum(float(weights[f]) for f in toxicity.features(r["text"])) + intercept
        if z < -0.8472978603872037:  # log(0.3 / 0.7)
            kept.append(r)
    assert {r["doc_id"] for r in rows} - {r["doc_id"] for r in kept} == {i for i in range(0, 120, 6)}
    best = {}
    for r, k in zip(kept, groups([r["text"] for r in kept])):
        if k not in best or best[k]["doc_id"] is None or r["doc_id"] is not None and r["doc_id"] < best[k]["doc_id"]:
            best[k] = r
    bench = [(1, " ".join(f"item{k}" for k in range(14)))]
    kept = [r for r in best.values() if not plain_hits(r["text"], bench)[1]]
    want = Counter()
    for r in kept:
        text = r["text"]
        for a, _, b in reversed(plain_secrets(text)):
            text = text[:a] + "[secret]" + text[b:]
        ids = plain_tokens(text)[0]
        want[r["doc_id"], len(ids), tuple(ids), None if text is None else len(text)] += 1
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.n_chars) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == columns


def test_empty_tables_and_more_columns(spark, folder, odd, none):
    for docs in (none, odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
