import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lintlake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCAB = bpe.vocabulary(bpe.read_vocabulary(PATH))


def plain(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    got = VOCAB.encode_block(texts)
    assert got == [(" ".join(map(str, i)), d) for i, d in map(plain, texts)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeth'slr <|endoftx>É1!", max_size=80))
def test_texts_of_few_letters(text):
    assert VOCAB.encode_block([text, text + "<|endoftext|>"]) == [(" ".join(map(str, i)), d) for i, d in map(plain, [text, text + "<|endoftext|>"])]


def test_long_words_and_all_code_points():
    texts = ["th" * 5000 + "e", "a" * bpe.LONG_WORD, "ab" * bpe.LONG_WORD + "!"]
    texts += ["".join(f"a{chr(c)}1 {chr(c)}b " for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(1, 0x30000, 64)]
    assert VOCAB.encode_block(texts) == [(" ".join(map(str, i)), d) for i, d in map(plain, texts)]


def test_caches_may_turn_over(monkeypatch):
    v = bpe.Vocabulary(bpe.read_vocabulary(PATH))
    v.word_cache, v.chunk_cache = bpe.Recent(5), bpe.Recent(5)
    for k in range(6):
        texts = [f"one two w{k}{i} three" for i in range(7)]
        assert [x[0] for x in v.encode_block(texts)] == [" ".join(map(str, plain(t)[0])) for t in texts]


def test_odd_rows(spark, odd, none):
    out = bpe.encode(odd.withColumnRenamed("key", "n_tokens"), PATH, digests=True)
    assert {"fp", "row", "c0", "ids"} < set(out.columns) and "text" not in out.columns
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in out.collect())
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids, text = plain(r.text)
        want[(r.doc_id, len(ids), tuple(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want
    back = bpe.decode(out, PATH)
    assert Counter((r.doc_id, r.text) for r in back.select("doc_id", "text").collect()) == Counter((r.doc_id, plain(r.text)[1]) for r in odd.collect())
    assert bpe.encode(none, PATH).collect() == []


def test_a_worker_is_left_as_it_was_found(spark):
    import gc

    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma")], "doc_id long, text string").coalesce(1)
    kept = {r["doc_id"]: r for r in bpe.encode(docs, PATH, digests=True).collect()}
    left = {r["doc_id"]: r for r in bpe.encode(docs, PATH, digests=True, cache=1, block=1, keep=False).collect()}
    assert kept == left

    def collecting(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()] * batch.num_rows)], names=["on"])

    assert all(r["on"] for r in docs.select("doc_id").mapInArrow(collecting, "on boolean").collect())
