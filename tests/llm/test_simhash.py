import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from lintlake.llm import simhash
from lintlake.llm.graph import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(fps):
    """Root of every fingerprint, by comparing all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    return root


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(texts):
    long = " ".join(str(i * i % 997) for i in range(simhash.PART + 10))
    for t in [*texts, long, "One two\x0bTHREE\x0cfour \x85five", "ÀÉ à é"]:
        assert simhash.fingerprint((t or "").encode()) == plain_fingerprint(t)


def test_segments_share_a_variant():
    rng = random.Random(3)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for j in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << j
        assert simhash.first_variant(np.array([a ^ b], np.uint64), 4)[0] >= 0


def test_links_join_the_same_components(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(900):  # a crowd around one fingerprint: buckets of more than CROWD
        f = centre
        for j in rng.sample(range(64), rng.randint(0, 5)):
            f ^= 1 << j
        fps.add(f)
    chain = rng.getrandbits(64)
    for j in range(0, 60, 4):  # a long chain
        fps.add(chain)
        chain ^= 0b1111 << j
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint").repartition(5)
    links = simhash.links(df).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 and r.a != r.b for r in links)
    assert len(links) < 20 * len(fps)
    root = {r.node: r.root for r in components(spark.createDataFrame([(r.a, r.b) for r in links], "a bigint, b bigint")).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[root.get(signed(f), signed(f))].add(f)
    for f, r in classes(fps).items():
        want[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(1000, 1001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    rows = odd.select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == Counter((r.doc_id, plain_fingerprint(r.text)) for r in rows)
    root = classes([plain_fingerprint(r.text) for r in rows])
    least = {}
    for r in rows:
        if r.doc_id is not None:
            k = root[plain_fingerprint(r.text)]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(root[r.fp & (2**64 - 1)]) for r in got)
    assert simhash.near_duplicates(none).collect() == []


def test_one_row_of_each_component_stays(spark, odd, none):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == {1: 1, 3: 1, 6: 1, 7: 1, 8: 1, None: 1}
    assert simhash.deduplicate(none).collect() == []
