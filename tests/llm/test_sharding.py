import zlib
from collections import Counter

import duckdb
import pytest

from lintlake.llm import queries, sharding


def test_shards(spark):
    # one source with a third of all rows, one of a single row
    docs = spark.createDataFrame(
        [(i, "x" * (i % 9) + "é" * (i % 2), ("hot" if i % 3 == 0 else f"s{i % 7}") if i else "lone") for i in range(1000)], "doc_id bigint, text string, source string").repartition(6)
    rows = sharding.interleave(docs).collect()
    by = Counter(r.shard for r in rows)
    assert set(by) == set(range(24)) and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in by.items())
    total, mixed = Counter(r.source for r in rows), Counter((r.shard, r.source) for r in rows)
    assert all(abs(mixed[s, src] - n / 24) < 2 for s in range(24) for src, n in total.items())
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(docs.repartition(3)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(docs, seed="else").collect()}
    assert other != again


def test_odd_rows(odd, none):
    rows = sharding.interleave(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert max(Counter(r.shard for r in rows).values()) == 1
    r = next(r for r in rows if r.doc_id == 4)
    assert (r.size, r.text_crc32, r.slot) == (8, 0, 0)
    assert sharding.interleave(none).collect() == []


@pytest.fixture
def many_partitions(spark):
    """Small tables stay in several range partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_null_is_a_source_over_many_partitions(spark, many_partitions, tmp_path):
    # null is a third of the rows; one source has as many rows, so that their places are equal
    docs = spark.createDataFrame(
        [(i, "x" * (i % 9), (None, "same", f"s{i % 5}")[i % 3]) for i in range(1200)], "doc_id bigint, text string, source string").repartition(6)
    rows = sharding.interleave(docs).collect()
    total, mixed = Counter(r.source for r in rows), Counter((r.shard, r.source) for r in rows)
    assert total[None] == 400
    assert all(abs(mixed[s, src] - n / 24) < 2 for s in range(24) for src, n in total.items())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.OP3_SQL).fetchall()
    got = queries.op3_sharding(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
