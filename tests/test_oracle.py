"""Registered queries against their SQL counterparts on the smallest tables."""

import os

import duckdb
import pytest

import check_queries as C
from lintlake.catalog import registry

SF = "/root/testdata/sf0.001"
NAMES = ["secrets", "long_functions_brace", "unused_imports_python", "duplicate_blocks", "scan_filter_extended", "repo_key",
         "findings_dedup", "findings_basic", "finding_ids", "repo_report", "dir_rollup", "compact_report"]


def test_every_rule_group_is_registered():
    from lintlake.rules import PROFILES

    assert {r.group for rules in PROFILES.values() for r in rules} <= set(registry.QUERIES)
    assert set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in C.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert C.canonical([tuple(r) for r in df.collect()], df.columns) == C.canonical(cur.fetchall(), cols)
