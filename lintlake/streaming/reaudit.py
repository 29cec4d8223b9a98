"""A re-audit as a stream: files arrive in versions, findings are added and taken back.

The state of a file is its last version, the digest of its content, its number of lines and
its hits.  A newer version replaces them and tells the difference: hits that are new and
hits that are gone.  An older version, which comes late, changes nothing; nor does the same
content again.  So the sum of all changes is what an audit of the last versions finds,
however versions are dealt into batches and in whatever order they arrive.

The changes are written as a table, one row per file and change.  Two readers follow it:
``signed_findings`` (additions and retractions) and ``running_scores`` (statistics, scores
and grade of every repository after each batch, from sums of counters with signs).

State is one row per file of the corpus, held by key in the state store; it does not expire,
for a file that is not heard of again keeps its findings.  A version without content
takes the file out.  Of equal versions the first to be handled stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import MARK, swapped
from ..operators.scoring import hit_kinds, report_of_counters
from ..plans.audit import audit_files, explode_hits
from ..rules import profile_rules
from ..rules.model import Rule
from .audit_stream import land

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSIONED_SCHEMA = "repo string, path string, version bigint, content string"
STATE = "version bigint, digest string, lines bigint, marked boolean, hits array<string>"
CHANGES = ("repo string, path string, version bigint, files int, lines bigint, added array<string>, removed array<string>, "
           "added_marked boolean, removed_marked boolean")


class FileVersions(StatefulProcessor):
    """Holds the last version of a file and tells what a newer one changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        newest = None
        for batch in rows:
            for row in batch.itertuples(index=False):
                if newest is None or row.version > newest.version:
                    newest = row
        if newest is None or (before is not None and newest.version <= before[0]):
            return
        gone = newest.digest is None or pd.isna(newest.digest)
        hits = [] if gone else [str(h) for h in newest.hits]
        lines = 0 if gone else int(newest.lines)
        digest, marked = None if gone else newest.digest, False if gone else bool(newest.marked)
        self.last.update((int(newest.version), digest, lines, marked, hits))
        old = before or (None, None, 0, False, [])
        if old[1] == digest:
            return
        had, has = set(old[4]), set(hits)
        yield pd.DataFrame([{
            "repo": key[0], "path": key[1], "version": int(newest.version), "files": (digest is not None) - (old[1] is not None), "lines": lines - int(old[2]),
            "added": [h for h in hits if h not in had], "removed": [h for h in old[4] if h not in has], "added_marked": marked, "removed_marked": bool(old[3])}])

    def close(self) -> None:
        pass


def file_changes(files: DataFrame, profile: str = "extended", rules: list[Rule] | None = None) -> DataFrame:
    """Changes of a stream of ``repo, path, version, content``; write them in append mode.

    The session's state store must be the one of RocksDB (``state_store``).
    """
    rules = profile_rules(profile) if rules is None else rules
    known = files.where("repo IS NOT NULL AND path IS NOT NULL AND version IS NOT NULL")
    # Files that are taken out need no audit, but pass by the same key.
    audited = audit_files(known.where("content IS NOT NULL"), profile, rules=rules, keep=("version",))
    present = audited.select(
        "repo", "path", "version", F.sha2(F.col("content").cast("binary"), 256).alias("digest"), F.size("lines").cast("bigint").alias("lines"),
        swapped(F.col("content")).alias("marked"), F.transform("hits", lambda h: F.to_json(h)).alias("hits"))
    absent = known.where("content IS NULL").select(
        "repo", "path", "version", F.lit(None).cast("string").alias("digest"), F.lit(0).cast("bigint").alias("lines"), F.lit(False).alias("marked"), F.array().cast("array<string>").alias("hits"))
    return present.unionByName(absent).groupBy("repo", "path").transformWithStateInPandas(
        FileVersions(), outputStructType=CHANGES, outputMode="Append", timeMode="None")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside have the state store that ``file_changes`` needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def landed_changes(files: DataFrame, profile: str = "extended", rules: list[Rule] | None = None) -> str:
    """Handle all versions that are there; the folder of the table of changes."""
    with state_store(files.sparkSession):
        return land(file_changes(files, profile, rules))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A table of changes as a stream."""
    return spark.readStream.schema(CHANGES).parquet(path)


def _hits(column: str) -> Column:
    return F.transform(column, lambda h: F.from_json(h, HIT))


HIT = "struct<line:int,tkey:int,ord:int,seq:int,rix:int,a:string,b:string,text:string>"


def signed_findings(changes: DataFrame, profile: str = "extended", rules: list[Rule] | None = None) -> DataFrame:
    """Findings with ``version`` and ``sign``: 1 where one is added, -1 where it is taken back."""
    rules = profile_rules(profile) if rules is None else rules
    parts = F.array(*(F.struct(F.lit(s).alias("sign"), F.col(f"{n}_marked").alias("marked"), _hits(n).alias("hits")) for s, n in ((1, "added"), (-1, "removed"))))
    rows = changes.select("repo", "path", "version", F.inline(parts))
    # the character that matching swaps is told by the content's mark
    rows = rows.select("repo", "path", "version", "sign", F.when(F.col("marked"), F.lit(MARK)).otherwise(F.lit("")).alias("content"), "hits")
    return explode_hits(rows, rules, keep=("version", "sign"))


def running_scores(changes: DataFrame, profile: str = "extended", rules: list[Rule] | None = None) -> DataFrame:
    """The report of every repository so far; of a stream, in complete mode or (changed repositories only) update mode.

    A repository whose files are all gone has a row of no files.
    """
    rules = profile_rules(profile) if rules is None else rules
    kinds, code = hit_kinds(rules)
    each = [F.transform(_hits(n), lambda h: code(h["rix"])).alias(n) for n in ("added", "removed")]
    placed = changes.select("repo", "files", F.col("lines").alias("n"), *each)
    counted = placed.select("repo", "files", "n", *[
        (F.size(F.filter("added", _is(c))) - F.size(F.filter("removed", _is(c)))).alias(f"{t}_{s}") for c, (t, s) in enumerate(kinds)])
    return report_of_counters(counted, kinds, profile)


def _is(code: int):
    return lambda k: k == code
