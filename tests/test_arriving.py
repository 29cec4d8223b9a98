"""Streamed tables that are folders of files, as well as single ones, and streams of no files."""

import pytest

from lintlake.catalog import registry
from lintlake.streaming import audit_stream as ST

TURNS = "conv_id bigint, turn bigint, role string, text string"
ROWS = [(c, t, ("user", "assistant")[t % 2], f"hello {c}\nTODO: {t}") for c in range(12) for t in range(3)]


def table(spark, folder, layout):
    """``conversations`` as a folder of files, or as one file, as the given tables are."""
    if layout == "folder":
        spark.createDataFrame(ROWS, TURNS).repartition(7).write.parquet(f"{folder}/conversations.parquet")
    else:
        spark.createDataFrame(ROWS, TURNS).coalesce(1).write.parquet(f"{folder}/made")
        (part,) = (folder / "made").glob("part-*.parquet")
        (folder / "conversations.parquet").write_bytes(part.read_bytes())
    return str(folder)


@pytest.mark.parametrize("layout", ["folder", "file"])
def test_counts_of_a_table_in_parts(spark, tmp_path, layout):
    d = table(spark, tmp_path, layout)
    got = {(r.repo, r.type, r.severity): r["count"] for r in registry.QUERIES["stream_counts"](spark, d).collect()}
    # a TODO of its own and the one that every file gets
    assert got == {("chat-user", "quality", "info"): 48, ("chat-assistant", "quality", "info"): 24}
    assert registry.QUERIES["stream_progress"](spark, d).first().files == 36


@pytest.mark.parametrize("layout", ["folder", "file"])
def test_scores_of_a_table_in_parts(spark, tmp_path, layout):
    d = table(spark, tmp_path, layout)
    got = {r.repo: (r.total_files, r.total_issues) for r in registry.QUERIES["stream_scores"](spark, d).collect()}
    assert got == {f"chat{k}": (n, 2 * n) for k, n in enumerate([3, 3, 2, 2, 2])}


def test_a_stream_of_no_files_counts_nothing(spark, tmp_path):
    counts = ST.running_counts(ST.stream_findings(ST.read_files(spark, str(tmp_path))))
    out = ST.drain(counts, "complete")
    assert out.columns == ["repo", "type", "severity", "count"] and out.collect() == []
