"""A stream of file versions: additions, retractions and running scores."""

from pyspark.sql import functions as F

from lintlake.functions.text import MARK
from lintlake.operators import scoring
from lintlake.plans.audit import audit_files, findings
from lintlake.rules import profile_rules
from lintlake.streaming import audit_stream as ST
from lintlake.streaming import reaudit as RA

A = "# TODO: one\nx = eval(y)\n"
B = "# TODO: two\nx = eval(y)\n# FIXME: more\n"
COLS = ["repo", "rule_id", "file", "line", "title", "description"]


def write(spark, path, *rows):
    spark.createDataFrame(list(rows), RA.VERSIONED_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def follow(spark, src, base):
    """Handle what is new in ``src``; the changes so far, and the scores after it."""
    changes = RA.file_changes(ST.read_files(spark, src, RA.VERSIONED_SCHEMA, files_per_batch=1))
    with RA.state_store(spark):
        q = changes.writeStream.format("parquet").option("path", f"{base}/changes").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    scores = RA.running_scores(RA.read_changes(spark, f"{base}/changes"))
    told = scores.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/scores")).option(
        "checkpointLocation", f"{base}/totals").outputMode("complete").trigger(availableNow=True).start()
    told.awaitTermination()
    return spark.read.schema(RA.CHANGES).parquet(f"{base}/changes"), spark.read.parquet(f"{base}/scores")


def left(changes):
    rows = RA.signed_findings(changes).groupBy(*COLS).agg(F.sum("sign").alias("n")).where("n <> 0").collect()
    assert all(r.n == 1 for r in rows)
    return sorted(tuple(r)[:-1] for r in rows)


def expected(spark, rows):
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    report = scoring.repo_report(audit_files(files), profile_rules("extended"))
    return sorted(map(tuple, findings(files).select(*COLS).collect())), sorted(map(tuple, report.collect()))


def test_versions_out_of_order_and_a_restart(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "run")
    write(spark, src, ("r", "a.py", 2, B), ("r", "b.py", 1, A), (None, "x.py", 1, A), ("r", "n.py", None, A))
    write(spark, src, ("r", "a.py", 1, A))  # late
    changes, scores = follow(spark, src, base)
    want, report = expected(spark, [("r", "a.py", B), ("r", "b.py", A)])
    assert left(changes) == want and sorted(map(tuple, scores.collect())) == report
    # The stream stops and goes on: a newer version, the same content again, an older one, a file that is gone.
    write(spark, src, ("r", "a.py", 3, A), ("s", "c.py", 1, f"# TODO: ring {MARK}\n"))
    write(spark, src, ("r", "a.py", 4, A), ("r", "b.py", 0, B), ("s", "d.py", 1, A))
    write(spark, src, ("s", "d.py", 2, None), ("s", "e.py", 5, None))
    changes, scores = follow(spark, src, base)
    want, report = expected(spark, [("r", "a.py", A), ("r", "b.py", A), ("s", "c.py", f"# TODO: ring {MARK}\n")])
    assert left(changes) == want and sorted(map(tuple, scores.collect())) == report
    signed = RA.signed_findings(changes)
    assert signed.where("sign = -1").count() > 0
    assert changes.where("path = 'a.py' AND version IN (1, 4)").isEmpty() and changes.where("path = 'e.py'").isEmpty()


def test_versions_of_one_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, *[("r", "a.py", v, f"# TODO: {v}\n") for v in (3, 1, 5, 2, 4)])
    changes = spark.read.schema(RA.CHANGES).parquet(RA.landed_changes(ST.read_files(spark, src, RA.VERSIONED_SCHEMA)))
    assert left(changes) == expected(spark, [("r", "a.py", "# TODO: 5\n")])[0] and changes.count() == 1


def test_no_files(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, (None, None, None, None))
    changes = spark.read.schema(RA.CHANGES).parquet(RA.landed_changes(ST.read_files(spark, src, RA.VERSIONED_SCHEMA)))
    assert changes.collect() == [] and RA.running_scores(changes).collect() == []
