"""The audit as a stream of arriving files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rank import ensure_checkpoint_dir
from ..plans.audit import findings as batch_findings

FILES_SCHEMA = "repo string, path string, content string"
# Small batches give steady progress; raise it for throughput.
BATCH_FILES = 5
PROGRESS_KEPT = 100_000


def read_files(spark: SparkSession, path: str, schema: str = FILES_SCHEMA, files_per_batch: int = BATCH_FILES, **options) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).parquet(path)


def read_arriving(spark: SparkSession, sf_dir: str, table: str, schema: str, files_per_batch: int = BATCH_FILES) -> DataFrame:
    """A table's Parquet files as they arrive; the table is one file or a folder of files.

    The name is given as a pattern: Spark takes a plain path of a stream for a folder, and
    a filter on the names of files would leave out the parts of a table that is a folder.
    """
    return read_files(spark, f"{sf_dir}/{{{table}.parquet}}", schema, files_per_batch)


def stream_findings(files: DataFrame, profile: str = "extended", groups: tuple[str, ...] | None = None) -> DataFrame:
    """Findings of a stream.  Rules are projections, so this is the batch plan unchanged;
    dedupe happens inside each file and needs no state."""
    return batch_findings(files, profile, groups)


def dedupe_stream(findings: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Drop findings already seen within ``delay`` in earlier batches (a file that arrives twice).

    The state is bounded by the watermark of the event time; without an event time column
    it is the time at which a batch is taken in.
    """
    key = ["repo", "file", "line", "title"]
    if event_time is not None:
        return findings.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)
    taken = findings.withColumn("_taken", F.current_timestamp()).withWatermark("_taken", delay)
    return taken.dropDuplicatesWithinWatermark(key).drop("_taken")


def running_counts(findings: DataFrame) -> DataFrame:
    """Running counts per repository, type and severity; scores follow from them."""
    return findings.groupBy("repo", "type", "severity").count()


def observed(files: DataFrame, name: str = "progress") -> DataFrame:
    """Report files and lines of each batch through the query's progress events."""
    return files.observe(name, F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines"))


def run_folder(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return "/".join([ensure_checkpoint_dir(spark).rstrip("/"), uuid.uuid4().hex, *parts])


def land(query_input: DataFrame, mode: str = "append") -> str:
    """Process everything that is there; the folder of the result."""
    spark = query_input.sparkSession
    base = run_folder(spark)
    out = f"{base}/out"

    if mode == "append":
        q = query_input.writeStream.format("parquet").option("path", out)
    else:
        # complete/update results replace the table of the batch before; without any batch it is empty
        spark.createDataFrame([], query_input.schema).write.parquet(out)
        q = query_input.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    q = q.option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def drain(query_input: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything that is there, then read the result back as a batch table."""
    return query_input.sparkSession.read.schema(query_input.schema).parquet(land(query_input, mode))


def progress(query_input: DataFrame, name: str = "progress") -> DataFrame:
    """Process everything that is there and add up what ``observed`` has told of each batch (one row)."""
    spark = query_input.sparkSession
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept, "100")
    spark.conf.set(kept, str(PROGRESS_KEPT))
    try:
        q = query_input.writeStream.format("noop").option("checkpointLocation", run_folder(spark, "state")).trigger(availableNow=True).start()
    finally:
        spark.conf.set(kept, before)
    q.awaitTermination()
    if len(q.recentProgress) >= PROGRESS_KEPT:
        raise RuntimeError("more batches than progress events are kept: take more files per batch")
    told = [p.observedMetrics[name] for p in q.recentProgress if name in p.observedMetrics]
    return spark.createDataFrame([(sum(t["files"] or 0 for t in told), sum(t["lines"] or 0 for t in told))], "files bigint, lines bigint")


def cancel(query: StreamingQuery) -> None:
    query.stop()
