"""Row numbers that stay distributed when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, else one beside the warehouse tables.

    Both are on the file system that driver and executors share.  A folder that the
    application has set on the context is kept.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def row_numbers(df: DataFrame, name: str, by: list[str], order: list[str | Column]) -> DataFrame:
    """``row_number() over (partition by <by> order by <order>)`` without one task per group.

    The rows are written to a checkpoint first, so that finding the range bounds does not
    compute them a second time; then they are range-partitioned by (by, order) and written
    again, which fixes the partition of every row.  Numbers are then counted inside (partition,
    group), plus the rows of the same group in earlier partitions.  Only the first group
    of a partition can have earlier rows, so the broadcast offsets are at most one row
    per partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(c) for c in by]
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.checkpoint().repartitionByRange(*keys, *sort).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    # One row per (partition, group); a group's rows lie in consecutive partitions.
    w = Window.partitionBy(*by).orderBy("_part") if by else Window.partitionBy(F.lit(0)).orderBy("_part")
    offsets = (
        counts.withColumn("_offset", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .where("_offset IS NOT NULL").drop("_n")
    )
    inner = Window.partitionBy("_part", *by).orderBy(*sort)
    numbered = placed.withColumn("_rn", F.row_number().over(inner))
    # Null is a group like any other, so the keys are compared null-safely.
    named = offsets.select(F.col("_part").alias("_at"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), "_offset")
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return (
        numbered.join(F.broadcast(named), same, "left")
        .withColumn(name, (F.col("_rn") + F.coalesce("_offset", F.lit(0))).cast("bigint"))
        .drop("_rn", "_offset", "_part", "_at", *(f"_by{i}" for i in range(len(by))))
    )
