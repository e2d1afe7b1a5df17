"""Partitioning, lineage and exact numbering of distributed rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row number in these bits


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Session settings the operators assume; cluster sizes stay the cluster's."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )


SPREAD = "spark.claimloom.scan.partitions"


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Deal rows over as many partitions as the session setting names; else leave them.

    A scan has a task per split, which is right for a large table.  A session on one
    machine, whose table is one file with one row group, sets the number of its cores.
    """
    n = df.sparkSession.conf.get(SPREAD, None)
    if n is None:
        return df
    return df.repartition(int(n), key) if key else df.repartition(int(n))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate results.

    Only a local session that names none, as in tests, gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="claimloom-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint the rows; partitions and the order within them stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read on from it.

    Later steps read only the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str,
    partitions: int | None = None,
) -> DataFrame:
    """Number the rows 1..N in the given order without a single-task sort.

    Rows are range-partitioned and sorted; each partition's row count gives the
    next partition's offset.  The rows are written out before ranging, because
    finding the ranges reads them an extra time, and again with their place, so
    that a lost executor cannot change it between counting and numbering.
    Reports on the numbered rows read the columns they need from that table.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        written(df)
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    fixed = written(ranged)
    part = F.shiftright("_slot", _SLOT_BITS)
    # One row per partition, whatever the number of rows.
    counts = fixed.groupBy(part.alias("part")).count().collect()
    offsets, total = [], 0
    for row in sorted(counts, key=lambda r: r["part"]):
        offsets.append((row["part"], total))
        total += row["count"]
    table = spark.createDataFrame(offsets or [(0, 0)], "_part bigint, _before bigint")
    within = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        fixed.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_before") + within + 1)
        .drop("_part", "_before", "_slot")
    )


def prefix_sums(df: DataFrame, order: Sequence[str], value: str, name: str, rows_per_range: int = 1_000_000) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before each row in the given order.

    In two levels: sums within ranges by a window over each range, and one total a range.
    The rows are written once, with their range; the order must tell rows apart.
    """
    fixed = written(df)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fixed.count() // rows_per_range))
    ranged = written(fixed.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    # One row per range, whatever the number of rows.
    offsets, total = [], 0
    for part, held in sorted(ranged.groupBy("_range").agg(F.sum(value)).collect()):
        offsets.append((part, total))
        total += held or 0
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_range int, _before bigint")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return (
        summed.join(F.broadcast(table), "_range")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_range", "_before", "_within")
    )
