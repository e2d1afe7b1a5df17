"""Stop rules over ordered rows: the first run of so many bad rows ends a crawl or a probe.

Runs are counted across partitions by a segmented scan.  Rows are cut into ranges of (key,
order); a range counts its runs alone and reports one row about its first and its last
key; these rows, one per range, say which run reaches into which range.  So a key with
a third of all rows is many ranges, not one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from claimloom.plans.layout import written

ROWS_PER_RANGE = 1_000_000


def _carried(reports: list) -> list[tuple[int, int]]:
    """For every range the bad run that reaches into its first key, from the ranges before."""
    out, key, run = [], None, 0
    for r in sorted(reports, key=lambda r: r["_range"]):
        if key is not None and r["first"]["key"] != key[0]:
            run = 0
        out.append((r["_range"], run))
        # What the range hands on belongs to its last key.
        last = r["last"]
        alone = last["key"] == r["first"]["key"] and not last["has_good"]
        run = last["tail"] + (run if alone else 0)
        key = (last["key"],)
    return out


def run_lengths(
    rows: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    run: Sequence[Column],
    names: Sequence[str],
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """For each condition of ``run``, how many rows up to this one hold it without a break.

    Runs are counted within a key in the given order, which must tell a key's rows
    apart; null keys are one key, and a condition that is null does not hold.
    """
    spark = rows.sparkSession
    bad = [f"_bad{i}" for i in range(len(run))]
    fixed = written(rows.withColumns({b: F.coalesce(c, F.lit(False)) for b, c in zip(bad, run)}))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fixed.count() // rows_per_range))
    ranged = fixed.repartitionByRange(n, *key, *order).withColumn("_range", F.spark_partition_id())
    within = Window.partitionBy("_range", *key).orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = ranged.withColumn("_at", F.row_number().over(within))
    good = {f"_good{i}": F.max(F.when(~F.col(b), F.col("_at"))).over(so_far) for i, b in enumerate(bad)}
    scanned = written(scanned.withColumns(good))
    key_of = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    result = scanned
    for i, (b, name) in enumerate(zip(bad, names)):
        g = F.col(f"_good{i}")
        # The last row of a key in its range: the run it ends with, and whether a good row is before.
        last_row = F.max_by(F.struct((F.col("_at") - F.coalesce(g, F.lit(0))).alias("tail"), g.isNotNull().alias("has_good")), F.col("_at"))
        per_key = scanned.groupBy("_range", *key).agg(last_row.alias("_l"), F.min(F.struct(*order)).alias("_o"))
        about = F.struct(key_of.alias("key"), "_l.tail", "_l.has_good")
        place = F.struct(*key, "_o")
        # One row per range, whatever the number of rows or keys.
        reports = per_key.groupBy("_range").agg(F.min_by(about, place).alias("first"), F.max_by(about, place).alias("last")).collect()
        carries = dict(_carried(reports))
        schema = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_first", T.StringType()), T.StructField("_run", T.LongType())])
        table = spark.createDataFrame([(r["_range"], r["first"]["key"], carries[r["_range"]]) for r in reports], schema)
        reaches = g.isNull() & (key_of == F.col("_first"))
        length = F.col("_at") - F.coalesce(g, F.lit(0)) + F.when(reaches, F.col("_run")).otherwise(0)
        result = (
            result.join(F.broadcast(table), "_range")
            .withColumn(name, F.when(F.col(b), length).otherwise(0).cast("bigint"))
            .drop("_first", "_run")
        )
    return result.drop("_range", "_at", *bad, *good)


def until_stop(
    rows: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    bad: Column,
    limit: int,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """The rows a crawl sees: up to the one that completes the first run of ``limit`` bad rows.

    A key without such a run is seen whole.  ``stopped`` marks the row that ends its key.
    """
    counted = written(run_lengths(rows, key, order, [bad], ["_length"], rows_per_range))
    place = F.struct(*order)
    ends = counted.where(F.col("_length") == limit).groupBy(*key).agg(F.min(place).alias("_end"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in key]
    joined = counted.alias("r").join(ends.alias("e"), same, "left") if key else counted.alias("r").join(ends.alias("e"), F.lit(True), "left")
    here = F.struct(*[F.col(f"r.{c}") for c in order])
    return joined.where(F.col("e._end").isNull() | (here <= F.col("e._end"))).select(
        *[F.col(f"r.{c}") for c in rows.columns], F.coalesce(here == F.col("e._end"), F.lit(False)).alias("stopped")
    )


def until_page(
    rows: DataFrame,
    key: Sequence[str],
    page: str,
    order: Sequence[str],
    bad: Column,
    limit: int,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """The rows of a crawl that looks at the run only between pages, as a listing is read.

    A key ends with the first page at whose end ``limit`` bad rows or more stand in a
    row; pages come in the order of their rows.  ``last_page`` marks the rows of that page.
    """
    counted = written(run_lengths(rows, key, order, [bad], ["_length"], rows_per_range))
    at_end = counted.groupBy(*key, page).agg(F.max_by("_length", F.struct(*order)).alias("_length"))
    ends = at_end.where(F.col("_length") >= limit).groupBy(*key).agg(F.min(page).alias("_end"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in key]
    joined = counted.alias("r").join(ends.alias("e"), same, "left")
    seen = joined.where(F.col("e._end").isNull() | (F.col(f"r.{page}") <= F.col("e._end")))
    return seen.select(*[F.col(f"r.{c}") for c in rows.columns], F.coalesce(F.col(f"r.{page}") == F.col("e._end"), F.lit(False)).alias("last_page"))
