"""The data behind the seven figures; drawing is left to the reader's tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.dates import in_year_scope
from claimloom.functions.labels import source_label, type_label
from claimloom.settings import fixed

STAGES = ("scraped", "relevant", "claims", "sec_claims")


def in_scope(coded: DataFrame, year_min: int = 2018) -> DataFrame:
    """Labelled entries of the years in scope; undated ones stay."""
    return coded.withColumn("source_label", source_label(F.col("doc_content_type"))).where(
        in_year_scope(F.col("year"), year_min)
    )


def _with_share(counts: DataFrame, n: str) -> DataFrame:
    # Counts per label are a handful of rows.
    return counts.withColumn(
        "pct", F.round(100.0 * F.col(n) / F.sum(n).over(Window.partitionBy()), 1)
    )


def funnel(coded: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """Documents and claims per source along the stages of the study.

    All four counts of a source come from one aggregation.
    """
    if counters is None:
        counters = coded.sparkSession.createDataFrame(
            list(fixed.FUNNEL), "source string, scraped bigint, relevant bigint"
        )
    securitising = F.coalesce("is_securitising", F.lit(False))
    counts = coded.groupBy(F.col("source_label").alias("source")).agg(
        F.count("*").alias("claims"),
        F.count_if(securitising).alias("sec_claims"),
        F.count_distinct("doc_id").alias("docs_coded"),
        F.count_distinct(F.when(securitising, F.col("doc_id"))).alias("sec_docs"),
    )
    return (
        counters.join(counts, "source", "left")
        .na.fill(0, ["claims", "sec_claims", "docs_coded", "sec_docs"])
        .withColumn("relevant", F.coalesce("relevant", "docs_coded"))
        .withColumn("scraped", F.coalesce("scraped", "docs_coded"))
    )


def funnel_long(stages: DataFrame) -> DataFrame:
    return stages.unpivot(["source"], list(STAGES), "stage", "count")


def source_share(coded: DataFrame) -> DataFrame:
    counts = coded.groupBy("source_label").agg(
        F.count("*").alias("claims"), F.count_distinct("doc_id").alias("docs")
    )
    return _with_share(counts, "claims")


def _securitising(coded: DataFrame) -> DataFrame:
    return coded.where(F.col("is_securitising"))


def type_by_source(coded: DataFrame) -> DataFrame:
    return (
        _securitising(coded)
        .groupBy("source_label", type_label(F.col("securitisation_type")).alias("sec_type"))
        .agg(F.count("*").alias("n"))
    )


def code_share(coded: DataFrame, column: str) -> DataFrame:
    return _with_share(
        _securitising(coded).groupBy(column).agg(F.count("*").alias("n")), "n"
    )


def by_year_and_source(coded: DataFrame, first: int = 2018, last: int = 2025) -> DataFrame:
    year: Column = F.col("year").try_cast("int")
    return (
        _securitising(coded)
        .withColumn("year", year)
        .where(F.col("year").between(first, last))
        .groupBy("year", "source_label")
        .agg(F.count("*").alias("n"))
    )


def figure_frames(coded: DataFrame, year_min: int = 2018) -> dict[str, DataFrame]:
    rows = in_scope(coded, year_min)
    return {
        "fig1_pipeline_funnel": funnel_long(funnel(rows)),
        "fig2_source_breakdown": source_share(rows),
        "fig3_sec_type_by_source": type_by_source(rows),
        "fig4_referent_objects": code_share(rows, "referent_object"),
        "fig5_threat_actors": code_share(rows, "threat_actor"),
        "fig6_temporal": by_year_and_source(rows, year_min),
        "fig7_measures": code_share(rows, "extraordinary_measure"),
    }
