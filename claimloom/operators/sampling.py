"""Filters and reproducible samples of claims.

Samples are drawn by the order of a hash of the row's key and a seed: the same
rows come back whatever the partitioning, and each task keeps only its own best
rows before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.labels import source_label
from claimloom.operators.reports import count_where
from claimloom.settings import fixed


def lottery(key: Column, seed: int) -> Column:
    """A fixed pseudo-random rank for a key."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")).cast("binary"))


def filter_claims(
    claims: DataFrame,
    category: str | None = None,
    term: str | None = None,
    doc_id: str | None = None,
    juncture: str | None = None,
    junctures: Mapping[str, tuple[str, str]] = fixed.JUNCTURES,
) -> DataFrame:
    """Claims of a dimension, term part, document or period."""
    if juncture is not None and juncture not in junctures:
        raise ValueError(f"unknown juncture {juncture!r}; known: {', '.join(junctures)}")
    if category is not None:
        claims = claims.where(F.col("category") == category)
    if term is not None:
        part = F.lit(term.lower())
        claims = claims.where(
            F.contains(F.lower("matched_term_lemma"), part)
            | F.contains(F.lower("matched_surface_form"), part)
        )
    if doc_id is not None:
        claims = claims.where(F.col("doc_id") == doc_id)
    if juncture is not None:
        claims = claims.where(F.col("doc_date").between(*junctures[juncture]))
    return claims


def sample_claims(
    claims: DataFrame, n: int = 5, random: bool = False, seed: int = 42, **filters
) -> DataFrame:
    """The first ``n`` claims, or ``n`` drawn at random, of those that match."""
    matching = filter_claims(claims, **filters)
    order = lottery(F.col("claim_id"), seed) if random else F.col("claim_id")
    return matching.orderBy(order, "claim_id").limit(n)


def per_stratum(
    df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int
) -> DataFrame:
    """Up to ``n`` rows of every stratum."""
    window = Window.partitionBy(*strata).orderBy(lottery(F.col(key), seed), F.col(key))
    return df.withColumn("_draw", F.row_number().over(window)).where(F.col("_draw") <= n).drop("_draw")


CODER_COLUMNS = {
    "category_correct": "boolean",
    "is_securitising": "boolean",
    "securitisation_type": "string",
    "referent_object": "string",
    "threat_actor": "string",
    "extraordinary_measure": "string",
    "confidence": "int",
    "coder_notes": "string",
}
SHEET_COLUMNS = (
    "claim_id", "doc_id", "doc_title", "doc_date", "doc_url", "category",
    "matched_term", "surface_form", "sentence", "context_before", "context_after",
)


def empty_columns(df: DataFrame, columns: Mapping[str, str], prefix: str = "") -> DataFrame:
    return df.withColumns(
        {prefix + name: F.lit(None).cast(kind) for name, kind in columns.items()}
    )


def coding_sample(
    claims: DataFrame,
    n_per_category: int = 15,
    n_per_juncture: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Stratified coding sheet: per dimension, topped up per period."""
    # Keys only are ranked; the drawn rows, a few per stratum, are fetched after.
    keys = claims.select("claim_id", "category")
    drawn = per_stratum(keys, ["category"], "claim_id", n_per_category, seed).select("claim_id")
    if n_per_juncture:
        dated = claims.select("claim_id", "juncture").where(F.col("juncture").isNotNull())
        rest = dated.join(F.broadcast(drawn), "claim_id", "left_anti")
        top_up = per_stratum(rest, ["juncture"], "claim_id", n_per_juncture, seed + 1)
        drawn = drawn.unionByName(top_up.select("claim_id"))
    sheet = claims.select(*SHEET_COLUMNS).join(F.broadcast(drawn), "claim_id", "left_semi")
    return empty_columns(sheet, CODER_COLUMNS)


AUDIT_COLUMNS = {
    "category_correct": "boolean",
    "is_securitising": "boolean",
    "securitisation_type": "string",
    "referent_object": "string",
    "threat_actor": "string",
    "extraordinary_measure": "string",
    "confidence": "int",
    "notes": "string",
}


def audit_sample(coded: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """Half securitising claims, the rest others, with empty columns to fill.

    If there are fewer securitising claims than half, the others make up for it.
    """
    judged = coded.where(F.col("is_securitising").isNotNull())
    drawn = per_stratum(judged, ["is_securitising"], "claim_id", n, seed)
    order = Window.partitionBy("is_securitising").orderBy(
        lottery(F.col("claim_id"), seed), F.col("claim_id")
    )
    # From here on there are at most 2n rows.
    half = math.ceil(n / 2)
    ranked = drawn.withColumn("_draw", F.row_number().over(order))
    taken = F.least(
        F.lit(half), F.sum(F.col("is_securitising").cast("int")).over(Window.partitionBy())
    )
    kept = ranked.withColumn("_positive", taken).where(
        F.when(F.col("is_securitising"), F.col("_draw") <= half).otherwise(
            F.col("_draw") <= n - F.col("_positive")
        )
    )
    return empty_columns(kept.drop("_draw", "_positive"), AUDIT_COLUMNS, "human_").orderBy("claim_id")


MANUAL_COLUMNS = {
    "is_securitising": "string",
    "securitisation_type": "string",
    "referent_object": "string",
    "threat_actor": "string",
    "extraordinary_measure": "string",
    "confidence": "int",
    "notes": "string",
}


def with_strata(coded: DataFrame) -> DataFrame:
    securitising = F.lower(F.col("is_securitising").cast("string")) == "true"
    return coded.withColumn(
        "source_label", source_label(F.col("doc_content_type"))
    ).withColumn(
        "sec_label",
        F.when(F.col("is_securitising").isNull(), F.lit(None)).otherwise(
            F.when(securitising, "securitising").otherwise("not_securitising")
        ),
    )


def strata_sizes(coded: DataFrame) -> DataFrame:
    return with_strata(coded).groupBy("source_label", "sec_label").agg(F.count("*").alias("n"))


def validation_sample(
    coded: DataFrame, n_per_stratum: int = 6, seed: int = 42, key: str = "passage_id"
) -> tuple[DataFrame, DataFrame]:
    """Blind sheet and answer key of a stratified, shuffled sample."""
    drawn = per_stratum(
        with_strata(coded), ["source_label", "sec_label"], key, n_per_stratum, seed
    )
    # A few rows per stratum, so one global order is no bottleneck.
    shuffled = Window.orderBy(lottery(F.col(key), seed + 1), F.col(key))
    numbered = drawn.withColumn("sample_id", F.row_number().over(shuffled))
    sheet = empty_columns(
        numbered.select("sample_id", "doc_id", "source_label", "doc_date", "doc_title", "passage"),
        MANUAL_COLUMNS,
        "manual_",
    )
    codes = ["is_securitising", *fixed.CODE_COLUMNS, "confidence", "coder_notes"]
    answers = numbered.select(
        "sample_id", "doc_id", *[F.col(c).alias(f"llm_{c}") for c in codes]
    )
    return sheet, answers


def coding_check(coded: DataFrame) -> dict[str, DataFrame]:
    """Report on a hand-checked coding sheet."""
    rows = coded.where(F.col("category_correct").isNotNull())
    correct = F.col("category_correct")
    securitising = F.col("is_securitising")
    false_positive = rows.where((correct == False) | (securitising == False))  # noqa: E712
    tally = [
        F.count("*").alias("n"),
        count_where(correct).alias("correct"),
        count_where(securitising).alias("securitising"),
    ]
    return {
        "totals": coded.agg(
            F.count("*").alias("in_sample"),
            F.count("category_correct").alias("coded"),
            count_where(correct).alias("correct"),
            count_where(securitising & correct.isNotNull()).alias("securitising"),
        ),
        "by_category": rows.groupBy("category").agg(*tally),
        "confidence": rows.groupBy("confidence").agg(F.count("*").alias("n")),
        "false_positive_terms": false_positive.groupBy("matched_term")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "matched_term")
        .limit(10),
    }
