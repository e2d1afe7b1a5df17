"""Working with external coders: prompts, replies, merging, summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions.dates import juncture_of
from claimloom.operators.matching import is_relevant
from claimloom.operators.reports import count_where, latest_per_key
from claimloom.settings import fixed
from claimloom.settings.lexicons import GATE

# A coder takes claims and gives one row of codes per claim_id.
Coder = Callable[[DataFrame], DataFrame]

CODE_SCHEMA = (
    "category_correct boolean, is_securitising boolean, securitisation_type string, "
    "referent_object string, threat_actor string, extraordinary_measure string, "
    "confidence int, rationale string"
)
RESULT_SCHEMA = (
    "doc_id string, passage string, is_securitising string, securitisation_type string, "
    "referent_object string, threat_actor string, extraordinary_measure string, "
    "confidence string, coder_notes string"
)

# Price in dollars per million tokens and expected tokens per claim.
PRICE_IN, PRICE_OUT = 2.0, 10.0
EXPECTED_IN, EXPECTED_OUT = 1500, 200


def relevant_claims(claims: DataFrame, results: DataFrame, gate: str = GATE) -> DataFrame:
    """Claims of the documents that hold the gate and another dimension."""
    ids = results.where(is_relevant(F.col("matched_categories"), gate)).select(
        F.col("id").alias("doc_id")
    )
    return claims.join(ids, "doc_id", "left_semi")


def claim_prompt() -> Column:
    """The question put to a coder for one claim."""

    def or_none(name: str) -> Column:
        return F.when(F.coalesce(name, F.lit("")) == "", F.lit("(none)")).otherwise(F.col(name))

    return F.format_string(
        fixed.CLAIM_PROMPT,
        F.col("doc_title"),
        F.coalesce("doc_date", F.lit("unknown")),
        F.col("category"),
        F.col("matched_term"),
        F.col("surface_form"),
        or_none("context_before"),
        F.col("sentence"),
        or_none("context_after"),
    )


def parsed_replies(replies: DataFrame) -> DataFrame:
    """Codes out of ``replies(claim_id, raw_response, input_tokens, output_tokens)``.

    A reply without a readable object gives a row without codes and the
    rationale ``API_ERROR``.
    """
    codes = T.json_from_text(F.col("raw_response"), CODE_SCHEMA)
    parsed = replies.withColumn("_codes", codes)
    readable = F.col("_codes").isNotNull()
    return parsed.select(
        "claim_id",
        "_codes.category_correct",
        "_codes.is_securitising",
        "_codes.securitisation_type",
        "_codes.referent_object",
        "_codes.threat_actor",
        "_codes.extraordinary_measure",
        "_codes.confidence",
        F.when(readable, F.col("_codes.rationale")).otherwise("API_ERROR").alias("rationale"),
        F.when(readable, F.col("input_tokens")).cast("int").alias("input_tokens"),
        F.when(readable, F.col("output_tokens")).cast("int").alias("output_tokens"),
    )


def reply_coder(replies: DataFrame) -> Coder:
    """A coder that takes its answers from stored replies."""

    def code(claims: DataFrame) -> DataFrame:
        known = replies.select("claim_id", "raw_response", "input_tokens", "output_tokens")
        return parsed_replies(claims.select("claim_id").join(known, "claim_id", "left"))

    return code


def uncoded(claims: DataFrame, coded: DataFrame) -> DataFrame:
    return claims.join(coded.select("claim_id"), "claim_id", "left_anti")


def merge_codes(claims: DataFrame, coded: DataFrame) -> DataFrame:
    return claims.join(coded.drop("raw_response"), "claim_id", "left")


def estimated_cost(claims: DataFrame) -> DataFrame:
    per_claim = (EXPECTED_IN * PRICE_IN + EXPECTED_OUT * PRICE_OUT) / 1e6
    return claims.agg(
        F.count("*").alias("n_claims"), (F.count("*") * F.lit(per_claim)).alias("dollars")
    )


def token_cost(coded: DataFrame) -> DataFrame:
    spent_in, spent_out = (
        F.coalesce(F.sum(c), F.lit(0)).cast("bigint") for c in ("input_tokens", "output_tokens")
    )
    return coded.agg(
        spent_in.alias("input_tokens"), spent_out.alias("output_tokens")
    ).withColumn(
        "dollars",
        F.col("input_tokens") * PRICE_IN / 1e6 + F.col("output_tokens") * PRICE_OUT / 1e6,
    )


# --- summaries of coded claims -----------------------------------------------


def category_quality(coded: DataFrame) -> DataFrame:
    """Per dimension: claims, correct assignments, securitising claims."""
    judged = coded.where(F.col("is_securitising").isNotNull())
    total, correct, securitising = (
        F.count("*"),
        count_where(F.col("category_correct")),
        F.count_if("is_securitising"),
    )
    return judged.groupBy("category").agg(
        total.alias("total"),
        correct.alias("cat_correct"),
        securitising.alias("securitising"),
        F.round(100.0 * correct / total, 1).alias("pct_correct"),
        F.round(100.0 * securitising / total, 1).alias("pct_securitising"),
    )


def frequency_tables(
    coded: DataFrame, columns: Sequence[str] = (*fixed.CODE_COLUMNS, "confidence")
) -> DataFrame:
    """Counts of every code among securitising rows, in one long table."""
    rows = coded.where(F.col("is_securitising")).select(
        *[F.col(c).cast("string").alias(c) for c in columns]
    )
    long = rows.unpivot([], list(columns), "variable", "code")
    return long.groupBy("variable", "code").agg(F.count("*").alias("n"))


def confidence_levels(coded: DataFrame) -> DataFrame:
    """Claims per confidence level, those without one included."""
    return (
        coded.where(F.col("is_securitising").isNotNull())
        .groupBy("confidence")
        .agg(F.count("*").alias("n"))
    )


def coding_totals(coded: DataFrame) -> DataFrame:
    judged = F.col("is_securitising").isNotNull()
    return coded.agg(
        F.count("*").alias("n_claims"),
        F.count_if(judged).alias("n_coded"),
        count_where(F.col("category_correct") & judged).alias("n_correct"),
        count_where(F.col("is_securitising")).alias("n_securitising"),
    )


def audit_log(coded: DataFrame, coder: str, settings: str, codebook: str) -> DataFrame:
    """One row that documents a coding run."""
    return coding_totals(coded).select(
        F.lit(coder).alias("model"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("coded_at"),
        "n_claims",
        "n_coded",
        "n_securitising",
        F.lit(settings).alias("config"),
        F.left(F.md5(F.lit(codebook).cast("binary")), F.lit(12)).alias("system_prompt_hash"),
    )


# --- document-level results of external coders -------------------------------


def document_metadata(corpus: DataFrame) -> DataFrame:
    """Five fields per document id; of repeated ids the later file counts."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in corpus.columns else F.lit("")

    fields = corpus.select(
        F.col("id").alias("doc_id"),
        text("title").alias("doc_title"),
        F.col("date").alias("doc_date"),
        text("source").alias("doc_source"),
        text("content_type").alias("doc_content_type"),
        text("url").alias("doc_url"),
        *(["file_name"] if "file_name" in corpus.columns else []),
    )
    if "file_name" not in corpus.columns:
        return fields
    return latest_per_key(fields, ["doc_id"], ["file_name"]).drop("file_name")


def merged_results(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Coder entries with typed codes and the metadata of their documents."""
    if "is_securitising" not in entries.columns:
        entries = entries.withColumn("is_securitising", F.lit(None).cast("string"))
    return (
        entries.withColumn("is_securitising", T.truthy(F.col("is_securitising")))
        .withColumn("confidence", F.col("confidence").try_cast("double").cast("int"))
        .join(metadata, "doc_id", "left")
        .withColumn(
            "juncture",
            juncture_of(F.col("doc_date"), missing="unknown", outside="outside_junctures"),
        )
        .withColumn("year", F.substring("doc_date", 1, 4))
    )


def results_by_juncture(merged: DataFrame) -> DataFrame:
    """Securitising entries per period with the shares of the three types.

    Shares are among entries that have a type.
    """

    def pct(code: str) -> Column:
        hit = F.when(F.col("securitisation_type") == code, 100.0).when(
            F.col("securitisation_type").isNotNull(), 0.0
        )
        return F.round(F.avg(hit), 1)

    return (
        merged.where(F.col("is_securitising"))
        .groupBy("juncture")
        .agg(
            F.count("*").alias("n_moves"),
            F.count_distinct("doc_id").alias("n_docs"),
            pct("material").alias("pct_material"),
            pct("ontological").alias("pct_ontological"),
            pct("both").alias("pct_both"),
            F.round(F.avg("confidence"), 2).alias("avg_confidence"),
        )
    )


def results_by_source(merged: DataFrame) -> DataFrame:
    return (
        merged.where(F.col("is_securitising"))
        .groupBy("doc_source")
        .agg(F.count("*").alias("n_moves"), F.count_distinct("doc_id").alias("n_docs"))
    )
