"""The studies end to end: corpus to claims, claims to tables, coding rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators import coding, figures, ingest, matching, packing, reports
from claimloom.operators.lexicon import Lexicon
from claimloom.plans.layout import number_rows
from claimloom.settings import fixed
from claimloom.sources import corpus as corpus_io
from claimloom.sources import tables


@dataclass
class Analysis:
    """Claims, per-document results and the blocks of the summary."""

    claims: DataFrame
    results: DataFrame
    summary: dict[str, DataFrame]


def analyse_corpus(docs: DataFrame, lexicon: Lexicon, numbered: bool = True) -> Analysis:
    """Match the lexicon against every document.

    Numbering writes the claims to the shared folder, and every report then reads
    the columns it needs from there instead of matching again.
    """
    found = matching.claims(docs, lexicon)
    if numbered:
        found = number_rows(found, matching.claim_order(lexicon), "claim_id")
    results = matching.document_results(docs, found, lexicon)
    return Analysis(found, results, summarise(results, found))


def summarise(results: DataFrame, claims: DataFrame) -> dict[str, DataFrame]:
    return {
        "overview": reports.overview(results, claims),
        "claims_by_category": reports.claims_by_category(claims).orderBy(F.desc("n"), "category"),
        "top_terms": reports.top_terms(claims),
        "yearly": reports.yearly_breakdown(results).orderBy("year"),
        "juncture": reports.juncture_breakdown(results),
        "category_sets": reports.category_sets(results),
    }


def write_analysis(analysis: Analysis, path: str, as_json: bool = True) -> None:
    """Claims, results and summary blocks; JSON to exchange, Parquet to keep."""
    helper = ("cat_ord", "term_ord", "token_index", "seen_at")
    write = tables.write_json if as_json else corpus_io.store
    write(analysis.claims.drop(*helper), f"{path}/claims")
    write(analysis.results, f"{path}/results")
    for name, block in analysis.summary.items():
        tables.write_json(block.coalesce(1), f"{path}/summary/{name}")


def run_coding_analysis(claims: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Score claims, build the seven tables and, given a path, export them."""
    scored = reports.scored_claims(reports.prepared_claims(claims))
    built = reports.build_tables(scored)
    if path is not None:
        tables.write_csv(scored.select(*reports.EXPORT_COLUMNS), f"{path}/scored_claims")
        for name, table in built.items():
            tables.write_csv(table, f"{path}/table_{name}", files=1)
        tables.write_csv(
            reports.document_summary(scored).orderBy("doc_date"), f"{path}/document_scores"
        )
    return {"scored": scored, **built}


def prepare_batches(
    docs: DataFrame,
    path: str | None = None,
    sources: list[str] | None = None,
    max_tokens: int = fixed.MAX_BATCH_TOKENS,
    codebook: str | None = None,
) -> dict[str, DataFrame]:
    """Relevant, shortened documents packed into batches for a coder."""
    prepared = ingest.prepared_for_coding(docs, sources).withColumn(
        "packed_tokens", packing.packed_size(F.col("tokens_est"), max_tokens)
    )
    order = ["date", "id"]
    assigned = packing.assign_batches(
        prepared.select("id", "date", "packed_tokens"), order, limit=max_tokens
    )
    full = prepared.withColumn(
        "body", packing.capped_body(F.col("body"), F.col("tokens_est"), max_tokens)
    ).join(assigned.select("id", "batch"), "id")
    listing = packing.manifest(full, order)
    texts = packing.rendered_batches(full, order)
    if path is not None:
        tables.write_texts(texts, f"{path}/batches")
        named = listing.withColumn("batch", packing.batch_name(F.col("batch"))).orderBy("batch")
        tables.write_csv(named, f"{path}/manifest", files=1)
        if codebook is not None:
            spark = docs.sparkSession
            spark.createDataFrame([(codebook,)], "value string").coalesce(1).write.text(
                f"{path}/codebook_prompt"
            )
    return {"prepared": prepared, "assigned": assigned, "manifest": listing, "texts": texts}


def merge_results(entries: DataFrame, corpus: DataFrame, path: str | None = None) -> DataFrame:
    """Coder entries with document metadata, written as CSV and JSON."""
    merged = coding.merged_results(entries, coding.document_metadata(corpus))
    if path is not None:
        tables.write_csv(merged, f"{path}/coded_full")
        tables.write_csv(merged.where("is_securitising"), f"{path}/coded_securitising")
        tables.write_json(merged, f"{path}/coded_full_json")
    return merged


def run_coding(
    claims: DataFrame,
    results: DataFrame,
    coder: coding.Coder,
    progress: str,
    path: str | None = None,
    codebook: str = "",
) -> DataFrame:
    """Code the claims of relevant documents that are not coded yet.

    Codes are appended to ``progress``, so a run that broke off goes on where it
    stopped.
    """
    spark = claims.sparkSession
    wanted = reports.prepared_claims(coding.relevant_claims(claims, results))
    held = _read_if_written(spark, progress)
    todo = wanted if held is None else coding.uncoded(wanted, held)
    coder(todo).write.mode("append").parquet(progress)
    merged = coding.merge_codes(wanted, spark.read.parquet(progress))
    if path is not None:
        tables.write_csv(merged, f"{path}/coded_claims")
        tables.write_csv(merged.where("is_securitising"), f"{path}/securitising_claims")
        tables.write_csv(coding.category_quality(merged), f"{path}/coding_summary", files=1)
        log = coding.audit_log(merged, getattr(coder, "__name__", "coder"), "", codebook)
        tables.write_json(log.coalesce(1), f"{path}/coding_log")
    return merged


def _read_if_written(spark, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def generate_figures(coded: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    frames = figures.figure_frames(coded)
    if path is not None:
        for name, frame in frames.items():
            tables.write_csv(frame, f"{path}/{name}", files=1)
    return frames


__all__ = [
    "Analysis",
    "analyse_corpus",
    "corpus_io",
    "generate_figures",
    "merge_results",
    "prepare_batches",
    "run_coding",
    "run_coding_analysis",
    "summarise",
    "write_analysis",
]
