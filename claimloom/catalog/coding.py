"""Queries on samples, codes, agreement and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.catalog.base import (
    query,
    study_coded,
    study_corpus,
    study_entries,
    study_prepared,
    study_results,
    study_claims,
    stored_claims,
    stored_prepared,
    claim_key,
    table,
)
from claimloom.functions import labels
from claimloom.functions import text as T
from claimloom.operators import agreement, coding, figures, reports, sampling
from claimloom.sources.tables import coder_entries

_KEY = "doc_id || '-' || cat_ord || '-' || term_ord || '-' || sentence_index || '-' || match_start"


def _lot(seed: int, key: str = "claim_id") -> str:
    return f"md5({key} || '#{seed}')"


# --- samples -----------------------------------------------------------------

_EMPTY = """NULL::BOOLEAN AS category_correct, NULL::BOOLEAN AS is_securitising,
    NULL::VARCHAR AS securitisation_type, NULL::VARCHAR AS referent_object, NULL::VARCHAR AS threat_actor,
    NULL::VARCHAR AS extraordinary_measure, NULL::INTEGER AS confidence, NULL::VARCHAR AS coder_notes"""
_SHEET = """claim_id, doc_id, doc_title, doc_date, doc_url, category, matched_term, surface_form,
    sentence, context_before, context_after"""


@query(
    "random_sample",
    f"""-- uses: claims
    SELECT claim_id, category, sentence FROM (SELECT *, {_KEY} AS claim_id FROM claims)
    WHERE category = 'urgency' ORDER BY {_lot(42)}, claim_id LIMIT 25""",
)
def random_sample(spark, sf):
    claims = study_claims(spark, sf).withColumn("claim_id", claim_key())
    return sampling.sample_claims(claims, 25, random=True, seed=42, category="urgency").select(
        "claim_id", "category", "sentence"
    )


@query(
    "first_claims",
    f"""-- uses: claims
    SELECT claim_id, category, sentence FROM (SELECT *, {_KEY} AS claim_id FROM claims)
    ORDER BY claim_id LIMIT 5""",
)
def first_claims(spark, sf):
    claims = study_claims(spark, sf).withColumn("claim_id", claim_key())
    return sampling.sample_claims(claims, 5).select("claim_id", "category", "sentence")


@query(
    "stratified_sample",
    f"""-- uses: coded
    , drawn AS (SELECT * FROM coded QUALIFY row_number() OVER (PARTITION BY category
            ORDER BY {_lot(42)}, claim_id) <= 15),
    topped AS (SELECT * FROM coded WHERE juncture IS NOT NULL
            AND claim_id NOT IN (SELECT claim_id FROM drawn)
        QUALIFY row_number() OVER (PARTITION BY juncture ORDER BY {_lot(43)}, claim_id) <= 4)
    SELECT {_SHEET}, {_EMPTY} FROM (SELECT * FROM drawn UNION ALL SELECT * FROM topped)""",
)
def stratified_sample(spark, sf):
    claims = stored_prepared(spark, sf).withColumn("claim_id", claim_key())
    return sampling.coding_sample(claims, 15, 4, 42)


@query(
    "audit_sample",
    f"""-- uses: coded
    , pos AS (SELECT * FROM coded WHERE is_securitising ORDER BY {_lot(42)}, claim_id LIMIT 25),
    neg AS (SELECT * FROM coded WHERE NOT is_securitising ORDER BY {_lot(42)}, claim_id
        LIMIT 50 - (SELECT count(*) FROM pos))
    SELECT claim_id, category, is_securitising, confidence, NULL::BOOLEAN AS human_is_securitising,
        NULL::VARCHAR AS human_notes FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg)""",
)
def audit_sample(spark, sf):
    coded = study_coded(spark, sf).drop(
        "human_is_securitising", "human_category_correct", "human_securitisation_type"
    )
    return sampling.audit_sample(coded, 50, 42).select(
        "claim_id", "category", "is_securitising", "confidence", "human_is_securitising",
        "human_notes",
    )


def _merged(spark, sf):
    return coding.merged_results(
        study_entries(spark, sf), coding.document_metadata(study_corpus(spark, sf))
    )


_STRATA = """CASE doc_content_type WHEN 'speech' THEN 'Zelensky' WHEN 'poroshenko_speech' THEN 'Poroshenko'
        WHEN 'rada_stenogram' THEN 'Rada' WHEN 'sbu_press_release' THEN 'SBU'
        WHEN 'dess_statement' THEN 'DESS' ELSE 'Other' END AS source_label,
    CASE WHEN is_securitising THEN 'securitising' ELSE 'not_securitising' END AS sec_label"""


@query(
    "strata_sizes",
    f"""-- uses: merged
    , labelled AS (SELECT *, {_STRATA} FROM merged)
    SELECT source_label, sec_label, count(*) AS n FROM labelled GROUP BY ALL""",
)
def strata_sizes(spark, sf):
    return sampling.strata_sizes(_merged(spark, sf))


_VALIDATION = f"""-- uses: merged
    , labelled AS (SELECT *, {_STRATA} FROM merged),
    drawn AS (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY source_label, sec_label
        ORDER BY {_lot(42, 'passage')}, passage) <= 6),
    numbered AS (SELECT *, CAST(row_number() OVER (ORDER BY {_lot(43, 'passage')}, passage) AS INTEGER)
        AS sample_id FROM drawn)"""


@query(
    "validation_sheet",
    _VALIDATION
    + """
    SELECT sample_id, doc_id, source_label, doc_date, doc_title, passage,
        NULL::VARCHAR AS manual_is_securitising, NULL::VARCHAR AS manual_securitisation_type,
        NULL::VARCHAR AS manual_referent_object, NULL::VARCHAR AS manual_threat_actor,
        NULL::VARCHAR AS manual_extraordinary_measure, NULL::INTEGER AS manual_confidence,
        NULL::VARCHAR AS manual_notes FROM numbered""",
)
def validation_sheet(spark, sf):
    return sampling.validation_sample(_merged(spark, sf), 6, 42, key="passage")[0]


@query(
    "validation_join",
    _VALIDATION
    + """
    SELECT sample_id, doc_id, doc_id AS "doc_id.llm", source_label, passage,
        is_securitising AS llm_is_securitising, securitisation_type AS llm_securitisation_type,
        confidence AS llm_confidence FROM numbered""",
)
def validation_join(spark, sf):
    """Coding sheet and answer key side by side."""
    sheet, key = sampling.validation_sample(_merged(spark, sf), 6, 42, key="passage")
    return agreement.joined_codes(sheet, key).select(
        "sample_id", "doc_id", F.col("`doc_id.llm`"), "source_label", "passage",
        "llm_is_securitising", "llm_securitisation_type", "llm_confidence",
    )


# --- codes on claims ---------------------------------------------------------


@query(
    "relevant_semi",
    """-- uses: claims, results
    SELECT doc_id, category, sentence_index, match_start FROM claims
    WHERE doc_id IN (SELECT id FROM results WHERE is_relevant)""",
)
def relevant_semi(spark, sf):
    found = stored_claims(spark, sf)
    return coding.relevant_claims(found, study_results(spark, sf, found)).select(
        "doc_id", "category", "sentence_index", "match_start"
    )


def _half_coded(spark, sf, prepared):
    """Codes stored by an earlier run for a part of the claims."""
    coded = study_coded(spark, sf, prepared)
    return coded.where(F.col("is_securitising").isNotNull()).select(
        "claim_id", "is_securitising", "category_correct", "securitisation_type", "confidence",
        F.concat(F.lit("raw "), "claim_id").alias("raw_response"),
    )


@query(
    "uncoded_anti",
    """-- uses: coded
    SELECT claim_id, category, sentence FROM coded WHERE is_securitising IS NULL""",
)
def uncoded_anti(spark, sf):
    prepared = stored_prepared(spark, sf)
    claims = prepared.withColumn("claim_id", claim_key())
    return coding.uncoded(claims, _half_coded(spark, sf, prepared)).select(
        "claim_id", "category", "sentence"
    )


@query(
    "merged_codes",
    """-- uses: coded
    SELECT claim_id, category, matched_term, sentence, is_securitising, category_correct,
        CASE WHEN is_securitising IS NOT NULL THEN securitisation_type END AS securitisation_type,
        CASE WHEN is_securitising IS NOT NULL THEN confidence END AS confidence FROM coded""",
)
def merged_codes(spark, sf):
    prepared = stored_prepared(spark, sf)
    claims = prepared.withColumn("claim_id", claim_key()).select(
        "claim_id", "category", "matched_term", "sentence"
    )
    return coding.merge_codes(claims, _half_coded(spark, sf, prepared))


@query(
    "claim_prompts",
    """-- uses: coded
    SELECT claim_id, 'Code this claim:' || chr(10) || chr(10) || 'Document: ' || doc_title || chr(10)
        || 'Date: ' || coalesce(doc_date, 'unknown') || chr(10) || 'Category: ' || category || chr(10)
        || 'Matched term: ' || matched_term || ' (surface form: "' || surface_form || '")' || chr(10)
        || chr(10) || '[Previous sentence]: '
        || CASE WHEN context_before = '' THEN '(none)' ELSE context_before END || chr(10)
        || '>>> [TARGET SENTENCE]: ' || sentence || chr(10) || '[Next sentence]: '
        || CASE WHEN context_after = '' THEN '(none)' ELSE context_after END AS prompt
    FROM coded""",
)
def claim_prompts(spark, sf):
    claims = study_prepared(spark, sf).withColumn("claim_id", claim_key())
    return claims.select("claim_id", coding.claim_prompt().alias("prompt"))


def _replies(spark, sf):
    """A coder's reply per event: an object, one inside prose, or no object."""
    n = F.col("event_id")
    whole = F.format_string(
        '{"is_securitising": %s, "confidence": %d, "rationale": "%s"}',
        F.when(n % 2 == 0, "true").otherwise("false"),
        (n % 3 + 1).cast("int"),
        F.col("event_type"),
    )
    reply = (
        F.when(n % 4 == 0, whole)
        .when(n % 4 == 1, F.concat(F.lit("Here it is:\n"), whole, F.lit("\nDone.")))
        .when(n % 4 == 2, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .otherwise(F.lit("I cannot code this."))
    )
    return table(spark, sf, "events").select(
        n.alias("claim_id"),
        reply.alias("raw_response"),
        (n % 100).alias("input_tokens"),
        (n % 50).alias("output_tokens"),
    )


_REPLIES = """(SELECT event_id AS claim_id, event_id % 4 < 3 AS readable,
    CASE WHEN event_id % 4 < 3 THEN event_id % 2 = 0 END AS is_securitising,
    CASE WHEN event_id % 4 < 3 THEN CAST(event_id % 3 + 1 AS INTEGER) END AS confidence,
    CASE WHEN event_id % 4 < 3 THEN event_type ELSE 'API_ERROR' END AS rationale,
    CASE WHEN event_id % 4 < 3 THEN CAST(event_id % 100 AS INTEGER) END AS input_tokens,
    CASE WHEN event_id % 4 < 3 THEN CAST(event_id % 50 AS INTEGER) END AS output_tokens FROM events)"""


@query(
    "reply_codes",
    f"""SELECT claim_id, is_securitising, confidence, rationale, input_tokens, output_tokens,
        NULL::BOOLEAN AS category_correct, NULL::VARCHAR AS securitisation_type FROM {_REPLIES}""",
)
def reply_codes(spark, sf):
    """Codes read out of free-text replies."""
    return coding.parsed_replies(_replies(spark, sf)).drop(
        "referent_object", "threat_actor", "extraordinary_measure"
    )


@query(
    "token_cost",
    f"""SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT)
        AS output_tokens, round(sum(input_tokens) * 2.0::DOUBLE / 1e6 + sum(output_tokens) * 10.0::DOUBLE / 1e6, 6)
        AS dollars FROM {_REPLIES}""",
)
def token_cost(spark, sf):
    cost = coding.token_cost(coding.parsed_replies(_replies(spark, sf)))
    return cost.withColumn("dollars", F.round("dollars", 6))


@query(
    "estimated_cost",
    """-- uses: claims
    SELECT count(*) AS n_claims, round(count(*) * 0.005::DOUBLE, 6) AS dollars FROM claims""",
)
def estimated_cost(spark, sf):
    return coding.estimated_cost(study_claims(spark, sf)).withColumn(
        "dollars", F.round("dollars", 6)
    )


@query(
    "json_extract",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
)
def json_extract(spark, sf):
    """An object inside surrounding prose."""
    wrapped = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(
        F.concat(F.lit("Reply: "), "props", F.lit(" end"))
    )
    return table(spark, sf, "events").select(
        "event_id", T.json_from_text(wrapped, "k int").getField("k").alias("k")
    )


@query(
    "category_quality",
    """-- uses: coded
    SELECT category, count(*) AS total, count(CASE WHEN category_correct THEN 1 END) AS cat_correct,
        count(CASE WHEN is_securitising THEN 1 END) AS securitising,
        round(100.0::DOUBLE * count(CASE WHEN category_correct THEN 1 END) / count(*), 1) AS pct_correct,
        round(100.0::DOUBLE * count(CASE WHEN is_securitising THEN 1 END) / count(*), 1) AS pct_securitising
    FROM coded WHERE is_securitising IS NOT NULL GROUP BY category""",
)
def category_quality(spark, sf):
    return coding.category_quality(study_coded(spark, sf))


@query(
    "coding_totals",
    """-- uses: coded
    SELECT count(*) AS n_claims, count(is_securitising) AS n_coded,
        count(CASE WHEN category_correct AND is_securitising IS NOT NULL THEN 1 END) AS n_correct,
        count(CASE WHEN is_securitising THEN 1 END) AS n_securitising FROM coded""",
)
def coding_totals(spark, sf):
    return coding.coding_totals(study_coded(spark, sf))


@query(
    "coding_log",
    """-- uses: coded
    SELECT 'stored replies' AS model, count(*) AS n_claims, count(is_securitising) AS n_coded,
        count(CASE WHEN is_securitising THEN 1 END) AS n_securitising, '{}' AS config,
        left(md5('codebook'), 12) AS system_prompt_hash FROM coded""",
)
def coding_log(spark, sf):
    return coding.audit_log(study_coded(spark, sf), "stored replies", "{}", "codebook").drop(
        "coded_at"
    )


@query(
    "confidence_levels",
    """-- uses: coded
    SELECT confidence, count(*) AS n FROM coded WHERE is_securitising IS NOT NULL GROUP BY confidence""",
)
def confidence_levels(spark, sf):
    return coding.confidence_levels(study_coded(spark, sf))


_CHECKED = "(SELECT * FROM coded WHERE category_correct IS NOT NULL)"


@query(
    "coding_check",
    f"""-- uses: coded
    SELECT category, count(*) AS n, count(CASE WHEN category_correct THEN 1 END) AS correct,
        count(CASE WHEN is_securitising THEN 1 END) AS securitising FROM {_CHECKED} GROUP BY category""",
)
def coding_check(spark, sf):
    return sampling.coding_check(study_coded(spark, sf))["by_category"]


@query(
    "coding_check_totals",
    """-- uses: coded
    SELECT count(*) AS in_sample, count(category_correct) AS coded, count(CASE WHEN category_correct THEN 1 END) AS correct,
        count(CASE WHEN is_securitising AND category_correct IS NOT NULL THEN 1 END) AS securitising FROM coded""",
)
def coding_check_totals(spark, sf):
    return sampling.coding_check(study_coded(spark, sf))["totals"]


@query(
    "false_positive_terms",
    f"""-- uses: coded
    SELECT matched_term, count(*) AS n FROM {_CHECKED}
    WHERE NOT category_correct OR NOT is_securitising GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""",
)
def false_positive_terms(spark, sf):
    return sampling.coding_check(study_coded(spark, sf))["false_positive_terms"]


# --- agreement ---------------------------------------------------------------

_CONFUSION = """, r AS (SELECT * FROM coded WHERE human_is_securitising IS NOT NULL),
    c AS (SELECT count(*) AS n, count(CASE WHEN is_securitising AND human_is_securitising THEN 1 END) AS tp,
        count(CASE WHEN is_securitising AND NOT human_is_securitising THEN 1 END) AS fp,
        count(CASE WHEN NOT is_securitising AND human_is_securitising THEN 1 END) AS fn,
        count(CASE WHEN NOT is_securitising AND NOT human_is_securitising THEN 1 END) AS tn FROM r)"""


@query(
    "agreement_binary",
    f"""-- uses: coded
    {_CONFUSION}
    SELECT n, tp, fp, fn, tn, round((tp + tn)::DOUBLE / n, 8) AS agreement, round(p, 8) AS precision,
        round(r, 8) AS recall, round(2 * p * r / (p + r), 8) AS f1,
        round(((tp + tn)::DOUBLE / n - e) / (1 - e), 8) AS kappa
    FROM (SELECT *, tp::DOUBLE / (tp + fp) AS p, tp::DOUBLE / (tp + fn) AS r,
        ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn))::DOUBLE / (n * n) AS e FROM c)""",
)
def agreement_binary(spark, sf):
    found = agreement.binary_agreement(study_coded(spark, sf))
    doubles = ("agreement", "precision", "recall", "f1", "kappa")
    return found.withColumns({c: F.round(c, 8) for c in doubles})


@query(
    "agreement_on_type",
    """-- uses: coded
    SELECT count(*) AS n, count(CASE WHEN category_correct = human_category_correct THEN 1 END) AS category_agree,
        count(CASE WHEN is_securitising AND human_is_securitising THEN 1 END) AS both_securitising,
        count(CASE WHEN is_securitising AND human_is_securitising
            AND securitisation_type = human_securitisation_type THEN 1 END) AS type_agree
    FROM coded WHERE human_is_securitising IS NOT NULL""",
)
def agreement_on_type(spark, sf):
    return agreement.category_agreement(study_coded(spark, sf))


@query(
    "confidence_calibration",
    """-- uses: coded
    SELECT confidence, count(*) AS n, round(100.0::DOUBLE
        * count(CASE WHEN is_securitising = human_is_securitising THEN 1 END) / count(*), 1) AS pct_agreement
    FROM coded WHERE human_is_securitising IS NOT NULL AND confidence BETWEEN 1 AND 3 GROUP BY 1""",
)
def confidence_calibration(spark, sf):
    return agreement.confidence_calibration(study_coded(spark, sf))


@query(
    "disagreements",
    """-- uses: coded
    SELECT claim_id, category, is_securitising, human_is_securitising, sentence FROM coded
    WHERE is_securitising <> human_is_securitising""",
)
def disagreements(spark, sf):
    return agreement.disagreements(study_coded(spark, sf)).select(
        "claim_id", "category", "is_securitising", "human_is_securitising", "sentence"
    )


def _kappa_sql(source: str) -> str:
    return f""", pairs AS ({source}),
    cells AS (SELECT a, b, count(*) AS k FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
    rowsum AS (SELECT a AS code, sum(k)::DOUBLE AS p FROM cells GROUP BY a),
    colsum AS (SELECT b AS code, sum(k)::DOUBLE AS q FROM cells GROUP BY b),
    both_sums AS (SELECT coalesce(r.code, c.code) AS code, coalesce(p, 0) AS p, coalesce(q, 0) AS q
        FROM rowsum r FULL JOIN colsum c ON r.code = c.code),
    st AS (SELECT (SELECT sum(k)::DOUBLE FROM cells) AS n, count(*) AS n_codes,
        (SELECT coalesce(sum(k), 0)::DOUBLE FROM cells WHERE a = b) AS same, sum(p * q) AS s1,
        sum(p * q * (p + q)) AS s2 FROM both_sums),
    kp AS (SELECT CAST(n AS BIGINT) AS n, n_codes, same / n AS agreement, (same / n - s1 / (n * n)) / (1 - s1 / (n * n))
        AS kappa, (s1 / (n * n) + (s1 / (n * n)) ** 2 - s2 / n ** 3) / (n * (1 - s1 / (n * n)) ** 2) AS v FROM st)
    SELECT n, n_codes, round(agreement, 8) AS agreement, round(kappa, 8) AS kappa,
        round(kappa / sqrt(v), 6) AS z, CASE WHEN kappa >= 0.81 THEN 'almost perfect'
        WHEN kappa >= 0.61 THEN 'substantial' WHEN kappa >= 0.41 THEN 'moderate'
        WHEN kappa >= 0.21 THEN 'fair' ELSE 'poor' END AS band FROM kp"""


def _kappa_out(df):
    return df.select(
        "n", "n_codes", F.round("agreement", 8).alias("agreement"),
        F.round("kappa", 8).alias("kappa"), F.round("z", 6).alias("z"), "band",
    )


@query(
    "kappa_quality_toxic",
    "WITH" + _kappa_sql("SELECT quality AS a, toxic AS b FROM labels")[1:],
)
def kappa_quality_toxic(spark, sf):
    return _kappa_out(agreement.cohen_kappa(table(spark, sf, "labels"), "quality", "toxic"))


@query(
    "kappa_type",
    "-- uses: coded\n"
    + _kappa_sql(
        "SELECT securitisation_type AS a, human_securitisation_type AS b FROM coded"
        " WHERE is_securitising AND human_is_securitising"
    ),
)
def kappa_type(spark, sf):
    both = study_coded(spark, sf).where("is_securitising AND human_is_securitising")
    return _kappa_out(
        agreement.cohen_kappa(both, "securitisation_type", "human_securitisation_type")
    )


@query(
    "confusion",
    """-- uses: coded
    SELECT is_securitising, human_is_securitising, count(*) AS n FROM coded GROUP BY ALL""",
)
def confusion(spark, sf):
    return agreement.confusion(
        study_coded(spark, sf), "is_securitising", "human_is_securitising"
    )


# --- results of external coders ----------------------------------------------


@query(
    "coder_entries",
    """SELECT 'batch_' || doc_id || '.json' AS batch_file, CAST(doc_id AS VARCHAR) AS doc_id,
        'p' || i AS passage, CASE WHEN i = 0 THEN 'true' ELSE 'no' END AS is_securitising,
        CAST(quality + 1 AS VARCHAR) AS confidence
    FROM labels, (SELECT unnest([0, 1]) AS i) WHERE doc_id % 3 < 2 AND (i = 0 OR doc_id % 3 = 0)""",
)
def coder_results(spark, sf):
    """Fenced arrays, single objects and broken replies."""
    n = F.col("doc_id")
    text = n.cast("string")
    conf = (F.col("quality") + 1).cast("string")
    first = F.format_string(
        '{"doc_id": "%s", "passage": "p0", "is_securitising": true, "confidence": %s}', text, conf
    )
    second = F.format_string(
        '{"doc_id": "%s", "passage": "p1", "is_securitising": "no", "confidence": %s}', text, conf
    )
    value = (
        F.when(n % 3 == 0, F.concat(F.lit("```json\n["), first, F.lit(", "), second, F.lit("]\n```\n")))
        .when(n % 3 == 1, first)
        .otherwise(F.lit("sorry, [no"))
    )
    replies = table(spark, sf, "labels").select(
        value.alias("value"), F.concat(F.lit("batch_"), text, F.lit(".json")).alias("batch_file")
    )
    return coder_entries(replies).select(
        "batch_file", "doc_id", "passage", "is_securitising", "confidence"
    )


@query(
    "doc_meta_lookup",
    """-- uses: merged
    SELECT * FROM merged""",
)
def doc_meta_lookup(spark, sf):
    """Coder entries with typed codes and document fields."""
    return _merged(spark, sf)


@query(
    "results_by_juncture",
    """-- uses: merged
    SELECT juncture, count(*) AS n_moves, count(DISTINCT doc_id) AS n_docs,
        round(100.0::DOUBLE * count(CASE WHEN securitisation_type = 'material' THEN 1 END) / nullif(count(securitisation_type), 0), 1)
            AS pct_material,
        round(100.0::DOUBLE * count(CASE WHEN securitisation_type = 'ontological' THEN 1 END) / nullif(count(securitisation_type), 0), 1)
            AS pct_ontological,
        round(100.0::DOUBLE * count(CASE WHEN securitisation_type = 'both' THEN 1 END) / nullif(count(securitisation_type), 0), 1)
            AS pct_both,
        round(avg(confidence), 2) AS avg_confidence
    FROM merged WHERE is_securitising GROUP BY juncture""",
)
def results_by_juncture(spark, sf):
    return coding.results_by_juncture(_merged(spark, sf))


@query(
    "results_by_source",
    """-- uses: merged
    SELECT doc_source, count(*) AS n_moves, count(DISTINCT doc_id) AS n_docs FROM merged
    WHERE is_securitising GROUP BY doc_source""",
)
def results_by_source(spark, sf):
    return coding.results_by_source(_merged(spark, sf))


@query(
    "code_frequencies",
    """-- uses: merged
    , s AS (SELECT * FROM merged WHERE is_securitising)
    SELECT variable, code, count(*) AS n FROM (
        SELECT 'securitisation_type' AS variable, securitisation_type AS code FROM s
        UNION ALL SELECT 'referent_object', referent_object FROM s
        UNION ALL SELECT 'threat_actor', threat_actor FROM s
        UNION ALL SELECT 'extraordinary_measure', extraordinary_measure FROM s
        UNION ALL SELECT 'confidence', CAST(confidence AS VARCHAR) FROM s) GROUP BY ALL""",
)
def code_frequencies(spark, sf):
    return coding.frequency_tables(_merged(spark, sf))


# --- figures -----------------------------------------------------------------


def _scoped(spark, sf):
    return figures.in_scope(_merged(spark, sf))


def _stage_counts(spark, sf):
    """Documents per source label: all, and those with a long text."""
    docs = study_corpus(spark, sf)
    return docs.groupBy(labels.source_label(F.col("content_type")).alias("source")).agg(
        F.count("*").alias("scraped"),
        F.sum(F.when(F.length("body_text") > 1000, 1)).alias("relevant"),
    ).withColumn("relevant", F.when(F.col("source") != "DESS", F.col("relevant")))


_FUNNEL = """, stage AS (SELECT source, scraped, CASE WHEN source <> 'DESS' THEN relevant END AS relevant
        FROM (SELECT CASE content_type WHEN 'speech' THEN 'Zelensky' WHEN 'rada_stenogram' THEN 'Rada'
            WHEN 'sbu_press_release' THEN 'SBU' WHEN 'dess_statement' THEN 'DESS' ELSE 'Other' END AS source,
            count(*) AS scraped, count(CASE WHEN length(body_text) > 1000 THEN 1 END) AS relevant FROM tcorpus GROUP BY 1)),
    fun AS (SELECT s.source, s.scraped, count(f.doc_id) AS claims, count(CASE WHEN f.is_securitising THEN 1 END) AS sec_claims,
            count(DISTINCT f.doc_id) AS docs_coded,
            count(DISTINCT CASE WHEN f.is_securitising THEN f.doc_id END) AS sec_docs,
            coalesce(s.relevant, count(DISTINCT f.doc_id)) AS relevant
        FROM stage s LEFT JOIN figs f ON s.source = f.source_label GROUP BY s.source, s.scraped, s.relevant)"""


@query("funnel", "-- uses: figs\n" + _FUNNEL + "\nSELECT * FROM fun")
def funnel(spark, sf):
    return figures.funnel(_scoped(spark, sf), _stage_counts(spark, sf))


@query(
    "funnel_long",
    "-- uses: figs\n"
    + _FUNNEL
    + """
    SELECT source, 'scraped' AS stage, scraped AS "count" FROM fun
    UNION ALL SELECT source, 'relevant', relevant FROM fun
    UNION ALL SELECT source, 'claims', claims FROM fun
    UNION ALL SELECT source, 'sec_claims', sec_claims FROM fun""",
)
def funnel_long(spark, sf):
    return figures.funnel_long(figures.funnel(_scoped(spark, sf), _stage_counts(spark, sf)))


@query(
    "source_share",
    """-- uses: figs
    SELECT source_label, count(*) AS claims, count(DISTINCT doc_id) AS docs,
        round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM figs GROUP BY source_label""",
)
def source_share(spark, sf):
    return figures.source_share(_scoped(spark, sf))


@query(
    "type_by_source",
    """-- uses: figs
    SELECT source_label, CASE securitisation_type WHEN 'material' THEN 'Material'
        WHEN 'ontological' THEN 'Ontological' WHEN 'both' THEN 'Both' ELSE 'Other' END AS sec_type,
        count(*) AS n FROM figs WHERE is_securitising GROUP BY ALL""",
)
def type_by_source(spark, sf):
    return figures.type_by_source(_scoped(spark, sf))


def _share_sql(column: str) -> str:
    return f"""-- uses: figs
    SELECT {column}, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct
    FROM figs WHERE is_securitising GROUP BY {column}"""


@query("referent_objects", _share_sql("referent_object"))
def referent_objects(spark, sf):
    return figures.code_share(_scoped(spark, sf), "referent_object")


@query("threat_actors", _share_sql("threat_actor"))
def threat_actors(spark, sf):
    return figures.code_share(_scoped(spark, sf), "threat_actor")


@query("measures", _share_sql("extraordinary_measure"))
def measures(spark, sf):
    return figures.code_share(_scoped(spark, sf), "extraordinary_measure")


@query(
    "by_year_and_source",
    """-- uses: figs
    SELECT CAST(year AS INTEGER) AS year, source_label, count(*) AS n FROM figs
    WHERE is_securitising AND year IS NOT NULL GROUP BY ALL""",
)
def by_year_and_source(spark, sf):
    return figures.by_year_and_source(_scoped(spark, sf))


@query(
    "scored_export",
    """-- uses: prepared, scores
    SELECT p.doc_id, p.doc_title, p.doc_date, p.doc_url, p.year, p.juncture, p.category, p.matched_term,
        p.term_lang, p.surface_form, p.sentence, p.context_before, p.context_after, s.sec_score,
        s.is_securitising, s.has_church, s.has_material, s.has_ontological, s.has_decolonise, s.has_urgency,
        p.doc_id || '-' || p.cat_ord || '-' || p.term_ord || '-' || p.sentence_index || '-' || p.match_start
            AS claim_id
    FROM prepared p JOIN scores s ON p.doc_id = s.doc_id""",
)
def scored_export(spark, sf):
    prepared = stored_prepared(spark, sf).withColumn("claim_id", claim_key())
    return reports.scored_claims(prepared).select(*reports.EXPORT_COLUMNS)
