"""Queries on sentences, matches, claims and the corpus summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.catalog.base import (
    FREQUENT,
    overlapping_lexicon,
    query,
    sql_juncture,
    stored_claims,
    stored_prepared,
    study_claims,
    study_corpus,
    study_lemma_lexicon,
    study_lexicon,
    study_prepared,
    study_results,
)
from claimloom.functions import text as T
from claimloom.operators import matching, reports, sampling
from claimloom.settings import fixed
from claimloom.sources.corpus import find_document, list_documents

CLAIM = [*matching.CLAIM_COLUMNS, "match_start", "match_end"]
_CLAIM_SQL = ", ".join(CLAIM)


@query(
    "sentences",
    """-- uses: sents
    SELECT id, sentence_index, sentence FROM sents""",
)
def sentences(spark, sf):
    return matching.sentence_rows(study_corpus(spark, sf)).select(
        "id", "sentence_index", "sentence"
    )


@query(
    "sentence_counts",
    """-- uses: split
    SELECT id, CAST(len(sents) AS INTEGER) AS n FROM split""",
)
def sentence_counts(spark, sf):
    return study_corpus(spark, sf).select("id", F.size(T.sentences(F.col("body_text"))).alias("n"))


@query(
    "corpus_documents",
    r"""-- uses: tcorpus
    SELECT id, url, title, date, content_type, source,
        CAST(len(regexp_extract_all(body_text, '\S+')) AS INTEGER) AS word_count
    FROM tcorpus WHERE length(body_text) > 0""",
)
def corpus_documents(spark, sf):
    docs = study_corpus(spark, sf).where(F.length("body_text") > 0)
    return docs.withColumn("word_count", T.word_count(F.col("body_text"))).drop("body_text")


@query(
    "term_hits",
    f"""-- uses: claims
    SELECT {_CLAIM_SQL} FROM claims""",
)
def term_hits(spark, sf):
    """Every claim with its context and its span within the sentence."""
    return study_claims(spark, sf).select(*CLAIM)


@query(
    "phrase_hits",
    """-- uses: claims
    SELECT doc_id, sentence_index, matched_term_lemma, matched_surface_form, match_start, match_end
    FROM claims WHERE matched_term_lemma LIKE '% %'""",
)
def phrase_hits(spark, sf):
    return study_claims(spark, sf).where(F.contains("matched_term_lemma", F.lit(" "))).select(
        "doc_id", "sentence_index", "matched_term_lemma", "matched_surface_form",
        "match_start", "match_end",
    )


_COMMON = "(?:" + "|".join(FREQUENT) + ")"
# Each word with a mark in front (a blank after white space) and one behind, so that
# regular-expression search over the sentence is search over whole words.
_PATTERNS = (
    ("church_actors", "common common", f"[ #]{_COMMON}; {_COMMON};"),
    ("urgency", "common common common common", f"[ #]{_COMMON}; {_COMMON}; {_COMMON}; {_COMMON};"),
    ("decolonisation", "the of the", "[ #]the; of; the;"),
    ("decolonisation", "common other common", f"[ #]{_COMMON}; (?:is|on|von|en|the|für); {_COMMON};"),
)


@query(
    "overlapping_terms",
    rf"""-- uses: words
    SELECT id AS doc_id, sentence_index, category, term AS matched_term_lemma,
        CAST(len(found) AS BIGINT) AS n_matches, found[1] AS first_match, found[len(found)] AS last_match
    FROM (SELECT id, sentence_index, category, term, list_transform(regexp_extract_all(line, pattern),
            lambda m: rtrim(replace(m[2:], ';', ''))) AS found
        FROM (SELECT id, sentence_index, string_agg(CASE WHEN token_index > 0
                AND regexp_full_match(substr(before, length(last) + 1), '\s+') THEN ' ' ELSE '#' END
                || lower(token) || ';', '' ORDER BY token_index) AS line
            FROM (SELECT *, tokens[token_index] AS last, units[token_index] AS before FROM words)
            GROUP BY id, sentence_index),
        (VALUES {", ".join(f"('{c}', '{t}', '{p}')" for c, t, p in _PATTERNS)}) AS p(category, term, pattern))
    WHERE len(found) > 0""",
)
def overlapping_terms(spark, sf):
    """Matches of phrases that can overlap themselves, counted as a left-to-right search does."""
    found = matching.surface_claims(study_corpus(spark, sf), overlapping_lexicon())
    place = F.struct("token_index", F.regexp_replace(F.lower("matched_surface_form"), r"(?U)\s+", " ").alias("words"))
    return found.groupBy("doc_id", "sentence_index", "category", "matched_term_lemma").agg(
        F.count(F.lit(1)).alias("n_matches"), F.min(place)["words"].alias("first_match"), F.max(place)["words"].alias("last_match")
    )


@query(
    "claims_context",
    """-- uses: claims, sents
    SELECT c.doc_id, c.sentence_index, c.category, c.match_start,
        coalesce(b.sentence, '') AS context_before, coalesce(a.sentence, '') AS context_after
    FROM claims c
    LEFT JOIN sents b ON b.id = c.doc_id AND b.sentence_index = c.sentence_index - 1
    LEFT JOIN sents a ON a.id = c.doc_id AND a.sentence_index = c.sentence_index + 1""",
)
def claims_context(spark, sf):
    return study_claims(spark, sf).select(
        "doc_id", "sentence_index", "category", "match_start", "context_before", "context_after"
    )


@query(
    "claim_numbers",
    """-- uses: claims
    SELECT row_number() OVER (ORDER BY doc_id, cat_ord, term_ord, sentence_index, token_index)
        AS claim_id, doc_id, category, sentence_index, match_start FROM claims""",
)
def claim_numbers(spark, sf):
    """Claims numbered over the whole corpus in search order."""
    narrow = study_claims(spark, sf).select(*matching.CLAIM_ORDER, "category", "match_start")
    return matching.claim_numbers(narrow, study_lexicon()).select(
        "claim_id", "doc_id", "category", "sentence_index", "match_start"
    )


_ANNOTATED = r"[\p{L}\p{N}_]+(?:[''’ʼ-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"


@query(
    "lemma_hits",
    rf"""-- uses: tcorpus, lex
    , raw AS (SELECT id, unnest(s) AS part, unnest(range(len(s))) AS i FROM (
        SELECT id, list_filter(list_transform(flatten(list_transform(string_split(
            regexp_replace(regexp_replace(body_text, '([.!?»"])\s+([A-ZА-ЯІЇЄҐЁ«"])',
                '\1' || chr(1) || '\2', 'g'), '([.!?»"])\s+([A-ZА-ЯІЇЄҐЁ«"])',
                '\1' || chr(1) || '\2', 'g'), chr(1)),
            lambda x: regexp_split_to_array(x, '\n\s*\n'))),
            lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) > 0) AS s FROM tcorpus)),
    listed AS (SELECT id, i, regexp_extract_all(part, '{_ANNOTATED}') AS tokens FROM raw),
    lemmas AS (SELECT * FROM (VALUES ('these', 'this'), ('und', 'with'), ('die', 'der'),
        ('das', 'der'), ('vom', 'von')) AS t(form, lemma)),
    each AS (SELECT id, i, tokens, unnest(tokens) AS token, unnest(range(len(tokens))) AS j
        FROM listed),
    lemmatised AS (SELECT e.*, coalesce(m.lemma, lower(e.token)) AS lemma,
            lead(coalesce(m.lemma, lower(e.token))) OVER (PARTITION BY e.id, e.i ORDER BY e.j) AS next_lemma
        FROM each e LEFT JOIN lemmas m ON lower(e.token) = m.form),
    found AS (SELECT t.*, l.category, l.term, l.lang, l.term_ord, l.w2,
            CASE WHEN l.w2 IS NULL THEN t.token ELSE t.token || ' ' || t.tokens[t.j + 2] END AS surface
        FROM lemmatised t JOIN lex l ON t.lemma = l.w1 AND (l.w2 IS NULL OR t.next_lemma = l.w2))
    SELECT id AS doc_id, category, term AS matched_term_lemma, lang AS matched_term_lang,
        surface AS matched_surface_form, array_to_string(tokens, ' ') AS sentence,
        CAST(i + 1 AS INTEGER) AS sentence_index
    FROM found QUALIFY row_number() OVER (PARTITION BY id, category, i, surface
        ORDER BY (w2 IS NOT NULL), CASE WHEN w2 IS NULL THEN j ELSE term_ord END,
            CASE WHEN w2 IS NULL THEN term_ord ELSE j END) = 1""",
)
def lemma_hits(spark, sf):
    """Claims of the lemma matcher, one per surface form, sentence and dimension."""
    return matching.lemma_claims(study_corpus(spark, sf), study_lemma_lexicon()).select(
        "doc_id", "category", "matched_term_lemma", "matched_term_lang",
        "matched_surface_form", "sentence", "sentence_index",
    )


@query(
    "document_results",
    """-- uses: results
    SELECT id, url, title, date, content_type, source, sentence_count, match_count,
        match_count AS claim_count, is_relevant, array_to_string(cats, ',') AS matched_categories
    FROM results""",
)
def document_results(spark, sf):
    return study_results(spark, sf).select(
        "id", "url", "title", "date", "content_type", "source", "sentence_count",
        "match_count", "claim_count", "is_relevant",
        F.array_join("matched_categories", ",").alias("matched_categories"),
    )


@query(
    "matched_terms",
    """-- uses: claims
    , firsts AS (SELECT doc_id, category, matched_term_lemma AS term, min(term_ord) AS o
        FROM claims GROUP BY ALL)
    SELECT doc_id, category, string_agg(term, ',' ORDER BY o) AS terms
    FROM firsts GROUP BY doc_id, category""",
)
def matched_terms(spark, sf):
    """The terms of each dimension per document, in the order they were found."""
    return study_results(spark, sf).select(
        F.col("id").alias("doc_id"), F.explode("matched_terms").alias("category", "_t")
    ).select("doc_id", "category", F.array_join("_t", ",").alias("terms"))


@query(
    "doc_relevance",
    """-- uses: results
    SELECT id, is_relevant FROM results""",
)
def doc_relevance(spark, sf):
    return study_results(spark, sf).select("id", "is_relevant")


@query(
    "claims_by_category",
    """-- uses: claims
    SELECT category, count(*) AS n FROM claims GROUP BY category""",
)
def claims_by_category(spark, sf):
    return reports.claims_by_category(study_claims(spark, sf))


@query(
    "top_terms",
    """-- uses: claims
    SELECT matched_term_lemma AS term, count(*) AS n FROM claims GROUP BY 1
    ORDER BY n DESC, term LIMIT 30""",
)
def top_terms(spark, sf):
    return reports.top_terms(study_claims(spark, sf))


@query(
    "summary_overview",
    """-- uses: results, claims
    SELECT count(*) AS total_documents, count(CASE WHEN content_type = 'speech' THEN 1 END) AS total_speeches,
        count(CASE WHEN content_type = 'press_release' THEN 1 END) AS total_press,
        count(CASE WHEN is_relevant THEN 1 END) AS relevant_docs,
        count(CASE WHEN is_relevant AND content_type = 'speech' THEN 1 END) AS relevant_speeches,
        count(CASE WHEN is_relevant AND content_type = 'press_release' THEN 1 END) AS relevant_press,
        CAST(sum(match_count) AS BIGINT) AS total_claims,
        (SELECT count(DISTINCT sentence) FROM claims) AS unique_sentences
    FROM results""",
)
def summary_overview(spark, sf):
    found = stored_claims(spark, sf)
    return reports.overview(study_results(spark, sf, found), found)


_YEARLY = """-- uses: results
    SELECT coalesce(substr(date, 1, 4), 'unknown') AS year, count(*) AS total_docs,
        count(CASE WHEN content_type = 'speech' THEN 1 END) AS speeches,
        count(CASE WHEN {press} THEN 1 END) AS press_releases, count(CASE WHEN is_relevant THEN 1 END) AS relevant_docs,
        count(CASE WHEN is_relevant AND content_type = 'speech' THEN 1 END) AS relevant_speeches,
        count(CASE WHEN is_relevant AND {press} THEN 1 END) AS relevant_press,
        CAST(sum(match_count) AS BIGINT) AS total_claims
    FROM results GROUP BY 1"""


@query("yearly_breakdown", _YEARLY.format(press="content_type = 'press_release'"))
def yearly_breakdown(spark, sf):
    return reports.yearly_breakdown(study_results(spark, sf))


@query("yearly_breakdown_two_kinds", _YEARLY.format(press="content_type <> 'speech'"))
def yearly_breakdown_two_kinds(spark, sf):
    return reports.yearly_breakdown(study_results(spark, sf), others_are_press=True)


_PERIODS = ", ".join(f"('{n}', '{s} to {e}')" for n, (s, e) in fixed.JUNCTURES.items())


@query(
    "juncture_breakdown",
    f"""-- uses: results
    , periods AS (SELECT * FROM (VALUES {_PERIODS}) AS t(juncture, date_range))
    SELECT p.juncture, p.date_range, count(r.id) AS total_docs,
        count(CASE WHEN r.is_relevant THEN 1 END) AS relevant_docs,
        CAST(coalesce(sum(r.match_count), 0) AS BIGINT) AS total_claims
    FROM periods p LEFT JOIN results r ON r.date BETWEEN split_part(p.date_range, ' to ', 1)
        AND split_part(p.date_range, ' to ', 2)
    GROUP BY p.juncture, p.date_range""",
)
def juncture_breakdown(spark, sf):
    return reports.juncture_breakdown(study_results(spark, sf))


@query(
    "juncture_labels",
    f"""-- uses: tcorpus
    SELECT id, {sql_juncture('date')} AS juncture,
        {sql_juncture('date', "'unknown'", "'outside_junctures'")} AS labelled FROM tcorpus""",
)
def juncture_labels(spark, sf):
    from claimloom.functions.dates import juncture_of

    date = F.col("date")
    return study_corpus(spark, sf).select(
        "id",
        juncture_of(date).alias("juncture"),
        juncture_of(date, missing="unknown", outside="outside_junctures").alias("labelled"),
    )


@query(
    "category_sets",
    """-- uses: results
    SELECT array_to_string(cats, ', ') AS categories, count(*) AS n FROM results
    WHERE is_relevant GROUP BY 1 ORDER BY n DESC, categories LIMIT 20""",
)
def category_sets(spark, sf):
    return reports.category_sets(study_results(spark, sf))


# --- scores and report tables ------------------------------------------------


@query(
    "claims_prepared",
    """-- uses: prepared
    SELECT doc_id, doc_title, doc_date, doc_url, category, matched_term, term_lang, surface_form,
        sentence, sentence_index, context_before, context_after, juncture, year FROM prepared""",
)
def claims_prepared(spark, sf):
    return study_prepared(spark, sf).select(
        "doc_id", "doc_title", "doc_date", "doc_url", "category", "matched_term", "term_lang",
        "surface_form", "sentence", "sentence_index", "context_before", "context_after",
        "juncture", "year",
    )


@query(
    "doc_category_rollup",
    """-- uses: perdoc
    SELECT doc_id, array_to_string(cats, ',') AS categories, n_categories, n_claims FROM perdoc""",
)
def doc_category_rollup(spark, sf):
    return study_claims(spark, sf).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.count_distinct("category").alias("n_categories"),
        F.count("*").alias("n_claims"),
    )


@query(
    "intensity_scores",
    """-- uses: scores
    SELECT * FROM scores""",
)
def intensity_scores(spark, sf):
    return reports.document_scores(study_claims(spark, sf))


@query(
    "scores_on_claims",
    """-- uses: prepared, scores
    SELECT p.doc_id, p.category, p.sentence_index, p.match_start, p.year, p.juncture,
        s.* EXCLUDE (doc_id) FROM prepared p LEFT JOIN scores s ON p.doc_id = s.doc_id""",
)
def scores_on_claims(spark, sf):
    return reports.scored_claims(
        stored_prepared(spark, sf).select(
            "doc_id", "category", "sentence_index", "match_start", "year", "juncture"
        )
    )


@query(
    "cooccurrence",
    """-- uses: perdoc
    , cats AS (SELECT unnest(['church_actors', 'material_security', 'ontological_security',
        'decolonisation', 'urgency']) AS c)
    SELECT a.c AS cat_a, b.c AS cat_b,
        (SELECT count(*) FROM perdoc WHERE list_contains(cats, a.c) AND list_contains(cats, b.c)) AS n
    FROM cats a CROSS JOIN cats b""",
)
def cooccurrence(spark, sf):
    return reports.cooccurrence(study_claims(spark, sf))


@query(
    "cooccurrence_matrix",
    """-- uses: perdoc
    SELECT c AS cat_a, count(CASE WHEN list_contains(cats, 'church_actors') THEN 1 END) AS church_actors,
        count(CASE WHEN list_contains(cats, 'material_security') THEN 1 END) AS material_security,
        count(CASE WHEN list_contains(cats, 'ontological_security') THEN 1 END) AS ontological_security,
        count(CASE WHEN list_contains(cats, 'decolonisation') THEN 1 END) AS decolonisation,
        count(CASE WHEN list_contains(cats, 'urgency') THEN 1 END) AS urgency
    FROM (SELECT cats, unnest(cats) AS c FROM perdoc) GROUP BY c""",
)
def cooccurrence_matrix(spark, sf):
    return reports.cooccurrence_matrix(study_claims(spark, sf))


@query(
    "claims_by_juncture",
    """-- uses: prepared
    SELECT juncture, count(CASE WHEN category = 'church_actors' THEN 1 END) AS church_actors,
        count(CASE WHEN category = 'material_security' THEN 1 END) AS material_security,
        count(CASE WHEN category = 'ontological_security' THEN 1 END) AS ontological_security,
        count(CASE WHEN category = 'decolonisation' THEN 1 END) AS decolonisation,
        count(CASE WHEN category = 'urgency' THEN 1 END) AS urgency
    FROM prepared WHERE juncture IS NOT NULL GROUP BY juncture""",
)
def claims_by_juncture(spark, sf):
    return reports.claims_by_juncture(study_prepared(spark, sf))


@query(
    "intensity_by_juncture",
    f"""-- uses: scores, tcorpus
    SELECT {sql_juncture('c.date')} AS juncture, count(*) AS n_documents,
        count(CASE WHEN s.is_securitising THEN 1 END) AS n_securitising,
        round(100.0 * count(CASE WHEN s.is_securitising THEN 1 END) / count(*), 1)::DOUBLE AS pct_securitising,
        round(avg(s.sec_score), 2) AS mean_score, quantile_cont(s.sec_score, 0.5)::DOUBLE AS median_score,
        max(s.sec_score) AS max_score
    FROM scores s JOIN tcorpus c ON s.doc_id = c.id
    WHERE {sql_juncture('c.date')} IS NOT NULL GROUP BY 1""",
)
def intensity_by_juncture(spark, sf):
    return reports.intensity_by_juncture(study_prepared(spark, sf))


@query(
    "top_terms_by_juncture",
    """-- uses: prepared
    , counted AS (SELECT juncture, matched_term, count(*) AS freq FROM prepared
        WHERE juncture IS NOT NULL GROUP BY ALL)
    SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY juncture
        ORDER BY freq DESC, matched_term) <= 10""",
)
def top_terms_by_juncture(spark, sf):
    return reports.top_terms_by_juncture(study_prepared(spark, sf))


@query(
    "yearly_trend",
    """-- uses: prepared
    SELECT year, count(*) AS n_claims, count(DISTINCT doc_id) AS n_documents,
        count(DISTINCT category) AS n_categories
    FROM prepared WHERE year IS NOT NULL GROUP BY year""",
)
def yearly_trend(spark, sf):
    return reports.yearly_trend(study_prepared(spark, sf))


@query(
    "category_summary",
    """-- uses: prepared
    SELECT category, count(*) AS n_claims, count(DISTINCT doc_id) AS n_documents,
        count(DISTINCT matched_term) AS n_unique_terms FROM prepared GROUP BY category""",
)
def category_summary(spark, sf):
    return reports.category_summary(study_prepared(spark, sf))


@query(
    "material_vs_ontological",
    """-- uses: prepared
    SELECT year, count(CASE WHEN category = 'material_security' THEN 1 END) AS material_security,
        count(CASE WHEN category = 'ontological_security' THEN 1 END) AS ontological_security
    FROM prepared WHERE year IS NOT NULL AND category IN ('material_security', 'ontological_security')
    GROUP BY year""",
)
def material_vs_ontological(spark, sf):
    return reports.material_vs_ontological(study_prepared(spark, sf))


@query(
    "document_summary",
    """-- uses: prepared, scores
    SELECT p.doc_id, p.doc_title, p.doc_date, p.doc_url, p.year, p.juncture, p.surface_form AS first_form,
        s.n_claims, s.n_categories, s.sec_score, s.is_securitising
    FROM (SELECT * FROM prepared QUALIFY row_number() OVER (PARTITION BY doc_id
        ORDER BY cat_ord, term_ord, sentence_index, token_index) = 1) p
    JOIN scores s ON p.doc_id = s.doc_id""",
)
def document_summary(spark, sf):
    """First claim and score per document."""
    prepared = stored_prepared(spark, sf)
    order = [F.asc(c) for c in matching.CLAIM_ORDER[1:]]
    narrow = prepared.select(
        *matching.CLAIM_ORDER, "doc_title", "doc_date", "doc_url", "year", "juncture",
        F.col("surface_form").alias("first_form"),
    )
    first = reports.first_per_key(narrow, ["doc_id"], order)
    scores = reports.document_scores(prepared).select(
        "doc_id", "n_claims", "n_categories", "sec_score", "is_securitising"
    )
    return first.drop(*matching.CLAIM_ORDER[1:]).join(scores, "doc_id")


@query(
    "category_listing",
    """-- uses: claims
    SELECT category, CASE category
        WHEN 'church_actors' THEN 'Terms identifying the churches and religious actors'
        WHEN 'material_security' THEN 'Material security / threat to the physical state'
        WHEN 'ontological_security' THEN 'Ontological security / threat to the national self'
        WHEN 'decolonisation' THEN 'Decolonisation and identity-restorative language'
        ELSE 'Urgency, existential intensity, exceptional measures' END AS description,
        count(*) AS n FROM claims GROUP BY ALL""",
)
def category_listing(spark, sf):
    return reports.category_listing(
        study_claims(spark, sf), study_lexicon().description_frame(spark)
    )


@query(
    "distinct_doc_categories",
    """-- uses: claims
    SELECT DISTINCT doc_id, category FROM claims""",
)
def distinct_doc_categories(spark, sf):
    return study_claims(spark, sf).select("doc_id", "category").distinct()


# --- filters and lookups -----------------------------------------------------


@query(
    "filter_category",
    f"""-- uses: claims
    SELECT {_CLAIM_SQL} FROM claims WHERE category = 'ontological_security'""",
)
def filter_category(spark, sf):
    return sampling.filter_claims(
        study_claims(spark, sf), category="ontological_security"
    ).select(*CLAIM)


@query(
    "filter_claims_term",
    f"""-- uses: claims
    SELECT {_CLAIM_SQL} FROM claims WHERE contains(lower(matched_term_lemma), 'th')
        OR contains(lower(matched_surface_form), 'th')""",
)
def filter_claims_term(spark, sf):
    return sampling.filter_claims(study_claims(spark, sf), term="TH").select(*CLAIM)


@query(
    "filter_claims_juncture",
    f"""-- uses: claims
    SELECT {_CLAIM_SQL} FROM claims WHERE doc_date BETWEEN '2022-02-24' AND '2023-12-31'""",
)
def filter_claims_juncture(spark, sf):
    return sampling.filter_claims(
        study_claims(spark, sf), juncture="J2_invasion_2022"
    ).select(*CLAIM)


@query(
    "claims_of_document",
    f"""-- uses: claims
    SELECT {_CLAIM_SQL} FROM claims WHERE doc_id = '42'""",
)
def claims_of_document(spark, sf):
    return sampling.filter_claims(study_claims(spark, sf), doc_id="42").select(*CLAIM)


@query(
    "document_lookup",
    """-- uses: tcorpus
    SELECT id, title, date, url, body_text FROM tcorpus WHERE id = '42'""",
)
def document_lookup(spark, sf):
    return find_document(study_corpus(spark, sf), "42").select(
        "id", "title", "date", "url", "body_text"
    )


@query(
    "document_listing",
    """-- uses: tcorpus
    SELECT id, coalesce(date, '?') AS date, substr(title, 1, 55) AS title FROM tcorpus
    ORDER BY id LIMIT 20""",
)
def document_listing(spark, sf):
    return list_documents(study_corpus(spark, sf))
