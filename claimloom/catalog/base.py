"""Inputs shared by the registered queries, in Spark and as SQL.

The given texts are not Ukrainian, so the queries run the operators with a
lexicon of frequent words of those texts; dates and document kinds are derived
from the document number.  Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.compose import choose, with_computed
from claimloom.functions.inflect import same
from claimloom.operators import matching, reports
from claimloom.operators.lexicon import lemma_lexicon, surface_lexicon
from claimloom.plans.layout import spread, written
from claimloom.settings import fixed
from claimloom.settings.lexicons import DESCRIPTIONS, Dimension

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KINDS = ("speech", "press_release", "rada_stenogram", "sbu_press_release", "dess_statement")
LEXICON = (
    Dimension("church_actors", DESCRIPTIONS["church_actors"], {"a": ("this", "worthless"), "b": ("der",)}, {}),
    Dimension("material_security", DESCRIPTIONS["material_security"], {"a": ("with", "of the"), "b": ("für",)}, {}),
    Dimension("ontological_security", DESCRIPTIONS["ontological_security"], {"a": ("that",), "b": ("que",)}, {}),
    Dimension("decolonisation", DESCRIPTIONS["decolonisation"], {"a": ("from", "les"), "b": ("les",)}, {}),
    Dimension("urgency", DESCRIPTIONS["urgency"], {"a": ("was",), "b": ("von",)}, {}),
)
STEMS = ("worthless", "with", "that", "über", "avec", "with")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that gives the same rows."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_needed(sql)
        return run

    return register


# --- Spark side --------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, spread over the cores where it is small."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def study_date(doc_id: Column) -> Column:
    day = F.date_add(F.lit("2018-01-01").cast("date"), ((doc_id * 37) % 2922).cast("int"))
    return F.when(doc_id % 23 != 0, F.date_format(day, "yyyy-MM-dd"))


def study_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in the shape of a corpus."""
    number = F.col("doc_id")
    kind = F.substring("source", 4, 10).cast("int") % 5
    return texts(spark, sf_dir).select(
        number.cast("string").alias("id"),
        F.concat(F.lit("https://corpus.example.org/news/"), number.cast("string")).alias("url"),
        F.concat(F.lit("Document "), number.cast("string")).alias("title"),
        study_date(number).alias("date"),
        choose(kind, dict(enumerate(KINDS))).alias("content_type"),
        "source",
        F.col("text").alias("body_text"),
    )


def study_lexicon():
    return surface_lexicon(LEXICON, expand=same)


# Frequent words of the given texts stand for the forms of one word, so that matches overlap.
FREQUENT = ("the", "of", "to", "in", "was", "that", "der", "die", "und", "les", "des", "que", "de", "la")
OVERLAPPING = (
    Dimension("church_actors", DESCRIPTIONS["church_actors"], {"a": ("common common",)}, {}),
    Dimension("urgency", DESCRIPTIONS["urgency"], {"a": ("common common common common",)}, {}),
    Dimension("decolonisation", DESCRIPTIONS["decolonisation"], {"a": ("the of the", "common other common")}, {}),
)


def overlapping_lexicon():
    """Phrases of up to four words with many forms each, which can overlap themselves."""
    forms = {("a", "common"): frozenset(FREQUENT), ("a", "other"): frozenset({"is", "on", "von", "en", "the", "für"})}
    return surface_lexicon(OVERLAPPING, expand=same, forms=forms)


def study_lemma_lexicon():
    """Lemmas with a few inflected words each, as a dictionary would give them."""
    forms = {
        ("a", "this"): frozenset({"this", "these"}),
        ("a", "with"): frozenset({"with", "und"}),
        ("b", "der"): frozenset({"der", "die", "das"}),
        ("b", "von"): frozenset({"von", "vom"}),
    }
    dimensions = tuple(
        Dimension(
            d.name,
            d.description,
            {k: tuple(t for t in v if " " not in t) for k, v in d.terms.items()},
            {k: tuple(t for t in v if " " in t) for k, v in d.terms.items()},
        )
        for d in LEXICON
    )
    return lemma_lexicon(dimensions, expand=same, forms=forms)


def study_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.surface_claims(study_corpus(spark, sf_dir), study_lexicon())


def stored_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims kept as a table, for queries that use them more than once."""
    return written(study_claims(spark, sf_dir))


def stored_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.prepared_claims(stored_claims(spark, sf_dir))


def study_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.prepared_claims(study_claims(spark, sf_dir))


def study_results(
    spark: SparkSession, sf_dir: str, found: DataFrame | None = None
) -> DataFrame:
    docs = study_corpus(spark, sf_dir)
    if found is None:
        found = matching.surface_claims(docs, study_lexicon())
    return matching.document_results(docs, found, study_lexicon())


def claim_key() -> Column:
    """A key for a claim that needs no global numbering."""
    return F.concat_ws(
        "-", "doc_id", F.col("cat_ord").cast("string"), F.col("term_ord").cast("string"),
        F.col("sentence_index").cast("string"), F.col("match_start").cast("string"),
    )


def study_coded(
    spark: SparkSession, sf_dir: str, prepared: DataFrame | None = None
) -> DataFrame:
    """Claims with codes of two coders, derived from lengths and offsets."""
    if prepared is None:
        prepared = study_prepared(spark, sf_dir)
    size, start = F.col("_size"), F.col("_start")
    measured = with_computed(
        prepared,
        {"_size": F.length("sentence"), "_start": F.col("match_start")},
    )
    return measured.withColumns(
        {
            "claim_id": claim_key(),
            "is_securitising": F.when(size % 7 != 0, size % 3 == 0),
            "category_correct": F.when(size % 7 != 0, start % 5 != 0),
            "securitisation_type": _code(size, "securitisation_type"),
            "referent_object": _code(size + start, "referent_object"),
            "threat_actor": _code(size + 2 * start, "threat_actor"),
            "extraordinary_measure": _code(size + 3 * start, "extraordinary_measure"),
            "confidence": F.when(size % 11 != 0, size % 3 + 1),
            "human_is_securitising": F.when(start % 13 != 0, (size + start % 4) % 3 == 0),
            "human_category_correct": start % 4 != 0,
            "human_securitisation_type": _code(size + start % 2, "securitisation_type"),
        }
    ).drop("_size", "_start")


def _code(number: Column, name: str) -> Column:
    domain = fixed.CODE_DOMAINS[name]
    return choose(number % len(domain), dict(enumerate(domain)))


def study_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coder entries per labelled document, all columns text as coders give them."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        n.cast("string").alias("doc_id"),
        F.concat(F.lit("passage "), n.cast("string")).alias("passage"),
        F.when(F.col("quality") == 1, F.when(n % 2 == 0, "TRUE").otherwise("yes"))
        .otherwise(F.when(n % 5 == 0, F.lit(None)).otherwise("no"))
        .alias("is_securitising"),
        *[
            F.when(n % 17 != 0, _code(n + i, c)).alias(c)
            for i, c in enumerate(fixed.CODE_COLUMNS)
        ],
        F.when(n % 19 != 0, (n % 3 + 1).cast("string")).alias("confidence"),
        F.when(F.col("toxic") == 1, "toxic").alias("coder_notes"),
    )


# --- SQL side ----------------------------------------------------------------


def _sql_code(number: str, name: str) -> str:
    domain = fixed.CODE_DOMAINS[name]
    whens = " ".join(f"WHEN {i} THEN '{code}'" for i, code in enumerate(domain))
    return f"CASE ({number}) % {len(domain)} {whens} END"


def _sql_protected(column: str) -> str:
    for abbreviation in fixed.ABBREVIATIONS:
        guarded = abbreviation.replace(".", "<<<DOT>>>")
        column = f"replace({column}, '{abbreviation}', '{guarded}')"
    return column


def _sql_lexicon() -> str:
    rows = []
    for cat_ord, dimension in enumerate(LEXICON):
        term_ord = 0
        for lang, terms in dimension.terms.items():
            for term in terms:
                first, _, second = term.partition(" ")
                tail = f"'{second}'" if second else "NULL"
                rows.append(
                    f"('{dimension.name}', {cat_ord}, '{term}', '{lang}', {term_ord}, '{first}', {tail})"
                )
                term_ord += 1
    return ", ".join(rows)


def sql_juncture(column: str, missing: str = "NULL", outside: str = "NULL") -> str:
    whens = " ".join(
        f"WHEN {column} BETWEEN '{start}' AND '{end}' THEN '{name}'"
        for name, (start, end) in fixed.JUNCTURES.items()
    )
    return f"CASE WHEN {column} IS NULL OR {column} IN ('', 'unknown') THEN {missing} {whens} ELSE {outside} END"


_BREAK = r'([.!?»"])\s+([A-ZА-ЯІЇЄҐЁ«"])'
_KIND_WHENS = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "tcorpus": (
        (),
        f"""SELECT CAST(doc_id AS VARCHAR) AS id,
            'https://corpus.example.org/news/' || doc_id AS url,
            'Document ' || doc_id AS title,
            CASE WHEN doc_id % 23 <> 0 THEN strftime(DATE '2018-01-01'
                + CAST((doc_id * 37) % 2922 AS INTEGER), '%Y-%m-%d') END AS date,
            CASE CAST(substr(source, 4) AS INTEGER) % 5 {_KIND_WHENS} END AS content_type,
            source, text AS body_text
        FROM documents""",
    ),
    # The look-around split becomes two marking passes: a quote may close one
    # sentence and open the next, so alternate breaks need the second pass.
    "split": (
        ("tcorpus",),
        f"""SELECT * EXCLUDE (parts), list_filter(list_transform(parts,
                lambda p: trim(replace(p, '<<<DOT>>>', '.'), {_SPACES})),
                lambda p: length(p) > 10) AS sents
        FROM (SELECT *, flatten(list_transform(string_split(
                regexp_replace(regexp_replace({_sql_protected('body_text')},
                    '{_BREAK}', '\\1' || chr(1) || '\\2', 'g'),
                    '{_BREAK}', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
                lambda s: regexp_split_to_array(s, '\\n\\s*\\n'))) AS parts
            FROM tcorpus)""",
    ),
    "sents": (
        ("split",),
        """SELECT * EXCLUDE (body_text), unnest(sents) AS sentence,
            CAST(unnest(range(len(sents))) AS INTEGER) AS sentence_index FROM split""",
    ),
    "words": (
        ("sents",),
        r"""SELECT *, unnest(tokens) AS token, unnest(units) AS unit,
            CAST(unnest(range(len(tokens))) AS INTEGER) AS token_index
        FROM (SELECT *, regexp_extract_all(sentence, '[\p{L}\p{N}_]+') AS tokens,
            regexp_extract_all(sentence, '[\p{L}\p{N}_]+[^\p{L}\p{N}_]*') AS units
            FROM sents)""",
    ),
    "lex": (
        (),
        f"""SELECT * FROM (VALUES {_sql_lexicon()})
            AS t(category, cat_ord, term, lang, term_ord, w1, w2)""",
    ),
    "placed": (
        ("words",),
        r"""SELECT *, length(regexp_extract(sentence, '^[^\p{L}\p{N}_]*')) + CAST(coalesce(
            sum(length(unit)) OVER (PARTITION BY id, sentence_index ORDER BY token_index
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at
        FROM words""",
    ),
    "hits": (
        ("placed", "lex"),
        r"""SELECT p.*, l.category, l.cat_ord, l.term, l.lang, l.term_ord,
            CASE WHEN l.w2 IS NULL THEN p.token ELSE p.unit || p.tokens[p.token_index + 2] END AS surface
        FROM placed p JOIN lex l ON lower(p.token) = l.w1
        WHERE l.w2 IS NULL OR (lower(p.tokens[p.token_index + 2]) = l.w2
            AND regexp_full_match(substr(p.unit, length(p.token) + 1), '\s+'))""",
    ),
    "claims": (
        ("hits",),
        """SELECT id AS doc_id, title AS doc_title, date AS doc_date, url AS doc_url, content_type,
            category, term AS matched_term_lemma, lang AS matched_term_lang,
            surface AS matched_surface_form, sentence, sentence_index,
            coalesce(sents[sentence_index], '') AS context_before,
            coalesce(sents[sentence_index + 2], '') AS context_after,
            CAST(start_at AS INTEGER) AS match_start,
            CAST(start_at + length(surface) AS INTEGER) AS match_end,
            cat_ord, term_ord, token_index
        FROM hits QUALIFY row_number() OVER (PARTITION BY id, category, sentence_index,
            start_at, length(surface) ORDER BY term_ord) = 1""",
    ),
    "prepared": (
        ("claims",),
        f"""SELECT * RENAME (matched_term_lemma AS matched_term, matched_term_lang AS term_lang,
                matched_surface_form AS surface_form),
            {sql_juncture('doc_date')} AS juncture, substr(doc_date, 1, 4) AS year FROM claims""",
    ),
    "perdoc": (
        ("claims",),
        """SELECT doc_id, list_sort(list(DISTINCT category)) AS cats, count(*) AS n_claims,
            count(DISTINCT category) AS n_categories,
            bool_or(category = 'church_actors') AS has_church,
            bool_or(category = 'material_security') AS has_material,
            bool_or(category = 'ontological_security') AS has_ontological,
            bool_or(category = 'decolonisation') AS has_decolonise,
            bool_or(category = 'urgency') AS has_urgency
        FROM claims GROUP BY doc_id""",
    ),
    "results": (
        ("split", "perdoc"),
        """SELECT s.id, s.url, s.title, s.date, s.content_type, s.source,
            CAST(len(s.sents) AS INTEGER) AS sentence_count,
            coalesce(d.n_claims, 0) AS match_count, coalesce(d.cats, []) AS cats,
            coalesce(d.has_church AND len(d.cats) > 1, FALSE) AS is_relevant
        FROM split s LEFT JOIN perdoc d ON s.id = d.doc_id""",
    ),
    "scores": (
        ("perdoc",),
        """SELECT doc_id, CAST(n_categories AS INTEGER) AS n_categories, n_claims, has_church,
            has_material, has_ontological, has_decolonise, has_urgency,
            CASE WHEN has_church THEN CAST(has_material AS INTEGER) + CAST(has_ontological AS INTEGER)
                + CAST(has_decolonise AS INTEGER) + CAST(has_urgency AS INTEGER)
                + CAST(has_material AND has_ontological AS INTEGER) ELSE 0 END AS sec_score,
            has_church AND (has_material OR has_ontological OR has_decolonise OR has_urgency)
                AS is_securitising
        FROM perdoc""",
    ),
    "coded": (
        ("prepared",),
        f"""SELECT *, doc_id || '-' || cat_ord || '-' || term_ord || '-' || sentence_index || '-'
                || match_start AS claim_id,
            CASE WHEN length(sentence) % 7 <> 0 THEN length(sentence) % 3 = 0 END AS is_securitising,
            CASE WHEN length(sentence) % 7 <> 0 THEN match_start % 5 <> 0 END AS category_correct,
            {_sql_code('length(sentence)', 'securitisation_type')} AS securitisation_type,
            {_sql_code('length(sentence) + match_start', 'referent_object')} AS referent_object,
            {_sql_code('length(sentence) + 2 * match_start', 'threat_actor')} AS threat_actor,
            {_sql_code('length(sentence) + 3 * match_start', 'extraordinary_measure')}
                AS extraordinary_measure,
            CASE WHEN length(sentence) % 11 <> 0 THEN CAST(length(sentence) % 3 + 1 AS INTEGER) END
                AS confidence,
            CASE WHEN match_start % 13 <> 0 THEN (length(sentence) + match_start % 4) % 3 = 0 END
                AS human_is_securitising,
            match_start % 4 <> 0 AS human_category_correct,
            {_sql_code('length(sentence) + match_start % 2', 'securitisation_type')}
                AS human_securitisation_type
        FROM prepared""",
    ),
    "entries": (
        (),
        f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'passage ' || doc_id AS passage,
            CASE WHEN quality = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'TRUE' ELSE 'yes' END
                WHEN doc_id % 5 <> 0 THEN 'no' END AS is_securitising,
            {', '.join(
                f"CASE WHEN doc_id % 17 <> 0 THEN {_sql_code(f'doc_id + {i}', c)} END AS {c}"
                for i, c in enumerate(fixed.CODE_COLUMNS))},
            CASE WHEN doc_id % 19 <> 0 THEN CAST(doc_id % 3 + 1 AS VARCHAR) END AS confidence,
            CASE WHEN toxic = 1 THEN 'toxic' END AS coder_notes
        FROM labels""",
    ),
    "merged": (
        ("entries", "tcorpus"),
        f"""SELECT e.* REPLACE (coalesce(lower(e.is_securitising) IN ('true', '1', 'yes'), FALSE)
                AS is_securitising, CAST(e.confidence AS INTEGER) AS confidence),
            c.title AS doc_title, c.date AS doc_date, c.source AS doc_source,
            c.content_type AS doc_content_type, c.url AS doc_url,
            {sql_juncture('c.date', "'unknown'", "'outside_junctures'")} AS juncture,
            substr(c.date, 1, 4) AS year
        FROM entries e LEFT JOIN tcorpus c ON e.doc_id = c.id""",
    ),
    "figs": (
        ("merged",),
        """SELECT *, CASE doc_content_type WHEN 'speech' THEN 'Zelensky'
                WHEN 'poroshenko_speech' THEN 'Poroshenko' WHEN 'rada_stenogram' THEN 'Rada'
                WHEN 'sbu_press_release' THEN 'SBU' WHEN 'dess_statement' THEN 'DESS'
                ELSE 'Other' END AS source_label
        FROM merged WHERE year IS NULL OR CAST(year AS INTEGER) >= 2018""",
    ),
}


def with_needed(body: str) -> str:
    """Put the parts a query names in front of it, in order of need.

    The body starts with ``-- uses: a, b`` where it needs any.
    """
    first, _, rest = body.strip().partition("\n")
    if not first.startswith("-- uses:"):
        return body.strip()
    ordered: list[str] = []

    def need(name: str) -> None:
        if name not in ordered:
            for other in PARTS[name][0]:
                need(other)
            ordered.append(name)

    for name in first.removeprefix("-- uses:").split(","):
        need(name.strip())
    clauses = ",\n".join(f"{name} AS ({PARTS[name][1]})" for name in ordered)
    return f"WITH {clauses}\n{rest.strip()}"
