"""Queries on text and date functions and on preparing texts for coders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.catalog.base import STEMS, query, study_corpus, study_date, table, texts
from claimloom.functions import dates
from claimloom.functions import text as T
from claimloom.operators import ingest, morphology, packing, tagging
from claimloom.settings import fixed

NAVIGATION = (r"^\s*$", r"^(The|Les|Der|La)\s", r"^Die\b", r"\|")
MARKERS = ("the of", "that", "with", "avec", "les des", "und der")
SESSION = ("worthless", "nicht", "pour")

_WORDS = r"len(regexp_extract_all({}, '\S+'))"


def _sql_count(column: str, stem: str) -> str:
    return f"((length({column}) - length(replace({column}, '{stem}', ''))) // {len(stem)})"


_TOTAL = "(" + " + ".join(_sql_count("t", s) for s in STEMS) + ")"
_DISTINCT = "(" + " + ".join(f"CAST(contains(t, '{s}') AS INTEGER)" for s in STEMS) + ")"
_ANY_STEM = "(" + " OR ".join(f"contains({{0}}, '{s}')" for s in dict.fromkeys(STEMS)) + ")"
_NAV_SQL = " OR ".join(f"regexp_matches(l, '{p}')" for p in NAVIGATION)


@query(
    "word_counts",
    f"""SELECT doc_id, CAST({_WORDS.format('text')} AS INTEGER) AS n_words,
        CAST(trunc({_WORDS.format('text')} * 3.5) AS INTEGER) AS tokens_est FROM documents""",
)
def word_counts(spark, sf):
    text = F.col("text")
    return texts(spark, sf).select(
        "doc_id", T.word_count(text).alias("n_words"), T.estimate_tokens(text).alias("tokens_est")
    )


@query(
    "tidy_whitespace",
    r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(text, chr(9), ' '),
        ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS tidy
        FROM conversations""",
)
def tidy_whitespace(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.tidy_whitespace(F.col("text")).alias("tidy")
    )


@query(
    "clean_lines",
    f"""SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)),
        lambda l: NOT ({_NAV_SQL})), chr(10)), ' {{2,}}', ' ', 'g'),
        ' ' || chr(10) || chr(9) || chr(13)) AS cleaned FROM documents""",
)
def clean_lines(spark, sf):
    return texts(spark, sf).select(
        "doc_id", T.clean_body(F.col("text"), NAVIGATION).alias("cleaned")
    )


@query(
    "relevance_density",
    f"""SELECT doc_id, CAST({_DISTINCT} AS INTEGER) AS n_distinct, CAST({_TOTAL} AS INTEGER) AS n_total,
        {_DISTINCT} >= 2 OR {_TOTAL} >= 3 AS is_relevant
        FROM (SELECT doc_id, source || ' ' || text AS t FROM documents)""",
)
def relevance_density(spark, sf):
    combined = F.concat("source", F.lit(" "), "text")
    return texts(spark, sf).select(
        "doc_id",
        T.stem_density(combined, STEMS).alias("d"),
        T.is_relevant(F.col("text"), F.col("source"), STEMS).alias("is_relevant"),
    ).select("doc_id", "d.n_distinct", "d.n_total", "is_relevant")


_MARKERS_SQL = " + ".join(f"CAST(regexp_matches(body, '(?i){m}') AS INTEGER)" for m in MARKERS)
_SESSION_SQL = " OR ".join(f"contains(body, '{m}')" for m in SESSION)
_BROKEN = f"""(body IS NULL OR length(body) < 200 OR ({_MARKERS_SQL}) >= 3
    OR (NOT ({_SESSION_SQL}) AND length(body) < 2000))"""


@query(
    "boilerplate",
    f"SELECT doc_id, {_BROKEN} AS is_broken FROM (SELECT doc_id, text AS body FROM documents)",
)
def boilerplate(spark, sf):
    return texts(spark, sf).select(
        "doc_id", T.is_boilerplate(F.col("text"), MARKERS, SESSION).alias("is_broken")
    )


@query(
    "urls_to_refetch",
    f"""-- uses: tcorpus
    SELECT url FROM (SELECT url, source, body_text AS body FROM tcorpus)
    WHERE source = 'src3' AND {_BROKEN}""",
)
def urls_to_refetch(spark, sf):
    return ingest.urls_to_refetch(
        study_corpus(spark, sf), "src3", markers=MARKERS, session_markers=SESSION
    )


# The third document kind in the place of the tracked site, a common word in the
# place of the speaker's name.
SPEECH = {
    "patterns": (r"\bthe\s+(of|that|is)\b", r"\bles\s*:", r"—\s*the", r"der[^.]{0,30}von"),
    "name": "ouier",
    "slug": "^4",
    "title_pattern": "Document [0-9]*7",
    "host": "^https?://corpus\\.example\\.org/news/",
}
_ATTRIBUTED = " OR ".join(f"regexp_matches(full_text, '{p}')" for p in SPEECH["patterns"])
_MENTIONS = "len(regexp_extract_all(full_text, 'ouier'))"


@query(
    "speaker_tags",
    f"""-- uses: tcorpus
    SELECT id, CASE WHEN source <> 'src7' THEN NULL
        WHEN regexp_matches(regexp_replace(url, '^https?://corpus\\.example\\.org/news/', ''), '(?i)^4')
            OR {_ATTRIBUTED} OR (regexp_matches(title, '(?i)Document [0-9]*7') AND {_MENTIONS} >= 3)
            OR {_MENTIONS} >= 5 THEN 'poroshenko' ELSE 'none' END AS speaker_attribution
    FROM (SELECT *, title || ' ' || body_text AS full_text FROM tcorpus)""",
)
def speaker_tags(spark, sf):
    return ingest.tag_speakers(study_corpus(spark, sf), "src7", **SPEECH).select(
        "id", "speaker_attribution"
    )


# --- dates -------------------------------------------------------------------

_UK = list(fixed.MONTHS_UK)
_UK_CASE = " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(_UK))
_UK_MONTH = "CASE {} " + " ".join(f"WHEN '{m}' THEN '{n}'" for m, n in fixed.MONTHS_UK.items()) + " END"
_RU_MONTH = "CASE {} " + " ".join(f"WHEN '{m}' THEN '{n}'" for m, n in fixed.MONTHS_RU.items()) + " END"
_UK_ALT = "|".join(fixed.MONTHS_UK)
_RU_ALT = "|".join(fixed.MONTHS_RU)


def _event_dates(spark, sf):
    """The day of every event, written in one of nine ways."""
    ts = F.col("ts")
    day, month, year = (F.date_format(ts, p) for p in ("dd", "MM", "yyyy"))
    named = F.element_at(F.array(*[F.lit(m) for m in _UK]), F.month(ts))
    space = F.lit(" ")
    forms = [
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.concat(F.lit(" "), day, F.lit("."), month, F.lit("."), year),
        F.concat(day, F.lit("."), month, F.lit("."), year, F.lit(" 10:15")),
        F.concat(F.day(ts).cast("string"), space, named, space, year, F.lit(" року")),
        F.concat(named, space, year),
        F.concat(day, F.lit(". "), month, F.lit(". "), year),
        F.concat(F.lit("Event of "), day, space, F.upper(named), space, year),
        F.concat(F.lit("no date "), year),
        F.concat(day, F.lit("/"), month, F.lit("/"), year),
    ]
    kind = F.col("event_id") % len(forms)
    text = None
    for i, form in enumerate(forms):
        text = F.when(kind == i, form) if text is None else text.when(kind == i, form)
    return table(spark, sf, "events").select("event_id", text.alias("t"))


_EVENT_DATES = f"""(SELECT event_id, CASE event_id % 9
        WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
        WHEN 1 THEN ' ' || strftime(ts, '%d.%m.%Y')
        WHEN 2 THEN strftime(ts, '%d.%m.%Y') || ' 10:15'
        WHEN 3 THEN day(ts) || ' ' || m || ' ' || year(ts) || ' року'
        WHEN 4 THEN m || ' ' || year(ts)
        WHEN 5 THEN strftime(ts, '%d. %m. %Y')
        WHEN 6 THEN 'Event of ' || strftime(ts, '%d') || ' ' || upper(m) || ' ' || year(ts)
        WHEN 7 THEN 'no date ' || year(ts)
        ELSE strftime(ts, '%d/%m/%Y') END AS raw
    FROM (SELECT *, CASE month(ts) {_UK_CASE} END AS m FROM events))"""
_NAMED = f"""CASE WHEN regexp_matches(b, '(\\d{{1,2}})\\s+(\\S+)\\s+(\\d{{4}})')
    THEN regexp_extract(b, '(\\d{{1,2}})\\s+(\\S+)\\s+(\\d{{4}})', 3) || '-' ||
    {_UK_MONTH.format("lower(regexp_extract(b, '(\\d{1,2})\\s+(\\S+)\\s+(\\d{4})', 2))")} || '-' ||
    lpad(regexp_extract(b, '(\\d{{1,2}})\\s+(\\S+)\\s+(\\d{{4}})', 1), 2, '0') END"""
_DOTTED = "substr(t, 7, 4) || '-' || substr(t, 4, 2) || '-' || substr(t, 1, 2)"
_ISO = r"WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}') THEN substr(t, 1, 10)"


@query(
    "date_parse",
    f"""SELECT event_id,
        CASE {_ISO} WHEN regexp_full_match(t, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN {_DOTTED}
            ELSE {_NAMED.replace('(b,', '(t,')} END AS strict,
        CASE {_ISO} WHEN regexp_matches(t, '^\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN {_DOTTED}
            ELSE {_NAMED} END AS prefix,
        CASE {_ISO} WHEN regexp_matches(t, '^\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN {_DOTTED}
            ELSE coalesce({_NAMED}, regexp_extract(b, '(\\S+)\\s+(\\d{{4}})', 2) || '-' ||
            {_UK_MONTH.format("lower(regexp_extract(b, '(\\S+)\\s+(\\d{4})', 1))")} || '-01') END AS article,
        CASE {_ISO} WHEN regexp_matches(t, '^\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN {_DOTTED}
            WHEN regexp_matches(t, '\\d{{2}}\\.\\s*\\d{{2}}\\.\\s*\\d{{4}}')
            THEN replace(substr(t, 9), ' ', '') || '-' || substr(t, 5, 2) || '-' || substr(t, 1, 2)
            ELSE {_NAMED} END AS session,
        CASE {_ISO} WHEN regexp_matches(t, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN {_DOTTED}
            WHEN regexp_matches(t, '\\d{{1,2}}\\s+({_UK_ALT})\\s+20[1-2]\\d') THEN {_NAMED} END AS browser,
        CASE WHEN regexp_full_match(t, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN {_DOTTED}
            WHEN regexp_full_match(t, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN {_DOTTED}
            ELSE {_NAMED} END AS scraper
    FROM (SELECT event_id, trim(raw) AS t, regexp_replace(trim(raw), '\\s*(року|р\\.)\\s*$', '') AS b
        FROM {_EVENT_DATES})""",
)
def date_parse(spark, sf):
    rows = _event_dates(spark, sf)
    return rows.select(
        "event_id", *[dates.parse_date(F.col("t"), v).alias(v) for v in dates.VARIANTS]
    )


def _dated_texts(spark, sf):
    """Documents that open or close with a date, in several spellings."""
    n = F.col("doc_id")
    ru = F.array(*[F.lit(m) for m in fixed.MONTHS_RU])
    uk = F.array(*[F.lit(m) for m in fixed.MONTHS_UK])
    month = (n % 12 + 1).cast("int")
    year = (2012 + n % 18).cast("string")
    day = (n % 28 + 1).cast("string")
    two = F.lpad(day, 2, "0")
    spelled = (
        F.when(n % 5 == 0, F.concat_ws(" ", day, F.element_at(uk, month), year))
        .when(n % 5 == 1, F.concat_ws(" ", day, F.element_at(ru, month), year))
        .when(n % 5 == 2, F.concat_ws(".", two, F.lpad(month.cast("string"), 2, "0"), year))
        .when(n % 5 == 3, F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), two))
        .otherwise(F.lit("undated"))
    )
    text = F.when(n % 3 == 0, F.concat_ws(" ", spelled, "text")).otherwise(
        F.concat_ws(" ", "text", spelled)
    )
    return texts(spark, sf).select(
        "doc_id", text.alias("body_text"), spelled.alias("spelled"), "source"
    )


_DATED_TEXTS = f"""(SELECT doc_id, source, spelled, CASE WHEN doc_id % 3 = 0 THEN spelled || ' ' || text
        ELSE text || ' ' || spelled END AS body
    FROM (SELECT *, CASE doc_id % 5
        WHEN 0 THEN d || ' ' || [{', '.join(f"'{m}'" for m in fixed.MONTHS_UK)}][m] || ' ' || y
        WHEN 1 THEN d || ' ' || [{', '.join(f"'{m}'" for m in fixed.MONTHS_RU)}][m] || ' ' || y
        WHEN 2 THEN lpad(d, 2, '0') || '.' || lpad(m::VARCHAR, 2, '0') || '.' || y
        WHEN 3 THEN y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d, 2, '0')
        ELSE 'undated' END AS spelled
    FROM (SELECT *, CAST(doc_id % 28 + 1 AS VARCHAR) AS d, CAST(doc_id % 12 + 1 AS INTEGER) AS m,
        CAST(2012 + doc_id % 18 AS VARCHAR) AS y FROM documents)))"""


def _sql_named(column: str, alternatives: str, month: str, years: str) -> str:
    pattern = f"(\\d{{1,2}})\\s+({alternatives})\\s+({years})"
    return f"""CASE WHEN regexp_matches({column}, '{pattern}') THEN regexp_extract({column}, '{pattern}', 3)
        || '-' || {month.format(f"regexp_extract({column}, '{pattern}', 2)")} || '-' ||
        lpad(regexp_extract({column}, '{pattern}', 1), 2, '0') END"""


def _sql_rebuilt(column: str, pattern: str, order: tuple[int, int, int]) -> str:
    y, m, d = (f"regexp_extract({column}, '{pattern}', {g})" for g in order)
    return f"CASE WHEN regexp_matches({column}, '{pattern}') THEN {y} || '-' || {m} || '-' || {d} END"


_IN_TEXT = f"""CASE WHEN length({{0}}) >= 20 THEN coalesce(
    {_sql_named('{0}', _UK_ALT, _UK_MONTH, '20[0-2]' + chr(92) + 'd')},
    {_sql_named('{0}', _RU_ALT, _RU_MONTH, '20[0-2]' + chr(92) + 'd')},
    {_sql_rebuilt('{0}', '(%d{2})%.(%d{2})%.(20[0-2]%d)'.replace('%', chr(92)), (3, 2, 1))},
    {_sql_rebuilt('{0}', '(20[0-2]%d)-(%d{2})-(%d{2})'.replace('%', chr(92)), (1, 2, 3))}) END"""


def _in_text(column: str) -> str:
    return _IN_TEXT.replace("{0}", column)


def _opening(column: str) -> str:
    named = _sql_named(column, _UK_ALT, _UK_MONTH, r"\d{4}")
    dotted = _sql_rebuilt(column, r"(\d{2})\.(\d{2})\.(\d{4})", (3, 2, 1))
    return f"""coalesce(CASE WHEN substr({named}, 1, 4) BETWEEN '2018' AND '2025' THEN {named} END,
        CASE WHEN substr({dotted}, 1, 4) BETWEEN '2018' AND '2025' THEN {dotted} END)"""


@query(
    "date_extract",
    f"""SELECT doc_id, {_in_text('body')} AS anywhere, {_opening('substr(body, 1, 500)')} AS opening
        FROM {_DATED_TEXTS}""",
)
def date_extract(spark, sf):
    body = F.col("body_text")
    return _dated_texts(spark, sf).select(
        "doc_id",
        dates.date_in_text(body).alias("anywhere"),
        dates.date_in_opening(body).alias("opening"),
    )


@query(
    "first_plausible_date",
    f"""SELECT doc_id, coalesce(
        {_sql_named('body', _UK_ALT, _UK_MONTH, '20(?:0%d|1%d|2[0-5])'.replace('%', chr(92)))},
        {_sql_rebuilt('body', '(%d{2})%.%s*(%d{2})%.%s*(20(?:0%d|1%d|2[0-5]))'.replace('%', chr(92)), (3, 2, 1))})
        AS first_date FROM {_DATED_TEXTS}""",
)
def first_plausible_date(spark, sf):
    return _dated_texts(spark, sf).select(
        "doc_id", dates.first_plausible_date(F.col("body_text")).alias("first_date")
    )


_MAPPED = "CASE WHEN doc_id % 4 = 0 THEN lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '.07.' || (2018 + doc_id % 11) END"
_EXPORTED = "CASE doc_id % 3 WHEN 0 THEN (2017 + doc_id % 12) || '-03-04T05:06:07' WHEN 1 THEN 'x' END"


@query(
    "date_resolve",
    f"""SELECT doc_id, coalesce(
            CASE WHEN substr(mapped, 7, 4) NOT BETWEEN '2026' AND '2029'
                THEN substr(mapped, 7, 4) || '-' || substr(mapped, 4, 2) || '-' || substr(mapped, 1, 2) END,
            CASE WHEN length(exported) > 3 AND substr(exported, 1, 4) NOT BETWEEN '2026' AND '2029'
                THEN substr(exported, 1, 10) END,
            {_opening('substr(body, 1, 500)')}) AS resolved
        FROM (SELECT *, {_MAPPED} AS mapped, {_EXPORTED} AS exported FROM {_DATED_TEXTS})""",
)
def date_resolve(spark, sf):
    n = F.col("doc_id")
    mapped = F.when(
        n % 4 == 0,
        F.concat(F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(".07."), (2018 + n % 11).cast("string")),
    )
    exported = F.when(
        n % 3 == 0, F.concat((2017 + n % 12).cast("string"), F.lit("-03-04T05:06:07"))
    ).when(n % 3 == 1, "x")
    return _dated_texts(spark, sf).select(
        "doc_id", dates.resolve_date(exported, mapped, F.col("body_text")).alias("resolved")
    )


@query(
    "date_backfill",
    f"""SELECT doc_id, coalesce(CASE WHEN found IS NOT NULL THEN found END, date) AS date,
        CASE WHEN found IS NOT NULL THEN 'extracted_from_body' END AS date_source
        FROM (SELECT doc_id, date, CASE WHEN source < 'src5' AND coalesce(length(date), 0) < 10 THEN
            {_in_text("('T ' || substr(body, 1, 2000))")} END AS found
        FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '2020-02-02' END AS date FROM {_DATED_TEXTS}))""",
)
def date_backfill(spark, sf):
    """Fill the missing dates of some sources from their texts."""
    rows = _dated_texts(spark, sf).select(
        "doc_id",
        F.lit("T").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, "2020-02-02").alias("date"),
        F.when(F.col("source") < "src5", "risu.ua").otherwise("other").alias("source"),
        "body_text",
    )
    return ingest.fill_missing_dates(rows).select("doc_id", "date", "date_source")


@query(
    "year_scope",
    """SELECT event_id, y, y IS NULL OR y IN ('NA', '') OR coalesce(TRY_CAST(y AS INTEGER) >= 2018, FALSE)
        AS in_scope FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NA' WHEN 1 THEN ''
            WHEN 2 THEN NULL WHEN 3 THEN CAST(2010 + event_id % 20 AS VARCHAR) ELSE 'about' END AS y FROM events)""",
)
def year_scope(spark, sf):
    n = F.col("event_id")
    y = F.when(n % 5 == 0, "NA").when(n % 5 == 1, "").when(
        n % 5 == 3, (2010 + n % 20).cast("string")
    ).when(n % 5 == 4, "about")
    return table(spark, sf, "events").select("event_id", y.alias("y")).withColumn(
        "in_scope", dates.in_year_scope(F.col("y"))
    )


@query(
    "dated_documents",
    """-- uses: tcorpus
    SELECT id, date FROM tcorpus WHERE length(date) >= 10""",
)
def dated_documents(spark, sf):
    return study_corpus(spark, sf).where(dates.has_date(F.col("date"))).select("id", "date")


@query(
    "documents_in_period",
    """-- uses: tcorpus
    SELECT id FROM tcorpus WHERE date IS NULL OR date BETWEEN '2019-01-01' AND '2022-12-31'""",
)
def documents_in_period(spark, sf):
    return ingest.in_period(study_corpus(spark, sf), "2019-01-01", "2022-12-31").select("id")


# --- preparing texts for coders ----------------------------------------------

PREPARATION = {
    "stems": STEMS,
    "curated": ("src1",),
    "line_patterns": (r"^\s*$", r"^(The|Les|Der|La)\s"),
}


def _prepared(spark, sf):
    return ingest.prepared_for_coding(study_corpus(spark, sf), **PREPARATION)


_BREAKS = r"""regexp_replace(regexp_replace({0}, '([.!?\n])\s+([А-ЯІЇЄҐA-Z"])', '\1' || chr(1) || '\2', 'g'),
    '([.!?\n])\s+([А-ЯІЇЄҐA-Z"])', '\1' || chr(1) || '\2', 'g')"""

_MOST_WORDS = int(fixed.MAX_WORDS * 1.5)
_CAP = int(fixed.MAX_BATCH_TOKENS * fixed.OVERSIZE_SHARE)
_CAP_WORDS = int(_CAP / fixed.TOKENS_PER_WORD)

_SECTIONS = f"""
    cleaned AS (SELECT id, title, coalesce(date, 'unknown') AS date, source, content_type,
        trim(regexp_replace(array_to_string(list_filter(string_split(body_text, chr(10)),
            lambda l: NOT (regexp_matches(l, '^\\s*$') OR regexp_matches(l, '^(The|Les|Der|La)\\s'))),
            chr(10)), ' {{2,}}', ' ', 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS text
        FROM tcorpus WHERE length(body_text) >= 100),
    kept AS (SELECT *, regexp_extract_all(text, '\\S+') AS words,
        list_filter(list_transform(string_split({_BREAKS.format('text')}, chr(1)),
            lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: length(x) > 0) AS parts
        FROM (SELECT *, title || ' ' || text AS t FROM cleaned WHERE length(text) >= 100)
        WHERE source = 'src1' OR {_DISTINCT} >= 2 OR {_TOTAL} >= 3),
    lines AS (SELECT id, unnest(parts) AS part, unnest(range(len(parts))) AS i, len(parts) AS n
        FROM kept WHERE len(words) > {fixed.MAX_WORDS}),
    flagged AS (SELECT *, max(CAST({_ANY_STEM.format('part')} AS INTEGER)) OVER (PARTITION BY id ORDER BY i
        ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS keep FROM lines),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run
        FROM flagged WHERE keep = 1),
    sections AS (SELECT id, min(i) AS first, CASE WHEN min(i) > 0 THEN '[...] ' ELSE '' END
        || string_agg(part, ' ' ORDER BY i) || CASE WHEN max(i) < max(n) - 1 THEN ' [...]' ELSE '' END AS s
        FROM runs GROUP BY id, run),
    joined AS (SELECT id, string_agg(s, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY first) AS s
        FROM sections GROUP BY id),
    shortened AS (SELECT k.*, CASE WHEN len(words) <= {fixed.MAX_WORDS} THEN text
        WHEN j.s IS NULL THEN array_to_string(words[1:{fixed.MAX_WORDS}], ' ')
        WHEN len(regexp_extract_all(j.s, '\\S+')) > {_MOST_WORDS}
            THEN array_to_string(regexp_extract_all(j.s, '\\S+')[1:{_MOST_WORDS}], ' ')
                || chr(10) || '[... TRUNCATED ...]'
        ELSE j.s END AS body FROM kept k LEFT JOIN joined j ON k.id = j.id),
    prep AS (SELECT id, title, date, source, content_type, '' AS speaker_attribution, body,
        CAST(len(words) AS INTEGER) AS original_words,
        CAST(len(regexp_extract_all(body, '\\S+')) AS INTEGER) AS truncated_words,
        CAST(trunc(len(regexp_extract_all(body, '\\S+')) * 3.5) AS INTEGER) AS tokens_est FROM shortened)"""


@query(
    "prepared_documents",
    f"""-- uses: tcorpus
    , {_SECTIONS}
    SELECT * FROM prep""",
)
def prepared_documents(spark, sf):
    """Cleaned, topic-filtered and shortened documents."""
    return _prepared(spark, sf)


@query(
    "truncation_totals",
    f"""-- uses: tcorpus
    , {_SECTIONS}
    SELECT count(*) AS n_docs, count(CASE WHEN original_words > truncated_words THEN 1 END) AS n_truncated,
        CAST(sum(original_words) AS BIGINT) AS original_words,
        CAST(sum(truncated_words) AS BIGINT) AS truncated_words,
        CAST(sum(tokens_est) AS BIGINT) AS tokens_est FROM prep""",
)
def truncation_totals(spark, sf):
    return ingest.truncation_totals(_prepared(spark, sf))


def _sized(spark, sf):
    tokens = T.estimate_tokens(F.col("text"))
    return texts(spark, sf).select(
        F.col("doc_id").cast("string").alias("id"),
        F.coalesce(study_date(F.col("doc_id")), F.lit("unknown")).alias("date"),
        tokens.alias("tokens_est"),
        packing.packed_size(tokens).alias("packed_tokens"),
    )


_MARK = "'" + fixed.TRUNCATED_MARK.replace("\n", "' || chr(10) || '") + "'"

# The fold is order-dependent, so the oracle walks the documents one by one.
_FOLDED = r"""
    sums AS (SELECT *, CAST(sum(packed_tokens) OVER (ORDER BY rn) AS BIGINT) AS upto FROM numbered),
    folded AS (SELECT list_reduce(list_prepend({'b': 1::BIGINT, 'f': 0::BIGINT, 'out': []::BIGINT[]},
            list(struct_pack(b := 0::BIGINT, f := packed_tokens, out := []::BIGINT[]) ORDER BY rn)),
            lambda acc, x: CASE WHEN acc.f > 0 AND acc.f + x.f > LIMIT
                THEN {'b': acc.b + 1, 'f': x.f, 'out': list_append(acc.out, acc.b + 1)}
                ELSE {'b': acc.b, 'f': acc.f + x.f, 'out': list_append(acc.out, acc.b)} END) AS r
        FROM sums),
    packed AS (SELECT n.*, (SELECT r.out FROM folded)[n.rn] AS batch FROM numbered n)""".replace("LIMIT", str(fixed.MAX_BATCH_TOKENS))


_PACKED = r"""-- uses: tcorpus
    , sized AS (SELECT id, coalesce(date, 'unknown') AS date,
            CAST(trunc(len(regexp_extract_all(body_text, '\S+')) * 3.5) AS INTEGER) AS tokens_est
        FROM tcorpus),
    numbered AS (SELECT *, CAST(least(tokens_est, CAP) AS BIGINT) AS packed_tokens,
            row_number() OVER (ORDER BY date, id) AS rn FROM sized),""".replace("CAP", str(_CAP)) + _FOLDED


@query("batch_pack", _PACKED + "\n    SELECT id, date, packed_tokens, batch FROM packed")
def batch_pack(spark, sf):
    """Batches filled in date order up to the coders' limit of tokens."""
    rows = _sized(spark, sf).drop("tokens_est")
    return packing.assign_batches(rows, ["date", "id"])


@query(
    "batch_manifest",
    _PACKED
    + """
    SELECT batch, count(*) AS n_docs, CAST(sum(tokens_est) AS DOUBLE) AS est_tokens,
        CAST(sum(packed_tokens) AS BIGINT) AS packed_tokens, string_agg(id, ', ' ORDER BY rn) AS doc_ids
    FROM packed GROUP BY batch""",
)
def batch_manifest(spark, sf):
    rows = _sized(spark, sf)
    batches = packing.assign_batches(rows.drop("tokens_est"), ["date", "id"])
    sizes = rows.select("id", "tokens_est")
    return packing.manifest(batches.join(sizes, "id"), ["date"])


@query(
    "prepared_by_source",
    f"""-- uses: tcorpus
    , {_SECTIONS}
    SELECT source, count(*) AS n_docs, CAST(sum(tokens_est) AS BIGINT) AS tokens_est
    FROM prep WHERE source IN ('src1', 'src2', 'src3') GROUP BY source""",
)
def prepared_by_source(spark, sf):
    rows = ingest.prepared_for_coding(
        study_corpus(spark, sf), sources=["src1", "src2", "src3"], **PREPARATION
    )
    return rows.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("tokens_est").alias("tokens_est")
    )


@query(
    "batch_texts",
    rf"""-- uses: tcorpus
    , {_SECTIONS},
    numbered AS (SELECT *, CAST(least(tokens_est, {_CAP}) AS BIGINT) AS packed_tokens,
            row_number() OVER (ORDER BY date, id) AS rn FROM prep),"""
    + _FOLDED
    + rf"""
    SELECT batch, 'batch_' || CASE WHEN batch < 100 THEN lpad(CAST(batch AS VARCHAR), 2, '0')
            ELSE CAST(batch AS VARCHAR) END || '.txt' AS file,
        'BATCH ' || batch || ' — ' || count(*) || ' documents' || chr(10) || repeat('=', 60) || chr(10) || chr(10)
        || string_agg('=== DOC ' || id || ' | ' || date || ' | ' || source || ' | ' || title || ' ===' || chr(10)
            || CASE WHEN tokens_est > {_CAP}
                THEN array_to_string(regexp_extract_all(body, '\S+')[1:{_CAP_WORDS}], ' ') || {_MARK}
                ELSE body END, chr(10) || chr(10) ORDER BY rn) AS text
    FROM packed GROUP BY batch""",
)
def batch_texts(spark, sf):
    """The text handed to a coder, one per batch; bodies beyond the limit are cut."""
    tokens = F.col("tokens_est")
    rows = _prepared(spark, sf).withColumns(
        {
            "packed_tokens": packing.packed_size(tokens),
            "body": packing.capped_body(F.col("body"), tokens),
        }
    )
    batches = packing.assign_batches(
        rows.select("id", "date", "packed_tokens"), ["date", "id"]
    )
    return packing.rendered_batches(rows.join(batches.select("id", "batch"), "id"), ["date"])


# --- forms of words learned from a table ------------------------------------

# Words of a language that begin with the same six letters stand for the forms of one word,
# the shortest of them.
_READINGS = r"""WITH vocabulary AS (SELECT DISTINCT lang, w, left(w, 6) AS family
        FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents)
        WHERE length(w) >= 7 AND lang IS NOT NULL),
    lexemes AS (SELECT lang, list(w ORDER BY length(w), w)[1] AS word, list(w ORDER BY w) AS forms
        FROM vocabulary GROUP BY lang, family),
    stems AS (SELECT *, list_max(list_filter(range(0, least(length(forms[1]), length(forms[-1])) + 1),
            lambda k: left(forms[1], k) = left(forms[-1], k))) AS letters FROM lexemes),
    paradigms AS (SELECT *, substr(word, letters + 1) AS lemma_ending,
            list_transform(forms, lambda f: substr(f, letters + 1)) AS endings FROM stems),
    each AS (SELECT *, length(form) - letters AS cut FROM (SELECT *, unnest(forms) AS form FROM paradigms)),
    nodes AS (SELECT *, unnest(range(greatest(1, cut), least(8, length(form)) + 1)) AS depth FROM each WHERE cut <= 8),
    counted AS (SELECT lang, lemma_ending, endings, cut, right(form, depth) AS node, count(*) AS n FROM nodes GROUP BY ALL),
    trie AS (FROM (SELECT *, row_number() OVER (PARTITION BY lang, node ORDER BY n DESC, lemma_ending, endings, cut) AS rank
        FROM counted) WHERE rank <= 3),
    asked AS (SELECT DISTINCT 'en' AS lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM benchmark),
    shared AS (SELECT lang, lemma_ending, endings, count(*) AS n FROM paradigms GROUP BY ALL),
    held AS (SELECT a.lang, a.word, s.n, e.word AS lemma, e.forms FROM asked a JOIN each e ON e.lang = a.lang AND e.form = a.word
        JOIN shared s ON s.lang = e.lang AND s.lemma_ending = e.lemma_ending AND s.endings = e.endings),
    lacking AS (SELECT lang, word, unnest(range(1, least(8, length(word) - 1) + 1)) AS depth FROM asked
        WHERE (lang, word) NOT IN (SELECT (lang, form) FROM each)),
    deepest AS (SELECT l.lang, l.word, right(l.word, max(depth)) AS node FROM lacking l
        WHERE EXISTS (FROM trie t WHERE t.lang = l.lang AND t.node = right(l.word, l.depth)) GROUP BY l.lang, l.word),
    readings AS (SELECT lang, word, row_number() OVER (PARTITION BY lang, word ORDER BY lemma <> word, n DESC, lemma) AS rank,
            n, TRUE AS in_table, lemma, forms FROM held
        UNION ALL SELECT d.lang, d.word, rank, n, FALSE, left(d.word, length(d.word) - cut) || lemma_ending,
            list_sort(list_transform(endings, lambda e: left(d.word, length(d.word) - cut) || e))
        FROM deepest d JOIN trie p ON p.lang = d.lang AND p.node = d.node)
    """


def _study_readings(spark, sf):
    def words(name):
        return F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias(name)

    forms = texts(spark, sf).select("lang", words("form")).where(F.length("form") >= 7).distinct()
    family = Window.partitionBy("lang", F.left("form", F.lit(6))).orderBy(F.length("form"), "form")
    known = morphology.lexemes(forms.withColumn("word", F.first("form").over(family)))
    asked = table(spark, sf, "benchmark").select(F.lit("en").alias("lang"), words("word"))
    return asked, morphology.analyses(asked, known, morphology.suffix_trie(known))


@query(
    "word_readings",
    _READINGS
    + """SELECT word, CAST(rank AS INTEGER) AS rank, n, in_table, lemma, array_to_string(forms, ' ') AS forms
    FROM readings WHERE rank <= 3""",
)
def word_readings(spark, sf):
    """Up to three readings of every benchmark word by the forms that the documents hold."""
    _, found = _study_readings(spark, sf)
    return found.select("word", "rank", "n", "in_table", "lemma", F.array_join("forms", " ").alias("forms"))


@query(
    "guessed_lemmas",
    _READINGS
    + r"""SELECT coalesce(lemma, b.word) AS lemma, count(*) AS n
    FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM benchmark) b
    LEFT JOIN readings r ON r.word = b.word AND r.rank = 1 GROUP BY 1""",
)
def guessed_lemmas(spark, sf):
    """Lemmas of the benchmark with their numbers of words."""
    words, found = _study_readings(spark, sf)
    return morphology.lemmas(words, found).groupBy("lemma").agg(F.count("*").alias("n"))


# --- lemmas by sentence -------------------------------------------------------

# The language of a document and an initial capital stand for the tag of its words.
_SENTENCES_OF = r"""(SELECT {0} || ':' || i AS sentence, {1} unnest(ws) AS word, unnest(range(0, len(ws))) AS pos
        FROM (SELECT *, regexp_extract_all(part, '\p{{L}}+') AS ws FROM (SELECT *, unnest(parts) AS part,
            unnest(range(0, len(parts))) AS i FROM (SELECT *, regexp_split_to_array(text, '[.!?\n]+') AS parts FROM {2}))))"""


def _tokens(frame, key, *more):
    """Words of every sentence with their places."""
    parts = frame.select(key, *more, F.posexplode(F.split("text", r"[.!?\n]+")).alias("i", "part"))
    words = F.regexp_extract_all("part", F.lit(r"\p{L}+"), F.lit(0))
    return parts.select(
        F.concat_ws(":", key, "i").alias("sentence"), *more, F.posexplode(words).alias("at", "word")
    )


@query(
    "sentence_lemmas",
    f"""WITH RECURSIVE taught AS (SELECT sentence, pos, lower(word) AS word, lower(left(word, 5)) || '/' || lang AS lemma,
            lang || CASE WHEN left(word, 1) <> lower(left(word, 1)) THEN ' first' ELSE '' END AS tag
        FROM {_SENTENCES_OF.format('doc_id', 'lang,', 'documents')} WHERE lang IS NOT NULL),
    totals AS (SELECT tag, count(*) AS total, row_number() OVER (ORDER BY tag) - 1 AS k FROM taught GROUP BY tag),
    size AS (SELECT count(*) + 1 AS n FROM totals),
    counts AS (SELECT word, lemma, tag, count(*) AS n FROM taught GROUP BY ALL),
    readings AS (SELECT word, lemma, tag, k, CAST(round(-1000 * ln(c.n / (total + size.n))) AS BIGINT) AS cost
        FROM counts c JOIN totals USING (tag), size),
    once AS (SELECT tag, count(*) AS n FROM counts WHERE n = 1 GROUP BY tag),
    unseen AS (SELECT tag, k, CAST(round(-1000 * ln((coalesce(once.n, 0) + 1) / (total + size.n))) AS BIGINT) AS cost
        FROM totals LEFT JOIN once USING (tag), size),
    near AS (SELECT k, lag(k, 1, -1) OVER w AS b, lead(k, 1, -1) OVER w AS a FROM taught JOIN totals USING (tag)
        WINDOW w AS (PARTITION BY sentence ORDER BY pos)),
    pairs AS (SELECT b, k, count(*) AS n FROM (SELECT b, k FROM near UNION ALL SELECT k, -1 FROM near WHERE a = -1) GROUP BY ALL),
    states AS (SELECT k FROM totals UNION ALL SELECT -1),
    square AS (SELECT x.k AS b, y.k, coalesce(pairs.n, 0) + 1 AS n FROM states x CROSS JOIN states y
        LEFT JOIN pairs ON pairs.b = x.k AND pairs.k = y.k),
    moves AS (SELECT b, k, CAST(round(-1000 * ln(n / sum(n) OVER (PARTITION BY b))) AS BIGINT) AS cost FROM square),
    asked AS (FROM {_SENTENCES_OF.format('item_id', '', 'benchmark')}),
    open AS (SELECT sentence, pos, a.word, lemma, tag, k, cost FROM asked a JOIN readings r ON r.word = lower(a.word)
        UNION ALL SELECT sentence, pos, a.word, lower(a.word), tag, k, cost FROM asked a, unseen
        WHERE lower(a.word) NOT IN (SELECT word FROM readings)),
    paths AS (SELECT sentence, pos, o.k, o.cost + m.cost AS cost, [o.k] AS path
            FROM open o JOIN moves m ON m.b = -1 AND m.k = o.k WHERE pos = 0
        UNION ALL SELECT o.sentence, o.pos, o.k, min(p.cost + m.cost) + o.cost,
            arg_min(list_append(p.path, o.k), (p.cost + m.cost) * 1000 + p.k)
        FROM paths p JOIN open o ON o.sentence = p.sentence AND o.pos = p.pos + 1 JOIN moves m ON m.b = p.k AND m.k = o.k
        GROUP BY o.sentence, o.pos, o.k, o.cost),
    lengths AS (SELECT sentence, max(pos) AS pos FROM asked GROUP BY sentence),
    best AS (SELECT sentence, arg_min(path, (p.cost + m.cost) * 1000 + p.k) AS path FROM paths p JOIN lengths USING (sentence, pos)
        JOIN moves m ON m.b = p.k AND m.k = -1 GROUP BY sentence)
    SELECT sentence, CAST(pos AS BIGINT) AS "at", word, lemma, tag FROM best JOIN open USING (sentence) WHERE path[pos + 1] = k""",
)
def sentence_lemmas(spark, sf):
    """Every benchmark word with the reading that its sentence favours."""
    first = F.when(F.left("word", F.lit(1)) != F.lower(F.left("word", F.lit(1))), " first").otherwise("")
    taught = _tokens(texts(spark, sf).where("lang is not null"), "doc_id", "lang").select(
        "sentence", "at", "word",
        F.concat(F.lower(F.left("word", F.lit(5))), F.lit("/"), "lang").alias("lemma"),
        F.concat("lang", first).alias("tag"),
    )
    return tagging.tag(_tokens(table(spark, sf, "benchmark"), "item_id"), tagging.learn(taught))
