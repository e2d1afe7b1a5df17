"""Text functions over string columns, all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.compose import (
    NARROW_SPACE,
    any_of,
    escape_literal,
    let,
    strip,
)
from claimloom.settings import fixed

WORD = r"[\p{L}\p{N}_]+"
ANNOTATED_TOKEN = r"[\p{L}\p{N}_]+(?:['’ʼ\-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"


def _split_pattern(abbreviations: Sequence[str], strict: bool) -> str:
    guards = []
    for abbreviation in abbreviations:
        quoted = escape_literal(abbreviation)
        guards.append(f"(?<![\\p{{L}}\\p{{N}}_]){quoted}" if strict else quoted)
    guard = f"(?<!{'|'.join(guards)})" if guards else ""
    # Every break starts at white space; testing that first spares the look-behinds
    # at all other characters.
    return (
        rf"(?U)(?=\s)(?:(?<={fixed.SENTENCE_END}){guard}\s+(?={fixed.SENTENCE_START})"
        r"|\n\s*\n)"
    )


def sentences(
    text: Column,
    abbreviations: Sequence[str] = fixed.ABBREVIATIONS,
    strict_abbreviations: bool = False,
    min_chars: int = fixed.MIN_SENTENCE_CHARS,
) -> Column:
    """Split a text into an array of sentences longer than ``min_chars``.

    A break is white space after closing punctuation and before a capital or an
    opening quote, or a blank line.  No break follows an abbreviation.  By
    default an abbreviation may be the end of a longer word; with
    ``strict_abbreviations`` it must stand alone.
    """
    parts = F.split(text, _split_pattern(abbreviations, strict_abbreviations))
    return F.filter(
        F.transform(parts, lambda part: strip(part)),
        lambda part: F.length(part) > min_chars,
    )


def words(text: Column) -> Column:
    """White-space separated words, without empty edges."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def estimate_tokens(text: Column) -> Column:
    """Rough token estimate, truncated to an integer."""
    return (word_count(text) * F.lit(fixed.TOKENS_PER_WORD)).cast("int")


def tidy_whitespace(text: Column) -> Column:
    """Tabs to spaces, runs of spaces to one, three or more newlines to two."""
    out = F.regexp_replace(text, "\t", " ")
    out = F.regexp_replace(out, " {2,}", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return strip(out)


def clean_body(
    text: Column, line_patterns: Sequence[str] = fixed.NAVIGATION_LINES
) -> Column:
    """Drop page-furniture lines, collapse runs of spaces, trim.

    The first pattern drops every blank line, so paragraphs are not kept.
    """
    furniture = "(?Ud)" + "|".join(f"(?:{p})" for p in line_patterns)
    lines = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(furniture))
    joined = F.regexp_replace(F.array_join(lines, "\n"), " {2,}", " ")
    return F.coalesce(strip(joined, NARROW_SPACE), F.lit(""))


def paragraph_text(paragraphs: Column, longer_than: int) -> Column:
    """Join the paragraphs that are longer than a limit by a blank line."""
    kept = F.filter(
        F.transform(paragraphs, lambda p: strip(p)),
        lambda p: F.length(p) > longer_than,
    )
    return F.array_join(kept, "\n\n")


# --- topic relevance ---------------------------------------------------------


def _one_pass(stems: Sequence[str]) -> list[str]:
    """Stems of which at most one starts at any place and none overlaps itself."""
    chosen: list[str] = []
    for stem in dict.fromkeys(stems):
        overlaps_itself = any(stem.startswith(stem[k:]) for k in range(1, len(stem)))
        clashes = any(o.startswith(stem) or stem.startswith(o) for o in chosen)
        if not overlaps_itself and not clashes:
            chosen.append(stem)
    return chosen


def stem_density(text: Column, stems: Sequence[str] = fixed.RELEVANCE_STEMS) -> Column:
    """``struct(n_distinct, n_total)`` of stem occurrences, case-sensitive.

    A stem listed twice counts twice, both as distinct stem and in the total.
    Stems that cannot hide one another are found in one pass over the text, the
    others one by one.
    """
    weight = {stem: list(stems).count(stem) for stem in dict.fromkeys(stems)}
    together = _one_pass(stems)
    first = "".join(dict.fromkeys(escape_literal(s[0]) for s in together))
    body = "|".join(escape_literal(s) for s in together)
    hits = F.regexp_extract_all(text, F.lit(f"(?=[{first}])(?=({body}))"), F.lit(1))
    apart = [s for s in weight if s not in together]
    counts = [F.regexp_count(text, F.lit(escape_literal(s))) for s in apart]

    def weigh(found: Column) -> Column:
        total = F.size(found)
        for extra in sorted({weight[s] - 1 for s in together} - {0}):
            repeated = [F.lit(s) for s in together if weight[s] - 1 == extra]
            total = total + extra * F.size(F.filter(found, lambda hit: hit.isin(*repeated)))
        return total

    def density(bound: Column) -> Column:
        distinct, total = weigh(F.array_distinct(bound["hits"])), weigh(bound["hits"])
        for i, stem in enumerate(apart):
            n = F.get(bound["counts"], F.lit(i))
            distinct = distinct + F.when(n > 0, weight[stem]).otherwise(0)
            total = total + weight[stem] * n
        return F.struct(distinct.alias("n_distinct"), total.alias("n_total"))

    found = [hits.alias("hits")]
    if apart:
        found.append(F.array(*counts).alias("counts"))
    return let(F.struct(*found), density)


def is_relevant(
    text: Column,
    title: Column | None = None,
    stems: Sequence[str] = fixed.RELEVANCE_STEMS,
    min_distinct: int = fixed.MIN_DISTINCT_STEMS,
    min_total: int = fixed.MIN_TOTAL_STEMS,
) -> Column:
    """Dense enough in topic stems over title and text."""
    title = F.lit("") if title is None else F.coalesce(title, F.lit(""))
    combined = F.concat(title, F.lit(" "), F.coalesce(text, F.lit("")))
    return let(
        stem_density(combined, stems),
        lambda d: (d["n_distinct"] >= min_distinct) | (d["n_total"] >= min_total),
    )


def relevant_sections(
    text: Column,
    stems: Sequence[str] = fixed.RELEVANCE_STEMS,
    max_words: int = fixed.MAX_WORDS,
    context: int = fixed.CONTEXT_SENTENCES,
) -> Column:
    """Shorten a long text to the neighbourhood of its topic sentences.

    Texts up to ``max_words`` come back as they are.  Otherwise each topic
    sentence is kept with ``context`` sentences on both sides, runs of kept
    sentences become sections, and gaps are marked.  A result still longer than
    one and a half times the limit is cut and marked; a text without any topic
    sentence is cut to its first ``max_words`` words.
    """
    any_stem = "|".join(escape_literal(s) for s in dict.fromkeys(stems))
    breaks = r'(?<=[.!?\n])\s+(?=[А-ЯІЇЄҐA-Z"])'
    parts = F.filter(
        F.transform(F.split(text, breaks), lambda s: strip(s, NARROW_SPACE)),
        lambda s: F.length(s) > 0,
    )

    def first_words(array: Column, n: int) -> Column:
        return F.array_join(F.slice(array, 1, n), " ")

    def is_kept(hits: Column, i: Column) -> Column:
        start = F.greatest(i - context, F.lit(0))
        window = F.slice(hits, start + 1, i + context - start + 1)
        return F.exists(window, lambda hit: hit)

    def render(sents: Column, keep: Column, first: Column) -> Column:
        def piece(sentence: Column, i: Column) -> Column:
            before = F.coalesce(F.get(keep, i - 1), F.lit(False))
            after = F.coalesce(F.get(keep, i + 1), F.lit(False))
            opening = F.concat(
                F.when(i + 1 > first, F.lit(fixed.SECTION_JOINER)).otherwise(F.lit("")),
                F.when(i > 0, F.lit(fixed.GAP_MARK + " ")).otherwise(F.lit("")),
            )
            lead = F.when(before, F.lit(" ")).otherwise(opening)
            tail = F.when(
                ~after & (i < F.size(sents) - 1), F.lit(" " + fixed.GAP_MARK)
            ).otherwise(F.lit(""))
            return F.when(F.get(keep, i), F.concat(lead, sentence, tail))

        return F.array_join(F.transform(sents, piece), "")

    def capped(result: Column) -> Column:
        cap = int(max_words * 1.5)
        return F.when(
            word_count(result) > cap,
            F.concat(first_words(words(result), cap), F.lit(fixed.TRUNCATED_MARK)),
        ).otherwise(result)

    def shorten(sents: Column) -> Column:
        return let(
            F.transform(sents, lambda s: s.rlike(any_stem)),
            lambda hits: F.when(
                F.exists(hits, lambda hit: hit),
                let(
                    let(
                        F.transform(hits, lambda _, i: is_kept(hits, i)),
                        lambda keep: let(
                            F.array_position(keep, F.lit(True)),
                            lambda first: render(sents, keep, first),
                        ),
                    ),
                    capped,
                ),
            ).otherwise(first_words(words(text), max_words)),
        )

    return F.when(word_count(text) <= max_words, text).otherwise(
        let(parts, lambda sents: F.when(F.size(sents) == 0, text).otherwise(shorten(sents)))
    )


# --- page diagnosis ----------------------------------------------------------


def is_boilerplate(
    body: Column,
    markers: Sequence[str] = fixed.BOILERPLATE_MARKERS,
    session_markers: Sequence[str] = fixed.SESSION_MARKERS,
) -> Column:
    """Navigation or error page instead of a session record.

    True for a missing or very short text, for three or more navigation
    markers, and for a text below 2,000 characters without any session marker.
    Session markers are literal strings.
    """
    n_markers = sum(
        (F.when(body.rlike("(?iu)" + m), 1).otherwise(0) for m in markers), F.lit(0)
    )
    in_session = any_of(F.contains(body, F.lit(m)) for m in session_markers)
    return F.when(body.isNull() | (F.length(body) < 200), True).otherwise(
        (n_markers >= 3) | (~in_session & (F.length(body) < 2000))
    )


def is_session_page(page: Column) -> Column:
    """Large enough a page, or a middling one that speaks of a session."""
    named = page.rlike("(?iu)стеногр|засідання|stenogr")
    size = F.length(page)
    return F.coalesce((size >= 5000) | ((size >= 1000) & named), F.lit(False))


def is_speech_by(
    url: Column,
    title: Column,
    body: Column,
    patterns: Sequence[str] = fixed.SPEECH_PATTERNS,
    name: str = fixed.SPEAKER_NAME,
    slug: str = fixed.SPEAKER_SLUG,
    title_pattern: str = fixed.SPEAKER_TITLE,
    host: str = r"^https?://risu\.ua/",
) -> Column:
    """Does the article carry direct speech of the tracked speaker?

    True for a matching address, for any attribution pattern, for three
    mentions under a title that names the speaker, or for five mentions.
    """
    url, title, body = (F.coalesce(c, F.lit("")) for c in (url, title, body))
    full = F.concat(title, F.lit(" "), body)
    mentions = F.regexp_count(full, F.lit(escape_literal(name)))
    attributed = full.rlike("|".join(f"(?:{p})" for p in patterns))
    return (
        F.regexp_replace(url, host, "").rlike("(?iu)" + slug)
        | attributed
        | (title.rlike("(?iu)" + title_pattern) & (mentions >= 3))
        | (mentions >= 5)
    )


# --- free-text JSON ----------------------------------------------------------


def strip_code_fence(text: Column) -> Column:
    out = F.regexp_replace(text, r"^\s*```json\s*\n?", "")
    out = F.regexp_replace(out, r"\n?\s*```\s*$", "")
    return strip(out, NARROW_SPACE)


def json_from_text(text: Column, schema: str) -> Column:
    """Parse a JSON object, else the first ``{...}`` inside the text."""
    embedded = F.regexp_extract(text, r"\{[^}]+\}", 0)

    def parsed(source: Column) -> Column:
        looks_whole = strip(source, NARROW_SPACE).rlike(r"(?s)^\{.*\}$")
        return F.when(looks_whole, F.from_json(source, schema, {"mode": "PERMISSIVE"}))

    def complete(value: Column) -> Column:
        return F.when(F.to_json(value) != F.lit("{}"), value)

    return F.coalesce(complete(parsed(text)), complete(parsed(embedded)))


def truthy(value: Column, accepted: Sequence[str] = fixed.TRUTHY) -> Column:
    """Text to boolean; anything not accepted, null included, is false."""
    return F.coalesce(F.lower(value.cast("string")).isin(*accepted), F.lit(False))


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)
