"""Date parsing, extraction and resolution over string columns.

Dates stay ISO text in the raw layer, because a source may leave text that is
no date; ``typed_date`` gives the real date where there is one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.compose import NARROW_SPACE, choose, let, strip
from claimloom.settings import fixed

VARIANTS = ("strict", "prefix", "article", "session", "browser", "scraper")

_DAY_MONTH_YEAR = r"(?U)(\d{1,2})\s+(\S+)\s+(\d{4})"


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), month, F.lit("-"), day)


def _first_match(text: Column, pattern: str, build) -> Column:
    """Search once; ``build`` takes the groups from the short matched text."""
    return let(
        F.regexp_extract(text, pattern, 0),
        lambda found: F.when(found != "", build(lambda g: F.regexp_extract(found, pattern, g))),
    )


def _named_month(text: Column, pattern: str, months: Mapping[str, str]) -> Column:
    """ISO date from the first ``day month year`` match, null otherwise."""
    return _first_match(
        text,
        pattern,
        lambda group: _iso(
            group(3), choose(F.lower(group(2)), dict(months)), F.lpad(group(1), 2, "0")
        ),
    )


def _rebuild(text: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    """ISO date from the groups of the first match, null without a match."""
    return _first_match(text, pattern, lambda group: _iso(*(group(g) for g in order)))


def parse_date(text: Column, variant: str = "prefix") -> Column:
    """Parse one date text to ISO, null if it is none.

    strict   ISO, a whole ``dd.mm.yyyy``, or ``d month yyyy``
    prefix   as strict, but the dotted date may be followed by a time
    article  as prefix, and ``month yyyy`` means the first of the month
    session  as prefix, and dotted dates may hold spaces
    browser  a dotted or named date anywhere in the text
    scraper  numeric and English or Ukrainian named dates, checked for validity
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown date variant {variant!r}")
    if variant == "scraper":
        return _parse_scraped(text)
    t = strip(text, NARROW_SPACE)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10))
    if variant == "browser":
        months = "|".join(fixed.MONTHS_UK)
        named = rf"(\d{{1,2}})\s+({months})\s+(20[1-2]\d)"
        return F.coalesce(
            iso,
            _rebuild(t, r"(\d{2})\.(\d{2})\.(\d{4})", (3, 2, 1)),
            _named_month(t, named, fixed.MONTHS_UK),
        )

    if variant == "strict":
        dotted = _rebuild(t, r"^(\d{2})\.(\d{2})\.(\d{4})\z", (3, 2, 1))
        return F.coalesce(iso, dotted, _named_month(t, _DAY_MONTH_YEAR, fixed.MONTHS_UK))

    # The year is whatever stands between the second dot and the next dot or
    # blank, so a text glued to the year stays glued.
    dotted = F.when(
        t.rlike(r"^\d{2}\.\d{2}\.\d{4}"),
        _rebuild(t, r"^(\d{2})\.(\d{2})\.([^.\s]*)", (3, 2, 1)),
    )
    branches = [iso, dotted]
    if variant == "session":
        squeezed = F.split(F.regexp_replace(t, r"\s", ""), r"\.")
        branches.append(
            F.when(
                t.rlike(r"\d{2}\.\s*\d{2}\.\s*\d{4}"),
                _iso(F.get(squeezed, F.lit(2)), F.get(squeezed, F.lit(1)), F.get(squeezed, F.lit(0))),
            )
        )
    year_word = r"\s*(року|р\.)\s*$" if variant == "article" else r"\s*(року|р\.?)\s*$"
    bare = F.regexp_replace(t, year_word, "")
    branches.append(_named_month(bare, _DAY_MONTH_YEAR, fixed.MONTHS_UK))
    if variant == "article":
        month_first = r"(?U)(\S+)\s+(\d{4})"
        month = choose(F.lower(F.regexp_extract(bare, month_first, 1)), fixed.MONTHS_UK)
        branches.append(_iso(F.regexp_extract(bare, month_first, 2), month, F.lit("01")))
    return F.coalesce(*branches)


def _parse_scraped(text: Column) -> Column:
    t = strip(text)
    formats = (
        (r"^\d{1,2}\s+\p{L}+\s+\d{4}\s+року$", "d MMMM yyyy 'року'"),
        (r"^\d{1,2}\s+\p{L}+\s+\d{4}$", "d MMMM yyyy"),
        (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    )
    single_spaced = F.regexp_replace(t, r"\s+", " ")
    known = [
        F.when(t.rlike(shape), F.date_format(F.try_to_date(single_spaced, pattern), "yyyy-MM-dd"))
        for shape, pattern in formats
    ]
    named = r"(?U)(\d{1,2})\s+(\w+)\s+(\d{4})"
    return F.coalesce(*known, _named_month(t, named, fixed.MONTHS_UK))


def date_in_opening(text: Column, chars: int = 500) -> Column:
    """A date in the first characters of a text, for the years in scope."""
    opening = F.substring(text, 1, chars)
    months = "|".join(fixed.MONTHS_UK)
    named = rf"(\d{{1,2}})\s+({months})\s+(\d{{4}})"
    dotted = r"(\d{2})\.(\d{2})\.(\d{4})"

    def in_scope(date: Column) -> Column:
        return let(date, lambda d: F.when(F.substring(d, 1, 4).between("2018", "2025"), d))

    return F.coalesce(
        in_scope(_named_month(opening, named, fixed.MONTHS_UK)),
        in_scope(_rebuild(opening, dotted, (3, 2, 1))),
    )


def date_in_text(text: Column) -> Column:
    """First Ukrainian, else Russian, else dotted, else ISO date of 2000-2029."""
    uk = rf"(\d{{1,2}})\s+({'|'.join(fixed.MONTHS_UK)})\s+(20[0-2]\d)"
    ru = rf"(\d{{1,2}})\s+({'|'.join(fixed.MONTHS_RU)})\s+(20[0-2]\d)"
    return F.when(
        F.length(text) >= 20,
        F.coalesce(
            _named_month(text, uk, fixed.MONTHS_UK),
            _named_month(text, ru, fixed.MONTHS_RU),
            _rebuild(text, r"(\d{2})\.(\d{2})\.(20[0-2]\d)", (3, 2, 1)),
            _rebuild(text, r"(20[0-2]\d)-(\d{2})-(\d{2})", (1, 2, 3)),
        ),
    )


def first_plausible_date(text: Column) -> Column:
    """First named, else first dotted date whose year is within 2000-2025."""
    months = "|".join(fixed.MONTHS_UK)
    named = rf"(\d{{1,2}})\s+({months})\s+(\d{{4}})"
    dotted = r"(\d{2})\.\s*(\d{2})\.\s*(\d{4})"

    def first_match(pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.get(
            F.filter(found, lambda m: F.regexp_extract(m, r"(\d{4})$", 1).between("2000", "2025")),
            F.lit(0),
        )

    return F.coalesce(
        _named_month(first_match(named), named, fixed.MONTHS_UK),
        _rebuild(first_match(dotted), dotted, (3, 2, 1)),
    )


def _not_ahead(date: Column) -> Column:
    """Reject dates from 2026 to 2029, which come from page headers."""
    return F.when(~date.rlike("^202[6-9]"), date)


def page_date(parts: Column) -> Column:
    """Date of a page from ``page_parts``: publication field, dated element, time
    element, info line, then the text."""

    def given(value: Column) -> Column:
        return F.when(value != "", value)

    published = F.try_element_at(parts["meta"], F.lit("article:published_time"))
    return F.coalesce(
        given(F.substring(published, 1, 10)),
        parse_date(parts["item_date"], "browser"),
        given(F.substring(parts["time"], 1, 10)),
        parse_date(parts["info"], "browser"),
        parse_date(parts["text"], "browser"),
    )


def date_beside_link(title: Column, around: Column) -> Column:
    """Date of a link from its text and the text around it."""
    both = F.concat(title, F.lit(" "), around)
    return F.coalesce(
        parse_date(both, "strict"), _rebuild(both, r"(\d{2})\.(\d{2})\.(\d{4})", (3, 2, 1))
    )


def resolve_date(json_date: Column, map_date: Column, body: Column) -> Column:
    """Best date: mapping, then the exported field, then the opening of the text."""

    def usable(raw: Column) -> Column:
        return F.when(F.length(raw) > 3, _not_ahead(parse_date(raw, "article")))

    return F.coalesce(usable(map_date), usable(json_date), date_in_opening(body))


def has_date(date: Column) -> Column:
    return F.coalesce(F.length(date) >= 10, F.lit(False))


def unix_date(seconds: Column) -> Column:
    """ISO date of a unix time given as text, null if it is no plausible time."""
    value = F.regexp_extract(seconds, r"^\s*(\d+)", 1).try_cast("bigint")
    day = F.date_add(F.lit("1970-01-01").cast("date"), (value / 86400).cast("int"))
    return F.when(value > 1000000000, F.date_format(day, "yyyy-MM-dd"))


def typed_date(date: Column) -> Column:
    return F.try_to_date(date, "yyyy-MM-dd")


def year_of(date: Column, missing: str | None = None) -> Column:
    """First four characters, or ``missing`` for a null or shorter text."""
    other = F.lit(missing).cast("string")
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4)).otherwise(other)


def juncture_of(
    date: Column,
    junctures: Mapping[str, tuple[str, str]] = fixed.JUNCTURES,
    missing: str | None = None,
    outside: str | None = None,
) -> Column:
    """Name of the closed period holding the date.

    A handful of constant, disjoint periods is a CASE: a range join would plan
    as a nested loop.
    """
    case = F.when(
        date.isNull() | date.isin("", "unknown"), F.lit(missing).cast("string")
    )
    for name, (start, end) in junctures.items():
        case = case.when(date.between(start, end), F.lit(name))
    return case.otherwise(F.lit(outside).cast("string"))


def in_year_scope(year: Column, year_min: int = 2018) -> Column:
    """Undated rows stay; dated rows must be of the first year or later."""
    return (
        year.isNull()
        | year.isin("NA", "")
        | F.coalesce(year.try_cast("int") >= year_min, F.lit(False))
    )
