"""Identifiers, addresses and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions.compose import choose
from claimloom.settings import fixed

ARCHIVE_PREFIX = r"^https?://web\.archive\.org/web/\d+/"


def doc_id(url: Column, drop_archive_prefix: bool = False) -> Column:
    """First twelve hexadecimal digits of the MD5 of the address."""
    if drop_archive_prefix:
        url = F.regexp_replace(url, ARCHIVE_PREFIX, "")
    return F.left(F.md5(url.cast("binary")), F.lit(12))


def canonical_host(url: Column) -> Column:
    """One spelling per host, so that both collectors give one identifier."""
    return F.regexp_replace(url, r"^(https?://)rada\.gov\.ua", "$1www.rada.gov.ua")


def absolute_url(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def content_type_of(url: Column) -> Column:
    return F.when(url.rlike("/speeches"), F.lit("speech")).otherwise(F.lit("press_release"))


def source_label(content_type: Column) -> Column:
    return choose(content_type, fixed.SOURCE_LABELS, F.lit("Other"))


def type_label(code: Column) -> Column:
    return choose(code, fixed.TYPE_LABELS, F.lit("Other"))


def kappa_band(kappa: Column) -> Column:
    """Landis and Koch label of a kappa value."""
    case = None
    for floor, label in fixed.KAPPA_BANDS:
        test = kappa >= floor
        case = F.when(test, label) if case is None else case.when(test, label)
    return case.otherwise(F.lit("poor"))


def normalised_source(source: Column) -> Column:
    """Both labels of the security service and both of the other host agree."""
    return choose(source, {"sbu.gov.ua": "ssu.gov.ua", "ppu.ua": "ppu.gov.ua"}, source)


def is_statement_link(href: Column, base: str) -> Column:
    """Article links of the statement site, without its furniture."""
    excluded = F.lit(False)
    for part in fixed.STATEMENT_LINK_EXCLUDED:
        excluded = excluded | href.contains(part)
    return (
        href.startswith(base + "/")
        & ~excluded
        & ~href.isin(base + "/", base + "/news/")
        & href.rlike(fixed.STATEMENT_LINK_ENDING)
    )


def statement_link(href: Column) -> Column:
    return F.regexp_replace(href, "/$", "")


def is_archived_article(url: Column) -> Column:
    """Keep single articles of an archive index, drop its listing pages."""
    return (
        ~url.rlike(fixed.ARCHIVE_LISTING)
        & ~url.rlike(r"\?page=")
        & (F.length(url) > len(fixed.ARCHIVE_SHORTEST))
    )


def is_listing_page(url: Column, path: str) -> Column:
    return url.rlike(path + r"$|" + path + r"/page/\d+$|" + path + r"\?page=\d+$")


def archive_url(timestamp: Column, url: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/"), timestamp, F.lit("/"), url)
