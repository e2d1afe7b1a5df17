"""Ordered element selectors per page profile.

Fixed values: the first selector that finds an element wins, so the order is
part of the result.
"""

from __future__ import annotations

_OFFICE_TITLE = ("h1", "h2.entry-title", ".article_header h2", ".headline")
_OFFICE_DATE = ("time", ".date", ".article_date", ".news_date", ".created")
_OFFICE_BODY = (
    ".article_content", ".field-name-body", ".text", ".news_content",
    ".entry-content", "article .content", "#content .field-item",
)

ARTICLE_PROFILES = {
    "office": {
        "title": _OFFICE_TITLE,
        "date": _OFFICE_DATE,
        "body": _OFFICE_BODY,
        "fallback": ("main", "article", "#content"),
    },
    "risu.ua": {
        "title": ("h1", "h1.entry-title", ".article-title", ".news-detail h1", "h2.title"),
        "date": (
            "time", ".date", ".article-date", ".news-date", ".entry-date",
            ".created", "[class*='date']", "span.date", "div.date",
        ),
        "body": (
            ".article-body", ".entry-content", ".news-text", ".article-content",
            ".field-name-body", ".text", ".news-detail-text", "article .content",
            "#content .field-item", ".post-content",
        ),
        "fallback": ("article", "main", "#content"),
    },
    "ppu.gov.ua": {
        "title": ("h1", ".entry-title", "h2.title"),
        "date": ("time", ".date", ".entry-date", "[class*='date']"),
        "body": (".entry-content", ".article-body", ".text", "article .content", "#content"),
        "fallback": ("main",),
    },
    "generic": {
        "title": ("h1", "h2.entry-title", ".article_header h2"),
        "date": ("time", ".date", "[class*='date']"),
        "body": (
            ".article-body", ".entry-content", ".article_content",
            ".field-name-body", ".text", ".news_content", "article .content",
        ),
        "fallback": ("article", "main", "#content"),
    },
    "sbu": {
        "title": ("h1", ".article-title", ".news-title", "h2.title"),
        "date": ("time", ".date", ".article-date", ".news-date", ".created"),
        "body": (
            ".article-body", ".article-content", ".news-body", ".news-content",
            ".field-name-body", ".text", "article .content", "#content .field-item",
        ),
        "fallback": ("main", "article", "#content"),
    },
}

SESSION_BODY = (
    ".WordSection1", ".item_content", ".middle-column", ".stenograma",
    ".steno-text", ".session_text", "#stenograma", ".article_content",
    "article", "#content", "main",
)
SESSION_TITLE = (
    ".item_content h2", ".item_content h1", ".middle-column h2",
    ".middle-column h1", ".WordSection1 h2", ".stenograma h2", ".main_title",
)
SESSION_RECORD = (
    ".stenograma", ".steno-text", ".session_text", "#stenograma",
    ".main-content", ".content-main", "article", "#content", "main",
)
LISTING_ITEMS = (
    "div.item_stat_headline", "div.news_item", "li.item_stat_headline_line",
    "div.col-md-8 div.item", "article", "div.view-content div.views-row",
)
STATEMENT_BODY = (
    ".elementor-widget-theme-post-content .elementor-widget-container",
    ".elementor-widget-theme-post-content", ".entry-content",
    ".elementor-widget-text-editor .elementor-widget-container",
    "article .elementor-section", ".post-content", "article", "main",
)
