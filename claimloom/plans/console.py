"""Plain-text reports over small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from claimloom.settings.lexicons import DESCRIPTIONS

_RULE = "=" * 70


def _rows(df: DataFrame, n: int) -> list[dict]:
    """Report tables have at most a few rows per year, period or code."""
    return [r.asDict() for r in df.limit(n).collect()]


def table_text(title: str, df: DataFrame, n: int = 100) -> str:
    rows = _rows(df, n)
    names = df.columns
    cells = [[("" if r[c] is None else str(r[c])) for c in names] for r in rows]
    widths = [max([len(c), *(len(row[i]) for row in cells)]) for i, c in enumerate(names)]
    line = lambda row: "  ".join(v.ljust(w) for v, w in zip(row, widths)).rstrip()
    return "\n".join([title, line(names), *map(line, cells)])


def summary_text(summary: dict[str, DataFrame]) -> str:
    """The corpus summary as printed after an analysis."""
    overview = _rows(summary["overview"], 1)[0]
    parts = [_RULE, "CORPUS ANALYSIS SUMMARY", _RULE, ""]
    parts += [f"{name.replace('_', ' '):<24}{value:>10}" for name, value in overview.items()]
    parts.append("\nclaims by dimension")
    parts += [
        f"  {DESCRIPTIONS.get(r['category'], r['category']):<55}{r['n']:>8}"
        for r in _rows(summary["claims_by_category"], 50)
    ]
    parts.append("\ntop terms")
    parts += [f"  {r['term']:<40}{r['n']:>8}" for r in _rows(summary["top_terms"], 15)]
    parts += ["", table_text("by year", summary["yearly"])]
    parts += ["", table_text("by period", summary["juncture"])]
    return "\n".join([*parts, _RULE])


def tables_text(built: dict[str, DataFrame]) -> str:
    shown = (
        "category_summary", "intensity_by_juncture", "material_vs_ontological", "cooccurrence",
    )
    return "\n\n".join(table_text(name.replace("_", " "), built[name]) for name in shown)


def claim_text(claim: dict) -> str:
    lines = [
        f"--- Claim #{claim['claim_id']} ---",
        f"Document:  {claim['doc_title']}",
        f"Date:      {claim['doc_date']}",
        f"URL:       {claim['doc_url']}",
        f"Category:  {claim['category']}",
        f"Term:      {claim['matched_term_lemma']} ({claim['matched_term_lang']})",
        f'Surface:   "{claim["matched_surface_form"]}"',
        "",
    ]
    if claim["context_before"]:
        lines.append(f"  [prev] {claim['context_before'][:200]}")
    lines.append(f"  >>> {claim['sentence']}")
    if claim["context_after"]:
        lines.append(f"  [next] {claim['context_after'][:200]}")
    return "\n".join(lines)


def reliability_text(report: DataFrame, n_sample: int) -> str:
    header = f"INTER-CODER RELIABILITY\nSample size: {n_sample} passages"
    return "\n".join([_RULE, header, _RULE, table_text("kappa per variable", report)])
