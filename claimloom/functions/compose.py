"""Small helpers for building nested column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as Python's str.strip() and R's trimws() understand it.
WIDE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NARROW_SPACE = " \t\r\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand the result to ``body``.

    Lambda bodies are evaluated per element, so an expensive outer expression
    used inside one must be bound first.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add expensive columns that later filters use.

    A filter on a plain column moves below it and computes the column again for
    itself; a generator's output is computed once and filtered afterwards.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def strip(text: Column, chars: str = WIDE_SPACE) -> Column:
    return F.btrim(text, F.lit(chars))


def any_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def choose(value: Column, labels: dict, otherwise: Column | None = None) -> Column:
    """Map constants to constants with a CASE, which stays inside codegen."""
    case = None
    for key, label in labels.items():
        test = value == F.lit(key)
        case = F.when(test, F.lit(label)) if case is None else case.when(test, F.lit(label))
    if case is None:
        return otherwise if otherwise is not None else F.lit(None).cast("string")
    return case if otherwise is None else case.otherwise(otherwise)


def escape_literal(text: str) -> str:
    """Quote a literal for a Java regular expression."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&" else c for c in text)
