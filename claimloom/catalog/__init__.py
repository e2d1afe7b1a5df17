"""Every operator as a query on the given tables, with the same in SQL."""

from claimloom.catalog import claims, coding, pages, texts  # noqa: F401
from claimloom.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
