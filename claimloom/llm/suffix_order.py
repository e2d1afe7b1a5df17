"""Suffixes in order by prefix doubling, and the places whose longest-previous-factor
value reaches a length.

This is the plain form of the suffix-order method, kept beside `suffix_dedup` to
check and to measure it: every suffix is a row.  Suffixes are ranked by their first
few bytes; a round orders pairs of ranks, a suffix's own and that of the suffix as
far behind it as the rank reaches, and so doubles the bytes that ranks tell apart.
A suffix that is alone with its rank repeats nothing of that length, so it leaves;
the ranks that remain keep their order.

Once ranks reach `length` bytes, suffixes of one rank stand together in suffix
order and share these bytes.  The previous or next smaller position of one of them
lies among them just when they hold a smaller position at all, and only then does
its longest-previous-factor value reach `length`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Scratch, pieces, utf8
from claimloom.plans.layout import number_rows

_FIRST = 7  # bytes of the first rank, nine bits each: 0 stands for the end of the text
_PLACE = ("doc_id", "row", "place")


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        data, at = utf8(batch.column("text"))
        size = np.diff(at)
        rows = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(data)) - at[:-1][rows]
        key = np.zeros(len(data), np.int64)
        for k in range(_FIRST):
            there = place + k < size[rows]
            key = key << 9 | np.where(there, data[np.minimum(np.arange(len(data)) + k, len(data) - 1)].astype(np.int64) + 1, 0)
        own = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(own), batch.column("row").take(own), pa.array(place), pa.array(key)],
            [*_PLACE, "rank"],
        )


def _repeated(scratch: Scratch, df: DataFrame, keys: list[str]) -> DataFrame:
    """Suffixes that share their keys, ranked in the order of these."""
    shared = scratch.store(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    ranks = scratch.store(number_rows(shared, keys, "_rank"))
    return scratch.store(df.join(ranks, keys).select(*_PLACE, F.col("_rank").alias("rank")))


def runs(docs: DataFrame, length: int) -> DataFrame:
    """Suffixes whose first `length` bytes another suffix begins with: doc_id, row,
    place, rank (equal for equal bytes, and in their order).

    Takes `doc_id`, `text` (null: empty).  Rows that repeat id and text count once.
    `length` is at least the seven bytes of the first rank.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).distinct()
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    every = scratch.store(docs.mapInArrow(_suffixes, "doc_id long, row long, place long, rank long"))
    ranked, reach = _repeated(scratch, every, ["rank"]), _FIRST
    while reach < length:
        step = min(reach, length - reach)
        behind = ranked.select(F.col("row").alias("_row"), (F.col("place") - step).alias("_place"), F.col("rank").alias("next"))
        pairs = ranked.join(behind, (F.col("row") == F.col("_row")) & (F.col("place") == F.col("_place"))).drop("_row", "_place")
        ranked, reach = _repeated(scratch, scratch.store(pairs), ["rank", "next"]), reach + step
        scratch.keep(ranked)
    return ranked


def matched_before(docs: DataFrame, length: int) -> DataFrame:
    """Places whose `length` bytes also start at a smaller (doc_id, place)."""
    ranked = runs(docs, length)
    least = ranked.groupBy("rank").agg(F.min(F.struct(*_PLACE)).alias("least"))
    return ranked.join(least, "rank").where(F.struct(*_PLACE) > F.col("least")).select(*_PLACE)
