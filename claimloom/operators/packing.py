"""Packing documents, in order, into batches of limited size.

A batch is closed when the next document would exceed the limit, so each
document's batch depends on all documents before it.  What a stretch of documents does
is a *fill map*: for every fill it may be entered with, how many batches it closes and the
fill it leaves.  Fill maps are step functions with at most limit + 1 steps, however many
documents they stand for, and following one by another is a fill map again: an
associative operation.  Documents are cut into ordered ranges; a task folds its range's map
block by block, the maps of ranges are merged as a tree on the workers, and the tree is
walked back down to give every range its true entry.  The ranges are then packed
independently.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.plans.layout import cut_lineage, written
from claimloom.settings import fixed

BLOCK = 4_096  # documents whose fill map is made at once
FANOUT = 32  # fill maps merged by one task of the tree
OPEN = -1  # marks entries with which no batch is closed: the stretch's size is added
Steps = list[tuple[int, int, int]]


def packed_size(tokens: Column, limit: int = fixed.MAX_BATCH_TOKENS) -> Column:
    """Size that counts for packing: oversize documents count as 90 %."""
    cap = int(limit * fixed.OVERSIZE_SHARE)
    return F.least(tokens, F.lit(cap)).cast("bigint")


def capped_body(body: Column, tokens: Column, limit: int = fixed.MAX_BATCH_TOKENS) -> Column:
    cap = limit * fixed.OVERSIZE_SHARE
    kept = F.array_join(F.slice(T.words(body), 1, int(cap / fixed.TOKENS_PER_WORD)), " ")
    return F.when(tokens > cap, F.concat(kept, F.lit(fixed.TRUNCATED_MARK))).otherwise(body)


def fill_map(sizes: list[int], limit: int) -> Steps:
    """``(highest entry fill, batches closed, exit fill)`` of a stretch, ascending.

    Entries that close their first batch at the same document continue alike.  With the
    first step, where it is open, all documents still fit.
    """
    n = len(sizes)
    closed, fill = [0] * (n + 1), [0] * (n + 1)
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    # Packing that opens a batch at document i.
    for i in range(n - 1, -1, -1):
        stop = max(bisect_right(prefix, prefix[i] + limit) - 1, i + 1)
        if stop >= n:
            closed[i], fill[i] = 0, prefix[n] - prefix[i]
        else:
            closed[i], fill[i] = closed[stop] + 1, fill[stop]
    steps: Steps = []
    for stop in range(n + 1):
        # Entered with at most this fill, the first documents still fit.
        highest = limit - prefix[stop]
        if highest < 0:
            break
        if stop == n:
            steps.append((highest, OPEN, prefix[n]))
        elif sizes[stop] > 0:
            steps.append((highest, closed[stop] + 1, fill[stop]))
    return _joined(reversed(steps))


def _joined(steps: Iterable[tuple[int, int, int]]) -> Steps:
    """Ascending steps without those that do what the next one does."""
    out: Steps = []
    for step in steps:
        if out and step[0] <= out[-1][0]:
            continue  # no entry is left for it
        if out and out[-1][1:] == step[1:]:
            out[-1] = step
        else:
            out.append(step)
    return out


def enter(steps: Steps, fill: int) -> tuple[int, int]:
    """Batches closed and exit fill of a stretch entered with ``fill``."""
    lo, hi = 0, len(steps)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if steps[mid][0] < fill else (lo, mid)
    if lo == len(steps):
        raise ValueError("entry fill above the limit")
    _, closed, out = steps[lo]
    return (0, fill + out) if closed == OPEN else (closed, out)


def followed(first: Steps, second: Steps) -> Steps:
    """The fill map of one stretch after another."""
    out: Steps = []
    for highest, closed, fill in first:
        if closed == OPEN:
            # The second is entered with the fill plus the first one's size.
            for top, more, left in second:
                shifted = min(highest, top - fill)
                if shifted >= 0:
                    out.append((shifted, OPEN, fill + left) if more == OPEN else (shifted, more, left))
        else:
            more, left = enter(second, fill)
            out.append((highest, closed + more, left))
    return _joined(out)


_MAP = "node long, highest array<long>, closed array<long>, fill array<long>"
_ENTRY = "node long, batch long, fill long"


def _steps_of(row: pd.Series) -> Steps:
    return [(int(a), int(b), int(c)) for a, b, c in zip(row["highest"], row["closed"], row["fill"])]


def _map_row(node: int, steps: Steps) -> pd.DataFrame:
    highest, closed, fill = (list(c) for c in zip(*steps))
    return pd.DataFrame({"node": [node], "highest": [highest], "closed": [closed], "fill": [fill]})


def _merge(key: tuple, maps: pd.DataFrame) -> pd.DataFrame:
    """The fill map of up to ``FANOUT`` neighbours, in order."""
    steps: Steps | None = None
    for _, row in maps.sort_values("node").iterrows():
        own = _steps_of(row)
        steps = own if steps is None else followed(steps, own)
    return _map_row(int(key[0]), steps)


def _descend(key: tuple, maps: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    """The entries of a node's children, from its own."""
    batch, fill = int(entry["batch"].iloc[0]), int(entry["fill"].iloc[0])
    rows = []
    for _, row in maps.sort_values("node").iterrows():
        rows.append((int(row["node"]), batch, fill))
        closed, fill = enter(_steps_of(row), fill)
        batch += closed
    return pd.DataFrame(rows, columns=["node", "batch", "fill"])


def entries(maps: DataFrame, nodes: int) -> DataFrame:
    """For each of ``maps(node, ...)`` the batch and the fill it is entered with.

    Maps are merged by parent until one parent is left, and entries are handed down the same
    levels; no task sees more than ``FANOUT`` maps, and the driver sees none.
    """
    parent = F.floor(F.col("node") / FANOUT).cast("long").alias("node")
    levels = [maps]
    while nodes > FANOUT:
        levels.append(written(levels[-1].groupBy(parent).applyInPandas(_merge, _MAP)))
        nodes = -(-nodes // FANOUT)
    found = maps.sparkSession.createDataFrame([(0, 1, 0)], _ENTRY)
    for level in reversed(levels):
        found = level.groupBy(parent).cogroup(found.groupBy("node")).applyInPandas(_descend, _ENTRY)
    return found


def assign_batches(
    docs: DataFrame,
    order: list[str],
    size: str = "packed_tokens",
    limit: int = fixed.MAX_BATCH_TOKENS,
    partitions: int | None = None,
) -> DataFrame:
    """Batch numbers, from 1, for ``docs(id, size, order columns)``.

    Give it ids and sizes only; join the texts afterwards.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = list(dict.fromkeys(["id", *order, size]))
    # Finding the ranges reads the rows an extra time; sizes are costly to compute.
    ranged = (
        written(docs.select(*names))
        .repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.spark_partition_id())
    )
    fixed_ranges = cut_lineage(ranged)

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, steps = None, None
        for rows in batches:
            for at in range(0, len(rows), BLOCK):
                own = fill_map([int(s) for s in rows[size].iloc[at : at + BLOCK]], limit)
                node = int(rows["_range"].iloc[0])
                steps = own if steps is None else followed(steps, own)
        if steps is not None:
            yield _map_row(node, steps)

    maps = written(fixed_ranges.select("_range", size).mapInPandas(report, _MAP))
    # One row a range: its number, a batch and a fill.
    entered = {r["node"]: (r["batch"], r["fill"]) for r in entries(maps, n).collect()}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, used = None, 0
        for rows in batches:
            if not len(rows):
                continue
            if number is None:
                number, used = entered[int(rows["_range"].iloc[0])]
            numbers = []
            for s in rows[size]:
                if used and used + int(s) > limit:
                    number, used = number + 1, 0
                used += int(s)
                numbers.append(number)
            yield rows.drop(columns="_range").assign(batch=numbers)

    schema = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema if f.name != "_range"
    )
    return fixed_ranges.mapInPandas(pack, f"{schema}, batch bigint")


def manifest(assigned: DataFrame, order: list[str]) -> DataFrame:
    """Documents, sizes and ids per batch.

    ``est_tokens`` adds up the uncapped sizes, ``packed_tokens`` the capped
    ones.  A batch is bounded by the limit, so are its ids.
    """
    entry = F.struct(*dict.fromkeys([*order, "id"]))
    return assigned.groupBy("batch").agg(
        F.count("*").alias("n_docs"),
        F.sum("tokens_est").cast("double").alias("est_tokens"),
        F.sum("packed_tokens").alias("packed_tokens"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["id"]), ", "
        ).alias("doc_ids"),
    )


def batch_name(number: Column, suffix: str = ".txt") -> Column:
    padded = F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(
        number.cast("string")
    )
    return F.concat(F.lit("batch_"), padded, F.lit(suffix))


def rendered_batches(assigned: DataFrame, order: list[str]) -> DataFrame:
    """One text per batch: a header and its documents in order."""
    speaker = F.when(
        F.col("speaker_attribution") != "",
        F.concat(F.lit(" | speaker: "), F.col("speaker_attribution")),
    ).otherwise(F.lit(""))
    block = F.concat(
        F.lit("=== DOC "), F.col("id"), F.lit(" | "), F.col("date"), F.lit(" | "),
        F.col("source"), speaker, F.lit(" | "), F.col("title"), F.lit(" ===\n"), F.col("body"),
    )
    entry = F.struct(*dict.fromkeys([*order, "id"]), block.alias("block"))
    per_batch = assigned.groupBy("batch").agg(
        F.count("*").alias("n_docs"), F.array_sort(F.collect_list(entry)).alias("_docs")
    )
    header = F.concat(
        F.lit("BATCH "), F.col("batch").cast("string"), F.lit(" — "),
        F.col("n_docs").cast("string"), F.lit(" documents\n" + "=" * 60 + "\n\n"),
    )
    return per_batch.select(
        "batch",
        batch_name(F.col("batch")).alias("file"),
        F.concat(
            header, F.array_join(F.transform("_docs", lambda d: d["block"]), "\n\n")
        ).alias("text"),
    )
