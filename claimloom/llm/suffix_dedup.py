"""Removal of repeated strings across all documents, by counting fingerprints of windows.

This stands in for the suffix-order method: no suffix is sorted, and no previous or
next smaller position or longest-previous-factor value is built.

The longest-previous-factor value of a place says how long a string that starts
there also starts at an earlier place; in suffix order the nearest places before
and after it with a smaller position hold that match.  Removal asks only whether
the value reaches `length`: suffixes that agree in their first `length` bytes would
form one run of that order, and a place has an earlier match when its run holds a
smaller position.  Runs are found by fingerprint, from
coarse to fine, so that single suffixes are listed only where copies begin or end:

1. every window of `length` bytes is filed under its smallest k-gram hash (the
   leftmost one); neighbouring windows with the same k-gram are one stretch;
2. stretches whose k-gram occurs once hold no repeat; equal stretches are runs;
3. the others are cut into cells of windows at fixed distances from the k-gram: a
   cell whose common core occurs once holds no repeat, equal cells are runs;
4. what remains is listed window by window.

Equal windows always have the same k-gram at the same distance, so every step is
exact up to collisions of 128-bit keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Rolling, Scratch, pieces, utf8

LENGTH = 400
CELL = 24
_STEP = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)  # the low bits of a packed hash hold its place
_ID = "doc_id long, row long"
_STRETCH = f"{_ID}, start long, size int, at int, gram long, whole long"
_CELL = f"{_ID}, start long, cell int, first long, size int, gram long, core long, whole long"
_WINDOW = f"{_ID}, place long, gram long, whole long"


def _gram(length: int) -> int:
    return max(8, length // 6)


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _stretches(rolling: Rolling, data: np.ndarray, at: np.ndarray, length: int):
    """Text, first window, windows, place of the k-gram and hashes of every stretch."""
    gram = _gram(length)
    n = len(data) - length + 1
    if n <= 0:
        return None
    sums = rolling.sums(data)
    places = np.arange(len(data) - gram + 1)
    hashes = rolling.ranges(sums, places, places + gram)
    least = _smallest((hashes & ~_PLACE) | places.astype(np.uint64), length - gram + 1)
    limit = np.full(n, -1)  # past the last window of the text that owns a place
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        limit[a : max(a, b - length + 1)] = b - length + 1
    fits = limit >= 0
    cut = fits.copy()
    cut[1:] &= (least[1:] != least[:-1]) | (limit[1:] != limit[:-1])
    begin = np.flatnonzero(cut)
    end = np.minimum(np.append(begin[1:], n), limit[begin])
    place = (least[begin] & _PLACE).astype(np.int64)
    return np.searchsorted(at, begin, side="right") - 1, begin, end - begin, place - begin, hashes[place], rolling.ranges(sums, begin, end + length - 1)


def _find(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in pieces(batches, "text", _STEP):
            data, at = utf8(batch.column("text"))
            if len(data) <= _STEP + _STEP // 2:
                parts = [(0, batch.num_rows, 0, data, 0, len(data))]
            else:
                # A very long text goes in steps that overlap by more than a stretch on
                # both sides; a step gives the stretches that begin in it, each whole.
                parts = [
                    (i, i + 1, max(0, s - length), data[at[i] + max(0, s - length) : min(at[i + 1], at[i] + s + _STEP + 2 * length)], s, s + _STEP)
                    for i in range(batch.num_rows)
                    for s in range(0, max(1, int(at[i + 1] - at[i]) - length + 1), _STEP)
                ]
            for lo, hi, skip, part, least, most in parts:
                own_at = at[lo : hi + 1] - at[lo] if hi - lo > 1 else np.array([0, len(part)])
                found = _stretches(rolling, part, own_at, length)
                if found is None:
                    continue
                inside = (found[1] + skip >= least) & (found[1] + skip < most)
                text, begin, size, place, own, whole = (x[inside] for x in found)
                if not len(text):
                    continue
                rows = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("row").take(rows),
                        pa.array(begin - own_at[:-1][text] + skip),
                        pa.array(size.astype(np.int32)),
                        pa.array(place.astype(np.int32)),
                        pa.array(own.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                    ],
                    ["doc_id", "row", "start", "size", "at", "gram", "whole"],
                )

    return find


def _cut_out(length: int):
    """The text of each wanted stretch, with a cell's width more on both sides."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column("text")
            out: list[list] = [[] for _ in range(8)]
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                text = memoryview(texts[i].as_buffer())
                for w in wanted:
                    lo = max(0, w["start"] - CELL + 1)
                    hi = w["start"] + w["size"] - 1 + length + CELL - 1
                    for k, v in enumerate((i, w["start"], w["size"], w["at"], w["gram"], w["start"] - lo, bytes(text[lo:hi]))):
                        out[k].append(v)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("row").take(rows),
                    pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.int32()),
                    pa.array(out[3], pa.int32()),
                    pa.array(out[4], pa.int64()),
                    pa.array(out[5], pa.int32()),
                    pa.array(out[6], pa.binary()),
                ],
                ["doc_id", "row", "start", "size", "at", "gram", "pad", "text"],
            )

    return cut_out


def _cells(length: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, reach = Rolling(), length - _gram(length)
        for batch in pieces(batches, "text"):
            data, at = utf8(batch.column("text"))
            sums = rolling.sums(data)
            size, place, pad = (batch.column(c).to_numpy() for c in ("size", "at", "pad"))
            low = (reach - place) // CELL  # cells of the first and the last window
            high = (reach - place + size - 1) // CELL
            count = high - low + 1
            rows = np.repeat(np.arange(len(count)), count)
            cell = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + low[rows]
            first = place[rows] - reach + cell * CELL  # of the cell, counted from the stretch's start
            origin = at[:-1][rows] + pad[rows]
            core = rolling.ranges(sums, origin + first + CELL - 1, origin + first + length)
            lo, hi = origin + first, origin + first + CELL - 1 + length
            there = (lo >= at[:-1][rows]) & (hi <= at[1:][rows])
            whole = rolling.ranges(sums, np.where(there, lo, 0), np.where(there, hi, 0))
            begin = np.maximum(first, 0)
            windows = np.minimum(first + CELL, size[rows]) - begin
            at_row = pa.array(rows)
            start = batch.column("start").to_numpy()[rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at_row),
                    batch.column("row").take(at_row),
                    pa.array(start),
                    pa.array(cell.astype(np.int32)),
                    pa.array(start + begin),
                    pa.array(windows.astype(np.int32)),
                    batch.column("gram").take(at_row),
                    pa.array(core.view(np.int64)),
                    pa.array(whole.view(np.int64), mask=~there),
                ],
                ["doc_id", "row", "start", "cell", "first", "size", "gram", "core", "whole"],
            )

    return cells


def _windows(length: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in pieces(batches, "text"):
            data, at = utf8(batch.column("text"))
            sums = rolling.sums(data)
            first, size, start, pad = (batch.column(c).to_numpy() for c in ("first", "size", "start", "pad"))
            rows = np.repeat(np.arange(len(size)), size)
            place = first[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
            lo = at[:-1][rows] + pad[rows] + place - start[rows]
            at_row = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at_row),
                    batch.column("row").take(at_row),
                    pa.array(place),
                    batch.column("gram").take(at_row),
                    pa.array(rolling.ranges(sums, lo, lo + length).view(np.int64)),
                ],
                ["doc_id", "row", "place", "gram", "whole"],
            )

    return windows


def _remover(whole_characters: bool, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, at = utf8(batch.column("text"))
            found: list[tuple] = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                own = data[at[i] : at[i + 1]]
                step = np.zeros(len(own) + 1, np.int32)
                if spans:
                    np.add.at(step, [s["first"] for s in spans], 1)
                    np.add.at(step, [s["last"] for s in spans], -1)
                gone = np.cumsum(step[:-1]) > 0
                if whole_characters and gone.any():  # a character goes with all its bytes or stays
                    lead = np.flatnonzero((own & 0xC0) != 0x80)
                    if len(lead):
                        gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(own))))
                edges = np.diff(gone.astype(np.int8), prepend=0)
                kept = own[~gone].tobytes()
                found.append((len(own), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = list(zip(*found, strict=True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return remove


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    keep_first: bool = True,
    whole_characters: bool = True,
    with_text: bool = True,
) -> DataFrame:
    """Texts without the bytes covered by strings of `length` bytes that occur before.

    Takes `doc_id`, `text`; gives a row per input row: doc_id, row (hash of the
    text), n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept
    (the remaining bytes).  Matches never cross documents, overlaps within one
    count, and all strings are judged on the input.

    `keep_first` spares the copy at the smallest (doc_id, place); without it every
    copy goes.  `whole_characters` leaves a character of which a part would stay.

    Null or empty text: no bytes, nothing removed.  Rows that repeat id and text
    are copies of each other (with `keep_first` they are one place and lose what
    earlier documents hold).  Null ids are allowed and come first.  An empty table
    gives an empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    stretches = scratch.store(docs.mapInArrow(_find(length), _STRETCH))
    shared = _shared(scratch, stretches, ["gram"])
    scratch.keep(shared)
    place = F.struct("doc_id", "row", "start")
    marked = scratch.store(_marked(scratch, shared, ["gram", "whole"], place, keep_first))
    scratch.keep(marked)
    spans = [marked.where("repeat").select("doc_id", "row", F.col("start").alias("first"), (F.col("start") + F.col("size") - 1 + length).alias("last"))]
    wanted = (
        marked.where("open")
        .groupBy("doc_id", "row")
        .agg(F.collect_set(F.struct("start", "size", "at", "gram")).alias("wanted"))
    )
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row"] == b["row"])
    parts = docs.join(wanted, same(docs, wanted)).select(docs["doc_id"], docs["row"], "text", "wanted")
    schema = f"{_ID}, start long, size int, at int, gram long, pad int, text binary"
    parts = scratch.store(parts.mapInArrow(_cut_out(length), schema))
    scratch.keep(marked, parts)
    cells = scratch.store(parts.mapInArrow(_cells(length), _CELL))
    cells = _shared(scratch, cells, ["gram", "cell", "core"])
    place = F.struct("doc_id", "row", "first")
    cells = scratch.store(_marked(scratch, cells, ["gram", "cell", "whole"], place, keep_first))
    scratch.keep(marked, parts, cells)
    spans.append(cells.where("repeat").select("doc_id", "row", "first", (F.col("first") + F.col("size") - 1 + length).alias("last")))
    rest = cells.where("open").select("doc_id", "row", "start", "first", F.col("size"))
    source = parts.select("doc_id", "row", "start", "gram", "pad", "text")
    rest = rest.join(source, same(rest, source) & (rest["start"] == source["start"])).select(
        rest["doc_id"], rest["row"], rest["start"], "first", "size", "gram", "pad", "text"
    )
    windows = scratch.store(rest.mapInArrow(_windows(length), _WINDOW).withColumn("varied", F.lit(False)))
    place = F.struct("doc_id", "row", "place")
    windows = _marked(scratch, windows, ["gram", "whole"], place, keep_first).where("repeat")
    spans.append(windows.select("doc_id", "row", F.col("place").alias("first"), (F.col("place") + length).alias("last")))
    every = spans[0].union(spans[1]).union(spans[2])
    every = every.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    every = scratch.store(every)
    scratch.keep(every)
    whole = docs.join(every, same(docs, every), "left").select(docs["doc_id"], docs["row"], "text", "spans")
    schema = f"{_ID}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return whole.mapInArrow(_remover(whole_characters, with_text), schema)


def _shared(scratch: Scratch, df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs again, and whether its rows are `varied` (not all one string)."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count("whole") < F.count(F.lit(1))).alias("partial"),
        F.min("whole").alias("low"),
        F.max("whole").alias("high"),
    )
    varied = F.coalesce(F.col("partial") | (F.col("low") != F.col("high")), F.lit(True))
    counts = scratch.store(counts.where("n > 1").select(*keys, varied.alias("varied")))
    return scratch.store(df.join(counts, keys).select(*df.columns, "varied"))


def _marked(scratch: Scratch, df: DataFrame, keys: list[str], place, keep_first: bool) -> DataFrame:
    """Rows with `repeat`, whether the string is elsewhere (to keep the first: before), and `open`.

    Open rows are looked at more finely: strings that occur once, and the first
    row of the others, which stands for them where its coarser key is varied.
    """
    counts = df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least"))
    counts = scratch.store(counts.where("n > 1"))
    first = F.coalesce(place == F.col("least"), F.lit(True))
    again = F.col("n").isNotNull()
    return df.join(counts, keys, "left").select(
        *[c for c in df.columns if c != "varied"],
        (again & ~first if keep_first else again).alias("repeat"),
        (F.col("varied") & first).alias("open"),
    )


def without_repeats(docs: DataFrame, length: int, name: str = "text") -> DataFrame:
    """Documents with later copies cut from their text; those left without any go.

    All columns stay; `n_chars` follows the text where the table has it.
    """
    found = remove_repeats(docs, length=length).where("n_removed > 0")
    found = found.select("doc_id", "row", F.col("kept").cast("string").alias("kept")).distinct()
    row = F.xxhash64(F.coalesce(docs[name].cast("binary"), F.lit(b"")))
    both = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (row == found["row"]), "left")
    text = F.coalesce(found["kept"], docs[name])
    columns = [
        text.alias(c) if c == name else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c]
        for c in docs.columns
    ]
    return both.where(found["kept"].isNull() | (found["kept"] != "")).select(*columns)
