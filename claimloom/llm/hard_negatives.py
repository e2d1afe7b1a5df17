"""Hard negatives by walks over lists that the anchors of a cluster share.

Anchors are clustered by direction.  For a cluster with centre c, whose members lie
within the angle w of c, a candidate v can reach at most |u||v| cos(max(0, angle(v, c) - w))
with a member u.  The candidates sorted by |v| cos(...) are the cluster's list, sorted once
for all members; a member walks it until the bound falls below what it has found, which
certifies that nothing further down can enter.  Lists are cut into parts, so that tasks hold
at most `PART` candidates and `BLOCK` members (in expectation of a hash), and only entries
that some member can still need are sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.common import Scratch

MEMBERS = 512  # anchors a cluster, as long as there are fewer than `CLUSTERS` clusters
CLUSTERS = 256
SAMPLE = 20_000  # anchors that centres are fitted on; all anchors are assigned to them
HEAD = 4_096  # entries at the head of a list that give the first certificates
PART = 16_384
BLOCK = 2_048
_BINS = 256
_STEP = 1_024
_SLACK = 1e-9
_MOST = (1 << 63) - 1

_ROW = "_row long, vec_id long, label long, vector array<double>"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(256 x), shorter vectors filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(256 * flat), -np.finfo(np.float64).max, np.finfo(np.float64).max)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, initial=0.0)
    scale = np.where(largest > 0, largest, 1.0)
    return np.minimum(scale * np.sqrt(np.square(x / scale[:, None]).sum(axis=1)), 1e300)


def directions(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(axis=1, initial=0.0)
    x = x / np.where(largest > 0, largest, 1.0)[:, None]
    size = np.sqrt(np.square(x).sum(axis=1))
    return x / np.where(size > 0, size, 1.0)[:, None]


def products(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; those beyond the range of a long are its ends."""
    most = max(np.abs(u).max(initial=0.0), 1.0) * max(np.abs(v).max(initial=0.0), 1.0) * u.shape[1]
    if most < 2.0**53:
        return (u @ v.T).astype(np.int64)  # every partial sum is a whole number below 2^53
    if most < 2.0**62:
        return u.astype(np.int64) @ v.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in u], object) @ np.array([[int(x) for x in r] for r in v], object).T
    return np.array([[max(-_MOST - 1, min(_MOST, s)) for s in r] for r in exact], np.int64)


def centres_of(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centres are rows spread over the sample."""
    unit = directions(sample)
    centres = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(10):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        filled = np.bincount(nearest, minlength=k) > 0
        centres = np.where(filled[:, None], directions(sums), centres)
    return centres


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions(x) @ centres.T, -1.0, 1.0))


def bounds(x: np.ndarray, centres: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """What a member of length one of each cluster can reach at most with each row."""
    reach = np.cos(np.maximum(0.0, _angles(x, centres) - wide[None, :] - 1e-7))
    return lengths(x)[:, None] * reach


def _assign(centres: np.ndarray, width: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = _angles(matrix(batch.column("vector"), width), centres)
            cluster = angle.argmin(axis=1)
            angle = angle[np.arange(len(cluster)), cluster]
            size = lengths(matrix(batch.column("vector"), width))
            angle[size == 0] = 0.0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cluster, pa.int64()), pa.array(angle), pa.array(size)],
                [*batch.schema.names, "cluster", "angle", "size"],
            )

    return assign


def _histogram(centres: np.ndarray, wide: np.ndarray, width: int, longest: float):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(centres), _BINS), np.int64)
        for batch in batches:
            place = _bin(bounds(matrix(batch.column("vector"), width), centres, wide), longest)
            for c in range(len(centres)):
                seen[c] += np.bincount(place[:, c], minlength=_BINS)
        c, b = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(b), pa.array(seen[c, b])], ["cluster", "bin", "n"])

    return count


def _bin(bound: np.ndarray, longest: float) -> np.ndarray:
    return np.clip((bound / longest + 1) * (_BINS / 2), 0, _BINS - 1).astype(np.int64)


def _entries(centres: np.ndarray, wide: np.ndarray, width: int, above: np.ndarray, below: np.ndarray, parts: np.ndarray, blocks: np.ndarray):
    """Entries of every cluster's list whose bound lies in [above, below), dealt over its parts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = bounds(matrix(batch.column("vector"), width), centres, wide)
            row = batch.column("_row").to_numpy(zero_copy_only=False).astype(np.uint64)
            spread = ((row * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for c in range(len(centres)):
                some = np.flatnonzero((bound[:, c] >= above[c]) & (bound[:, c] < below[c]))
                if not len(some):
                    continue
                taken = batch.take(pa.array(some))
                for block in range(blocks[c]):
                    yield pa.RecordBatch.from_arrays(
                        [
                            *taken.columns,
                            pa.array(np.full(len(some), c)),
                            pa.array(np.full(len(some), block)),
                            pa.array(spread[some] % parts[c]),
                            pa.array(bound[some, c]),
                        ],
                        [*taken.schema.names, "cluster", "block", "part", "bound"],
                    )

    return emit


_FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("_row", pa.int64())])


def _best(pool: list[np.ndarray], k: int, lowest: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The first k of every slot by score, id (nulls last) and row; and the score to reach."""
    slot, score, missing, ident, row = pool
    order = np.lexsort((row, ident, missing, ~score, slot))
    slot = slot[order]
    first = np.searchsorted(slot, slot)
    kept = order[np.arange(len(slot)) - first < k]
    pool = [column[kept] for column in pool]
    full = np.bincount(pool[0], minlength=len(lowest)) >= k
    least = np.full(len(lowest), _MOST, np.int64)
    np.minimum.at(least, pool[0], pool[1])
    return pool, np.where(full, np.maximum(least, lowest), lowest)


def _walk(width: int, k: int, same_label: bool):
    """Members walk one part of their cluster's list.

    A member has slots with a lowest and a highest score (`low`, `high`); each keeps its
    best k.  Low ends rise with what is found; a member whose ends are all above the next
    bound is done, and the walk ends with the last member.
    """

    def walk(entries: pa.Table, members: pa.Table) -> pa.Table:
        if not entries.num_rows or not members.num_rows:
            return _FOUND.empty_table()
        bound = entries.column("bound").to_numpy()
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        v = matrix(entries.column("vector"), width)[order]
        label = entries.column("label").to_numpy()[order]
        row = entries.column("_row").to_numpy()[order]
        ident = entries.column("vec_id")
        missing = pc.is_null(ident).to_numpy()[order]
        ident = pc.fill_null(ident, 0).to_numpy()[order]
        u = matrix(members.column("vector"), width)
        own, own_label = members.column("_row").to_numpy(), members.column("label").to_numpy()
        size = lengths(u)
        low, high = members.column("low").to_pylist(), members.column("high").to_pylist()
        slots = max(map(len, low))
        lows = np.array([[*x, *[_MOST] * (slots - len(x))] for x in low], np.int64)
        highs = np.array([[*x, *[-_MOST - 1] * (slots - len(x))] for x in high], np.int64)
        reach = lows.ravel().copy()
        pool = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)]
        for a in range(0, len(v), _STEP):
            most = bound[a] * size
            needed = reach.reshape(lows.shape).min(axis=1)
            active = np.flatnonzero(most + np.abs(most) * _SLACK + _SLACK >= needed)
            if not len(active):
                break  # no entry from here on can enter any list
            score = products(u[active], v[a : a + _STEP])
            fits = own_label[active][:, None] == label[None, a : a + _STEP]
            if same_label:
                fits &= own[active][:, None] != row[None, a : a + _STEP]
            else:
                fits = ~fits
            fits &= score >= needed[active][:, None]
            m, e = np.nonzero(fits)
            score, m, e = score[m, e], active[m], e + a
            for j in range(slots):
                slot = m * slots + j
                in_band = (score >= reach[slot]) & (score <= highs[m, j])
                some = np.flatnonzero(in_band)
                new = [slot[some], score[some], missing[e[some]], ident[e[some]], row[e[some]]]
                pool = [np.concatenate(pair) for pair in zip(pool, new, strict=True)]
            pool, reach = _best(pool, k, lows.ravel())
        slot, score, missing, ident, row = pool
        return pa.table(
            [pa.array(own[slot // slots]), pa.array(slot % slots), pa.array(score), pa.array(ident, pa.int64(), mask=missing), pa.array(row)],
            schema=_FOUND,
        )

    return walk


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "_row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


class _Lists:
    """The clusters of one run: centres, their widths, and where list entries lie."""

    def __init__(self, scratch: Scratch, rows: DataFrame, anchors: DataFrame, count: int, width: int, longest: float, members: int, part: int, block: int):
        self.rows, self.width, self.longest, self.part = rows, width, longest, part
        spread = F.pmod(F.xxhash64("_row"), F.lit(count)) < SAMPLE
        sample = anchors.where(spread).select("vector").toArrow()
        sample = matrix(sample.column("vector"), width) if sample.num_rows else np.zeros((1, width))
        k = max(1, min(CLUSTERS, math.ceil(count / members), len(sample)))
        self.centres = centres_of(sample, k)
        schema = f"{_ROW}, cluster long, angle double, size double"
        self.members = scratch.store(anchors.mapInArrow(_assign(self.centres, width), schema))
        self.wide, sizes = np.zeros(k), np.zeros(k, np.int64)
        for c, angle, n in self.members.groupBy("cluster").agg(F.max("angle"), F.count(F.lit(1))).collect():  # a row a cluster
            self.wide[c], sizes[c] = angle, n
        self.blocks = np.ceil(sizes / block).astype(np.int64)
        self.bins = np.zeros((k, _BINS), np.int64)
        counted = rows.mapInArrow(_histogram(self.centres, self.wide, width, longest), "cluster long, bin long, n long")
        for c, b, n in counted.groupBy("cluster", "bin").agg(F.sum("n")).collect():  # `CLUSTERS` x `_BINS` rows at most
            self.bins[c, b] = n

    def head(self, most: int) -> np.ndarray:
        """For each cluster the bound above which at least `most` entries lie."""
        from_top = np.cumsum(self.bins[:, ::-1], axis=1)[:, ::-1]
        place = (from_top >= most).sum(axis=1) - 1
        edge = (place / (_BINS / 2) - 1) * self.longest
        return np.where(place <= 0, -np.inf, edge)

    def walked(self, members: DataFrame, above: np.ndarray, below: np.ndarray, k: int, same_label: bool) -> DataFrame:
        """The best of every slot over the entries with a bound in [above, below)."""
        spark = self.rows.sparkSession
        lowest = np.where(np.isfinite(above), _bin(np.where(np.isfinite(above), above, 0.0), self.longest), 0)
        lowest = np.where(above == np.inf, _BINS, lowest)
        entries = np.array([self.bins[c, lowest[c] :].sum() for c in range(len(self.bins))])
        parts = np.maximum(1, np.ceil(entries / self.part)).astype(np.int64)
        dealt = self.rows.mapInArrow(
            _entries(self.centres, self.wide, self.width, above, below, parts, self.blocks),
            f"{_ROW}, cluster long, block long, part long, bound double",
        )
        shape = spark.createDataFrame([(c, int(self.blocks[c]), int(parts[c])) for c in range(len(parts)) if self.blocks[c]], "cluster long, blocks long, parts long")
        replicated = (
            members.join(F.broadcast(shape), "cluster")  # a row a cluster
            .withColumn("block", F.pmod(F.xxhash64("_row"), F.col("blocks")))
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            .select("_row", "label", "vector", "low", "high", "cluster", "block", "part")
        )
        keys = ("cluster", "block", "part")
        found = dealt.groupBy(*keys).cogroup(replicated.groupBy(*keys))
        return found.applyInArrow(_walk(self.width, k, same_label), "anchor long, slot long, score long, vec_id long, _row long")


def _needed(members: DataFrame, k: int) -> np.ndarray:
    """For each cluster the least bound that some member's slots still need."""
    low = F.array_min("low").cast("double")
    ratio = F.when(F.col("low")[0].isNull(), F.lit(None)).when(F.col("size") > 0, low / F.col("size")).when(low <= 0, F.lit(-math.inf))
    out = np.full(k, np.inf)
    for c, least in members.groupBy("cluster").agg(F.min(ratio)).collect():  # a row a cluster
        if least is not None:
            out[c] = least - abs(least) * _SLACK - _SLACK
    return out


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    members: int = MEMBERS,
    head: int = HEAD,
    part: int = PART,
    block: int = BLOCK,
) -> DataFrame:
    """The best negatives of every anchor and positive, by integer inner product.

    `vectors` needs vec_id, label and embedding; other columns are ignored, and `anchors` is a
    condition on its columns.  Rows whose label or vector is null, or with a null or
    non-finite component, take no part.  Components become floor(256 x); a shorter
    vector is filled with zeros; a product beyond the range of a long counts as its end.
    Positives are an anchor's first other rows of its label, negatives the first rows of other
    labels with percent * positive <= 100 * negative <= 100 * positive.  Scores go from high to
    low, ties by smaller vec_id, a null vec_id last.  Rows that repeat an id, or are equal in
    all, count each for itself, as anchors too.  An empty table, or no anchor, gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    vector = F.col("embedding").cast("array<double>")
    plain = vectors.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        vector.alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    ).where("label is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    base = scratch.store(plain)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.floor(256 * x).cast("double") * F.floor(256 * x).cast("double"))
    count, width, longest = base.agg(F.count_if("is_anchor"), F.max(F.size("vector")), F.max(F.sqrt(squares))).first()
    if not count:
        return spark.createDataFrame([], RESULT)
    rows = base.drop("is_anchor")
    longest = min(max(float(longest), 1.0), 1e300) * 1.001
    lists = _Lists(scratch, rows, base.where("is_anchor").drop("is_anchor"), count, max(width, 1), longest, members, part, block)
    k = len(lists.centres)
    least, all_below = F.lit(-_MOST - 1), np.full(k, np.inf)

    def with_ends(table: DataFrame, low: Column, high: Column) -> DataFrame:
        return table.withColumn("low", low).withColumn("high", high)

    # The head of every list gives each member a first certificate, the rest is walked against it.
    cut = lists.head(head)
    start = with_ends(lists.members, F.array(least), F.array(F.lit(_MOST)))
    at_head = scratch.store(lists.walked(start, cut, all_below, positives, True))
    reached = at_head.groupBy(F.col("anchor").alias("_row")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score"), False).alias("scores"))
    # A member meets `positives` scores a part at most, and the head has few parts.
    reached = reached.select("_row", F.when(F.col("n") >= positives, F.col("scores")[positives - 1]).alias("t"))
    certified = scratch.store(with_ends(lists.members.join(reached, "_row", "left"), F.array(F.coalesce("t", least)), F.array(F.lit(_MOST))).drop("t"))
    further = np.minimum(_needed(certified, k), cut)
    below = lists.walked(certified, further, cut, positives, True)
    chosen = scratch.store(_first(at_head.unionByName(below), positives).select("anchor", F.col("place").alias("p_place"), F.col("score").alias("p_score"), F.col("vec_id").alias("positive_id")))

    # Slots of the second walk: one band for each positive of a score not below zero.
    bands = chosen.where("p_score >= 0").groupBy(F.col("anchor").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("p_place", "p_score"))).alias("bands"))
    floor_of = lambda b: (b["p_score"] - F.floor((F.lit(100 - percent).cast("decimal(20,0)") * b["p_score"]) / 100)).cast("long")
    banded = scratch.store(
        with_ends(lists.members.join(bands, "_row"), F.transform("bands", floor_of), F.transform("bands", lambda b: b["p_score"])).drop("bands")
    )
    found = _first(lists.walked(banded, _needed(banded, k), all_below, negatives, False), negatives)
    ids = lists.members.select(F.col("_row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    # Positives of a score below zero come last, so slots and places agree.
    return (
        found.select("anchor", (F.col("slot") + 1).cast("int").alias("p_place"), F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(chosen, ["anchor", "p_place"])
        .join(ids, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", F.col("p_score").alias("positive_score"), "negative_score")
    )


