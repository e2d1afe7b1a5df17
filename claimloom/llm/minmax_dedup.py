"""Near duplicates by min-max hashing: both extremes of every permutation, in bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Rolling, Scratch, components, mixed, pieces, utf8

PERMUTATIONS = 216
ROWS = 8  # of a band; 2 * 216 / 8 = 54 bands find a pair at 0.8 but for 5 in 100,000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingles(column: pa.Array, words: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of each text, and where each text's begin.

    A text with fewer words gives its whole sequence as one; without words, none.
    """
    data, at = utf8(column)
    data = _LOWER[data]
    solid = ~_SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = at[1:-1][at[1:-1] < len(data)]
    begin[inner] = solid[inner]
    before = at[1:-1][at[1:-1] > 0] - 1
    end[before] = solid[before]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = rolling.ranges(rolling.sums(data), start, stop)
    first = np.searchsorted(start, at)  # of each text's words
    count = np.diff(first)
    mult = [np.uint64(2 * k * k + 0x9E3779B97F4A7C15) for k in range(words)]
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        whole = np.zeros(n, np.uint64)
        for k in range(words):
            whole += hashes[k : k + n] * mult[k]
        whole = mixed(whole)
    else:
        whole = np.empty(0, np.uint64)
    sizes = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    where = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(where[-1], np.uint64)
    long = count >= words
    if len(whole):
        place = np.repeat(first[:-1][long] - where[:-1][long], sizes[long]) + np.flatnonzero(np.repeat(long, sizes))
        out[np.repeat(long, sizes)] = whole[place]
    for i in np.flatnonzero((count > 0) & ~long):
        own = hashes[first[i] : first[i + 1]]
        out[where[i]] = mixed(np.array([sum(int(h) * int(m) for h, m in zip(own, mult, strict=False)) + len(own) & (2**64 - 1)], np.uint64))[0]
    return out, where


def _extremes(values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), 2 * len(a)), np.uint64)
    for k in range(len(a)):
        v = values * a[k] + b[k]
        out[:, 2 * k] = np.minimum.reduceat(v, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(v, starts)
    return out


def _signer(words: int, permutations: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, rng = Rolling(), np.random.default_rng(11)
        a = rng.integers(1, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, permutations, dtype=np.uint64)
        weights = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in pieces(batches, "text", 1 << 19):
            values, where = shingles(batch.column("text"), words, rolling)
            some = np.flatnonzero(np.diff(where))
            size = np.zeros(batch.num_rows, np.int64)
            low, high = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            bands: list = [None] * batch.num_rows
            bits: list = [None] * batch.num_rows
            if len(some):
                signs = _extremes(values, where[some], a, b)
                sketch = np.ascontiguousarray((mixed(signs) >> np.uint64(56)).astype(np.uint8))
                signs = mixed((signs.reshape(len(some), -1, rows) * weights).sum(axis=2, dtype=np.uint64))
                for k, i in enumerate(some):
                    own = np.unique(values[where[i] : where[i + 1]])
                    size[i] = len(own)
                    low[i] = int(own.sum(dtype=np.uint64)) - 2**63
                    high[i] = int(mixed(own ^ weights[0]).sum(dtype=np.uint64)) - 2**63
                    bands[i] = signs[k].view(np.int64)
                    bits[i] = np.resize(sketch[k], -(-len(sketch[k]) // 8) * 8).view(np.int64)
            kept = pa.array(low, mask=size == 0), pa.array(high, mask=size == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), *kept, pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "low", "high", "bands", "bits"],
            )

    return sign


def _most_apart(values: int, similarity: float) -> int:
    """Bits in which sketches of a pair at this similarity differ, but for one pair in 75,000.

    Unequal values, 1 - similarity of all, differ in half of their eight bits.
    """
    unequal = values * (1 - similarity)
    return int(4 * unequal + 4.2 * (16 * unequal * similarity + 2 * unequal) ** 0.5)


def _checker(words: int, percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in pieces(pieces(batches, "text_a"), "text_b"):
            sets = []
            for name in ("text_a", "text_b"):
                values, where = shingles(batch.column(name), words, rolling)
                sets.append([np.unique(values[s:e]) for s, e in zip(where[:-1], where[1:], strict=True)])
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
            good = [100 * n >= percent * (len(x) + len(y) - n) and n > 0 for n, x, y in zip(both, *sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return check


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    permutations: int = PERMUTATIONS,
    rows: int = ROWS,
) -> DataFrame:
    """Groups of documents whose shingle sets have 100 * common >= percent * union.

    Takes `doc_id`, `text`; gives a row per input row: doc_id, n_shingles,
    component_id (smallest doc_id reachable over links), kept.

    Equal sets are one class, so copies are never paired.  A class meets the
    best connected class of each of its buckets first; what the links found so far
    leave in different components of one bucket is then paired where the sketches
    (eight bits of every extreme) are as close as a link's.  Links are confirmed on
    the whole sets.

    Null or empty text: size 0, its own component.  Null id: never linked, its
    component is null.  Rows that repeat an id count as one document.  An empty
    table gives an empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = scratch.store(
        docs.mapInArrow(
            _signer(words, permutations, rows),
            "doc_id long, n_shingles long, low long, high long, bands array<long>, bits array<long>",
        )
    )
    classes = (
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("low", "high", "n_shingles")
        .agg(F.min("doc_id").alias("a"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    )
    classes = scratch.store(classes)
    members = classes.select("a", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "value"))
    members = scratch.store(members)
    sizes = members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = scratch.store(members.join(scratch.store(sizes), ["band", "value"]))
    # The class that meets most others in all its buckets stands for each of them.
    weights = scratch.store(shared.groupBy("a").agg(F.sum("rows").alias("weight")))
    shared = scratch.store(shared.join(weights, "a").select("band", "value", "a", "n", "weight"))
    hubs = shared.groupBy("band", "value").agg(F.max(F.struct("weight", -F.col("a"), "n")).alias("hub"))
    hubs = scratch.store(hubs.select("band", "value", (-F.col("hub.col2")).alias("b"), F.col("hub.n").alias("m")))
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    met = shared.join(hubs, ["band", "value"]).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "n", "m")
    pairs = scratch.store(met.where((F.col("a") != F.col("b")) & fits).select("a", "b").distinct())
    texts = scratch.store(docs.join(shared.select(F.col("a").alias("doc_id")).distinct(), "doc_id"))
    links = scratch.store(_confirmed(pairs, texts, words, percent))
    scratch.keep(signed, classes, shared, pairs, texts, links)
    roots = components(scratch, links)
    placed = scratch.store(
        shared.drop("weight").join(roots.withColumnRenamed("id", "a"), "a", "left")
        .withColumn("root", F.coalesce("root", "a"))
    )
    torn = placed.groupBy("band", "value").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    torn = scratch.store(torn.select("band", "value"))
    sketches = classes.select("a", "bits", "bands")
    rest = scratch.store(placed.join(torn, ["band", "value"]).join(sketches, "a"))
    other = rest.select("band", "value", F.col("a").alias("b"), F.col("n").alias("m"), F.col("root").alias("r"), F.col("bits").alias("bits_b"), F.col("bands").alias("bands_b"))
    words_ = -(-2 * permutations // 8)
    apart = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(1, words_)), F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("bits_b")[0])))
    near = apart <= _most_apart(words_ * 8, percent / 100)
    # A pair is made in the first band it shares.
    first = F.array_position(F.zip_with("bands", "bands_b", lambda x, y: x == y), True) == F.col("band") + 1
    crossing = (
        rest.join(other, ["band", "value"])
        .where((F.col("root") < F.col("r")) & fits & near & first)
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    more = scratch.store(_confirmed(scratch.store(crossing), texts, words, percent))
    links = links.union(more)
    roots = components(scratch, links)
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("a"))
    # Rows of one id with different texts are one document: its classes are linked.
    classes = classes.join(roots.withColumnRenamed("id", "a"), "a", "left").select(
        "low", "high", "n_shingles", F.coalesce("root", "a").alias("component_id")
    )
    classes = scratch.store(classes)
    scratch.keep(signed, classes)
    out = signed.select("doc_id", "n_shingles", "low", "high").join(classes, ["low", "high", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_checker(words, percent), "a long, b long").distinct()


def kept_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of which one of each near-duplicate group stays, all columns as they came.

    Rows that repeat a kept id all stay; rows without an id stay.
    """
    marks = near_duplicates(docs, **settings).where("not kept and doc_id is not null")
    return docs.join(marks.select("doc_id").distinct(), "doc_id", "left_anti")
