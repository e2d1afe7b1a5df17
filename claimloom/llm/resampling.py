"""Importance resampling of documents towards the distribution of a target collection.

Words and runs of words are hashed into buckets.  A bucket's gain is the logarithm of
its share in the target over its share in the documents; a document's weight is the sum
of its gains, and documents are drawn by weight plus Gumbel noise, which draws without
replacement in proportion to the weights' exponentials.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Scratch, pieces

BUCKETS = 10_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # applied to lower-cased text
ROWS_PER_RANGE = 1_000_000  # ranked rows of one task, beyond the session's number of tasks
_BATCH = 1 << 22
_SLOT_BITS = 33  # monotonically_increasing_id keeps the row number in these bits


def features(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2 ... `longest` words: the bucket of every run, and each text's first run.

    Words become indices of a dictionary.  A run of n words is the pair of its first
    n - 1 words and the index that lies n - 1 places on; distinct pairs form the next
    dictionary, and their checksum continues the shorter run's.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATORS)
    flat = pc.list_flatten(lists)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    filled = pc.greater(pc.binary_length(flat), 0)  # separators at the ends leave empty words
    row = row[filled.to_numpy(zero_copy_only=False)]
    coded = pc.dictionary_encode(pc.filter(flat, filled))
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    crc = np.array([zlib.crc32(w) for w in words], np.int64)
    gram, firsts = word, np.searchsorted(row, np.arange(len(texts) + 1))
    for n in range(1, longest + 1):
        if n > 1:
            whole = row[: len(row) - n + 1] == row[n - 1 :]
            pair = gram[: len(whole)][whole] * max(len(words), 1) + word[n - 1 :][whole]
            places = np.flatnonzero(whole)
            coded = pc.dictionary_encode(pa.array(pair))
            shorter, last = np.divmod(coded.dictionary.to_numpy(), max(len(words), 1))
            crc = np.array([zlib.crc32(b" " + words[b], int(crc[a])) for a, b in zip(shorter.tolist(), last.tolist(), strict=True)], np.int64)
            gram = np.full(len(word), -1, np.int64)
            gram[places] = coded.indices.to_numpy(zero_copy_only=False)
            yield crc[gram[places]] % buckets, np.searchsorted(row[places], np.arange(len(texts) + 1))
        else:
            yield crc[word] % buckets, firsts


def _count(longest: int, buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in pieces(batches, "text", _BATCH):
            for bucket, _ in features(batch.column("text"), longest, buckets):
                seen += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, text: str = "text", *, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all rows; every task sends at most one row a bucket."""
    found = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(_count(longest, buckets), "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        counts[bucket] = n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of each bucket's log ratio, one added to every count."""
    held, wanted = int(raw.sum()) + len(raw), int(target.sum()) + len(target)
    return np.array(
        [math.floor(1000 * math.log(float((t + 1) * held) / float((s + 1) * wanted))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def _weigh(gain: np.ndarray, longest: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", _BATCH):
            number = np.zeros((2, batch.num_rows), np.int64)
            weight = np.zeros(batch.num_rows, np.int64)
            for n, (bucket, first) in enumerate(features(batch.column("text"), longest, len(gain))):
                runs = np.diff(first)
                number[0] += runs
                if n == 0:
                    number[1] = runs
                sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                weight += sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(number[0]), pa.array(number[1]), pa.array(weight)],
                ["doc_id", "n_features", "n_words", "weight"],
            )

    return weigh


def noise(id_text, seed: int):
    """Thousandths of Gumbel noise from the hash of seed and id: the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scratch: Scratch, rows: DataFrame, order: list, total: int) -> DataFrame:
    """Rows with their place `rank`, from 1, in the order; no task sorts more than its range."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / ROWS_PER_RANGE))
    placed = scratch.store(
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", _SLOT_BITS)
    before, offsets = 0, []
    for p, count in sorted(placed.groupBy(part.alias("p")).count().collect()):  # one row a range
        offsets.append((p, before))
        before += count
    starts = spark.createDataFrame(offsets or [(0, 0)], "_part long, _before long")
    within = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("rank", F.col("_before") + within + 1)
        .drop("_part", "_before", "_slot")
    )


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """Weight, score and place of every document: doc_id, n_features, n_words, weight, score, rank.

    `docs` needs doc_id and text, `target` text; other columns are ignored.  Of the N
    documents with `least_words` words and more, floor(percent * N / 100) are drawn, highest
    score first, ties to the smaller doc_id; the others have no rank.  A null text has no
    features and weight 0; a null doc_id takes the noise of an empty id and comes after all
    ids in ties; rows that repeat an id are drawn each for itself, in any order where text
    and id are equal.  Empty tables give no rows, or gains of 0 from an empty target.
    """
    gain = gains(bucket_counts(docs, longest=longest, buckets=buckets), bucket_counts(target, longest=longest, buckets=buckets))
    scratch = Scratch(docs.sparkSession)
    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _weigh(gain, longest), "doc_id long, n_features long, n_words long, weight long"
    )
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    scored = scratch.store(weighed.withColumn("score", F.col("weight") + noise(id_text, seed)).withColumn("_tie", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least_words)
    total = able.count()
    places = ranked(scratch, able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_tie").asc()], total)
    places = places.withColumn("rank", F.when(F.col("rank") <= percent * total // 100, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return places.unionByName(rest).select("doc_id", "n_features", "n_words", "weight", "score", "rank")
