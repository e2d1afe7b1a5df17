"""Shared pieces: tables in the shared folder, Arrow texts, hashes, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; only a local session may lack it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _LOCAL.get(context.applicationId)
        if named is None:
            named = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="claimloom-llm-")
    return f"{named.rstrip('/')}/llm-{context.applicationId}"


class Scratch:
    """Intermediate tables of one operator in the shared folder.

    A stored table cuts the lineage, survives lost executors, and lets adaptive
    execution split skewed joins, whose sides must come straight from a shuffle.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[tuple[DataFrame, str]] = []

    def store(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((made, path))
        return made

    def keep(self, *tables: DataFrame) -> None:
        """Delete all stored tables but these, and let Spark forget what made them.

        The caller reads only these from now on.
        """
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for made, path in self.tables:
            if not any(made is t for t in tables):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
        self.tables = [(made, path) for made, path in self.tables if any(made is t for t in tables)]
        self.release()

    def release(self) -> None:
        """Let Spark remove the shuffle files of plans that are no longer referenced."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def with_count(scratch: Scratch, df: DataFrame, keys: Sequence[str], *more) -> DataFrame:
    """Rows with the number of rows of their key as `n` (and more aggregates).

    Counts combine before the shuffle and are stored; the join back then has a
    plain shuffle on both sides, so a key with a third of all rows is split.
    """
    counts = scratch.store(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *more).where("n > 1"))
    return df.join(counts, list(keys))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut to about `most` bytes of one text column; rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size, dtype=np.int64) - size) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (null: empty)."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64 over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes of byte ranges, from one running sum."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.symbols = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**61, 2**62)) * 2 + 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            self.up, self.down = powers(self.base, len(data)), powers(self.inverse, len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.symbols[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Smallest id that each linked id reaches: columns `id`, `root`.

    Labels go to neighbours and then to the label's own label, so paths halve in
    each round.  Minima combine before the shuffle; labels are stored each round.
    """
    both = scratch.store(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .union(links.select(F.col("b"), F.col("a")))
        .where("u <> v")
        .distinct()
    )
    labels = scratch.store(both.groupBy(F.col("u").alias("id")).agg(F.min(F.least("u", "v")).alias("root")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("v"), "root"), "v")
            .groupBy(F.col("u").alias("id"))
            .agg(F.min("root").alias("near"))
        )
        step = scratch.store(
            labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        )
        target = step.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = scratch.store(step.join(target, "root", "left").select("id", "old", F.coalesce("next", "root").alias("root")))
        moved = jumped.where("root <> old").limit(1).count()
        labels = jumped.select("id", "root")
        if not moved:
            return labels


def held(column: str, of: int, rest: int):
    """Whether crc32 of an id's text leaves `rest`; a null id belongs to neither side."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of == rest
