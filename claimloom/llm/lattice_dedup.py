"""Near-duplicate vectors by E8 lattice hashing with probing of neighbouring cells."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Scratch, components, mixed

TABLES = 8
PROBES = 2
WIDTH = 1.8  # of a cell, against unit vectors projected to eight dimensions
BLOCK = 512  # vectors of a cell compared with as many others in one go


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: steps to the neighbouring cells."""
    pairs = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            pairs.append(v)
    signs = [np.array(s) / 2 for s in itertools.product((-1, 1), repeat=8) if np.prod(s) > 0]
    return np.array(pairs + signs)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of each row."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def codes(unit: np.ndarray, tables: int, probes: int, width: float) -> np.ndarray:
    """Cell numbers, tables x (own cell, then the nearest others), of each unit vector."""
    n, dim = unit.shape
    out = np.empty((n, tables, 1 + probes), np.int32)
    roots = _roots()
    rng = np.random.default_rng(dim)
    weights = rng.integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for t in range(tables):
        x = unit @ rng.normal(size=(dim, 8)) / width
        own = decode(x)
        # |x - own - root|^2 but for what all roots share: every root has length 2.
        order = np.argsort(-(x - own) @ roots.T, axis=1, kind="stable")[:, :probes]
        cells = np.concatenate([own[:, None], own[:, None] + roots[order]], axis=1)
        key = (2 * cells).astype(np.int64).view(np.uint64)
        hashed = mixed((key * weights).sum(axis=2, dtype=np.uint64) + np.uint64(t * 1_000_003 + dim))
        out[:, t] = (hashed >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _filer(tables: int, probes: int, width: float):
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            for dim in sorted({len(v) for v in vectors}):
                rows = np.array([i for i, v in enumerate(vectors) if len(v) == dim])
                for part in np.array_split(rows, -(-len(rows) // 1024)):
                    own = np.array([vectors[i] for i in part])
                    unit = own / np.abs(own).max(axis=1)[:, None]
                    unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
                    code = codes(unit, tables, probes, width)
                    at = pa.array(np.repeat(part, tables * (1 + probes)))
                    data = pa.array([v.tobytes() for v in unit], pa.binary())
                    every = pa.array([c.tobytes() for c in code], pa.binary())
                    local = pa.array(np.repeat(np.arange(len(part)), tables * (1 + probes)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("a").take(at),
                            batch.column("copies").take(at),
                            pa.array(np.full(len(at), dim, np.int32)),
                            pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), len(part))),
                            pa.array(code.reshape(-1)),
                            data.take(local),
                            every.take(local),
                        ],
                        ["a", "copies", "dim", "layer", "cell", "unit", "codes"],
                    )

    return file


def _met_before(x: np.ndarray, y: np.ndarray, layer: int, cell: int) -> np.ndarray:
    """Whether pairs of code arrays meet in an earlier table, or also in a smaller cell of this one."""
    hit = (x[:, :, :1] == y).any(axis=2) | (x == y[:, :, :1]).any(axis=2)
    before = hit[:, :layer].any(axis=1)
    own, other = x[:, layer], y[:, layer]
    # Cells of this table in which the pair meets with one of the two at home.
    for home, there in ((own[:, :1], other), (other[:, :1], own)):
        before |= ((there == home) & (home < cell)).any(axis=1)
    return before


def _comparer(tables: int, probes: int, cosine: float):
    def one_cell(key: tuple, rows: list[tuple]) -> list[tuple]:
        dim, layer, cell, low, high = key
        ids = np.array([r[0] for r in rows])
        copies = np.array([r[1] for r in rows])
        block = np.array([r[2] for r in rows])
        unit = np.frombuffer(b"".join(r[3] for r in rows), np.float64).reshape(len(rows), dim)
        code = np.frombuffer(b"".join(r[4] for r in rows), np.int32).reshape(len(rows), tables, 1 + probes)
        near = unit @ unit.T >= cosine
        home = code[:, layer, 0] == cell
        near &= home[:, None] | home[None, :]
        near &= ids[:, None] != ids[None, :]
        if low != high:
            near &= block[:, None] != block[None, :]
        if not near.any():
            return []
        label = ids.copy()
        while True:
            least = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (least == label).all():
                break
            label = least
        x, y = np.nonzero(np.triu(near))
        new = np.concatenate([~_met_before(code[x[k : k + 8192]], code[y[k : k + 8192]], layer, cell) for k in range(0, len(x), 8192)])
        links = np.bincount(x[new], copies[y[new]], len(ids)) + np.bincount(y[new], copies[x[new]], len(ids))
        some = near.any(axis=1)
        return list(zip(ids[some].tolist(), links[some].astype(np.int64).tolist(), label[some].tolist(), strict=True))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("dim", "layer", "cell", "low", "high")), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in ("a", "copies", "block", "unit", "codes")), strict=True)
            for own, value in zip(keys, values, strict=True):
                if own != key:
                    if len(rows) > 1:
                        out += one_cell(key, rows)
                    key, rows = own, []
                rows.append(value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "n", "label"])
                out = []
        if len(rows) > 1 and (out := one_cell(key, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "n", "label"])

    return compare


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.9,
    tables: int = TABLES,
    probes: int = PROBES,
    width: float = WIDTH,
) -> DataFrame:
    """Links between vectors of at least this cosine, and their groups.

    Takes `vec_id`, `embedding`; gives a row per input row: vec_id, n_links (other
    rows linked directly), component_id (smallest vec_id reachable), kept.

    A vector is filed in its own cell of every table and in the nearest others; a
    pair meets where one of the two is at home.  With eight tables a pair at
    cosine 0.9 is missed once in a thousand, closer ones less.  Equal vectors are one entry with its number of
    copies.  Cells go to tasks in pairs of blocks of about 512, so a cell with a
    third of all vectors is many tasks.  A pair counts in the first cell it shares.
    No pair leaves its task, only numbers of links and a label per vector.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without an id, link with nothing (their component is their id).  Vectors
    of different lengths are never compared.  Rows that repeat an id count as rows
    and share its component.  An empty table gives an empty one; other columns
    are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    whole = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull(), F.transform(vector, lambda x: x + F.lit(0.0))).alias("vector"),
    )
    whole = scratch.store(whole.select("vec_id", "vector", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g")))
    entries = whole.where("vector is not null").groupBy("h", "g").agg(F.min("vec_id").alias("a"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    entries = scratch.store(entries)
    schema = "a long, copies long, dim int, layer int, cell int, unit binary, codes binary"
    filed = scratch.store(entries.select("a", "copies", "vector").mapInArrow(_filer(tables, probes, width), schema))
    keys = ["dim", "layer", "cell"]
    sizes = scratch.store(filed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")))
    dealt = filed.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("a", "copies", *keys, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "unit", "codes")
    pairs = dealt.repartition(*keys, "low", "high").sortWithinPartitions(*keys, "low", "high", "a")
    met = scratch.store(pairs.mapInArrow(_comparer(tables, probes, cosine), "a long, n long, label long"))
    links = scratch.store(met.where("a <> label").select("a", F.col("label").alias("b")).distinct())
    roots = components(scratch, links)
    counts = met.groupBy("a").agg(F.sum("n").alias("n"))
    facts = entries.select("h", "g", "a", "copies").join(counts, "a", "left").join(roots.withColumnRenamed("id", "a"), "a", "left")
    facts = scratch.store(facts.select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "a").alias("root")))
    scratch.keep(whole, facts)
    sound, rest = whole.where("vector is not null"), whole.where("vector is null")
    found = sound.join(facts, ["h", "g"]).select("vec_id", "n_links", F.col("root").alias("component_id"))
    found = found.union(rest.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
