"""Nearest neighbours by learned partitions: a balanced graph cut and a router."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import Scratch

PARTS = 32
SAMPLE = 6_000  # vectors that fit the partition and the router
NEIGHBOURS = 10
WANTED = 0.97  # recall on the sample that sets how many parts a query visits
BLOCK = 8_192
_HIDDEN = 96


def _nearest(x: np.ndarray, y: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    norm = (y**2).sum(axis=1)
    for a in range(0, len(x), 1024):
        d = norm[None, :] - 2 * x[a : a + 1024] @ y.T
        if skip_self:
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """Cuts a neighbour graph into parts of nearly equal size.

    Starts from median splits along main directions; then nodes move to the part
    that holds most of their neighbours while it has room.
    """
    label = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        nxt = []
        for g in groups:
            centred = x[g] - x[g].mean(axis=0)
            way = np.linalg.svd(centred, full_matrices=False)[2][0] if len(g) > 1 else np.zeros(x.shape[1])
            order = np.argsort(centred @ way, kind="stable")
            nxt += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
        groups = nxt
    for p, g in enumerate(groups):
        label[g] = p
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    near = [np.unique(np.concatenate([graph[i], np.array(back[i], np.int64)])) for i in range(len(x))]
    size = np.bincount(label, minlength=parts)
    most = int(np.ceil(len(x) / parts * slack))
    for _ in range(rounds):
        moved = 0
        for i in range(len(x)):
            votes = np.bincount(label[near[i]], minlength=parts).astype(float)
            votes[(size >= most) & (np.arange(parts) != label[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[label[i]]:
                size[label[i]] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A small network from a vector to the probability of each part."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, a, b, c, d = self.weights
        return np.maximum((x - mean) / scale @ a + b, 0) @ c + d

    @classmethod
    def trained(cls, x: np.ndarray, wanted: np.ndarray, rounds: int = 60, batch: int = 256) -> Router:
        rng = np.random.default_rng(5)
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z, parts = (x - mean) / scale, wanted.shape[1]
        w = [rng.normal(size=(x.shape[1], _HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(_HIDDEN), rng.normal(size=(_HIDDEN, parts)) / np.sqrt(_HIDDEN), np.zeros(parts)]
        m, v, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(rounds):
            order = rng.permutation(len(z))
            for k in range(0, len(z), batch):
                own = order[k : k + batch]
                h = np.maximum(z[own] @ w[0] + w[1], 0)
                o = h @ w[2] + w[3]
                p = np.exp(o - o.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                g = (p - wanted[own]) / len(own)
                gh = (g @ w[2].T) * (h > 0)
                grads = [z[own].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]
                t += 1
                for i, gr in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * gr
                    v[i] = 0.999 * v[i] + 0.001 * gr**2
                    w[i] -= 0.002 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return cls([mean, scale, *w])


def fit(sample: np.ndarray, parts: int = PARTS, k: int = NEIGHBOURS, wanted: float = WANTED) -> tuple[list[np.ndarray], int]:
    """The router's weights, and how many parts a query visits.

    A fifth of the sample is kept from training; visits rise until its true
    neighbours are found in the parts visited at the wanted rate.
    """
    parts = 1 << max(0, min(parts, len(sample) // 64 or 1).bit_length() - 1)
    if parts < 2:
        return [], 1
    graph = _nearest(sample, sample, k, True)
    label = balanced_parts(sample, graph, parts)
    share = np.zeros((len(sample), parts))
    np.add.at(share, (np.repeat(np.arange(len(sample)), k), label[graph].reshape(-1)), 0.5 / k)
    share[np.arange(len(sample)), label] += 0.5
    test = np.arange(len(sample)) % 5 == 0
    router = Router.trained(sample[~test], share[~test])
    logits = router.logits(sample)
    filed = logits.argmax(axis=1)
    order = np.argsort(-logits[test], axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    hit = np.take_along_axis(rank, filed[graph[test]], axis=1)
    visits = next(n for n in range(1, parts + 1) if (hit < n).mean() >= wanted)
    return router.weights, visits


def _assigner(weights: list[np.ndarray], visits: int, dim: int):
    """Files every vector under its likeliest part; a query also visits the next ones."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(weights)
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            rows = np.array([i for i, v in enumerate(vectors) if len(v) == dim], np.int64)
            other = np.array([i for i, v in enumerate(vectors) if len(v) != dim], np.int64)
            out = [(int(i), -len(vectors[i]), False) for i in other]
            query = np.array(batch.column("query").to_pylist())
            out += [(int(i), -len(vectors[i]), True) for i in other if query[i]]
            if len(rows):
                x = np.array([vectors[i] for i in rows])
                order = np.argsort(-router.logits(x), axis=1, kind="stable") if weights else np.zeros((len(rows), 1), int)
                out += [(int(i), int(p), False) for i, p in zip(rows, order[:, 0], strict=True)]
                out += [(int(i), int(p), True) for i, own in zip(rows, order, strict=True) if query[i] for p in own[:visits]]
            at = pa.array([o[0] for o in out], pa.int64())
            data = pa.array([np.array(v, np.float64).tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(at),
                    batch.column("vec_id").take(at),
                    pa.array([o[1] for o in out], pa.int32()),
                    pa.array([o[2] for o in out], pa.bool_()),
                    data.take(at),
                ],
                ["row", "vec_id", "part", "query", "vector"],
            )

    return assign


def _searcher(k: int):
    def search(rows: list[tuple]) -> list[tuple]:
        queries = [r for r in rows if r[2]]
        others = [r for r in rows if not r[2]]
        if not queries or not others:
            return []
        own_rows, ids = np.array([r[0] for r in others]), np.array([r[1] for r in others])
        y = np.frombuffer(b"".join(r[3] for r in others)).reshape(len(others), -1)
        x = np.frombuffer(b"".join(r[3] for r in queries)).reshape(len(queries), -1)
        largest = max(np.abs(y).max(), np.abs(x).max())
        # Squares of components beyond these would leave the range of doubles; a power of two changes no digit.
        scale = 1.0 if 1e-100 < largest < 1e100 else 2.0 ** np.floor(np.log2(largest))
        y, x = y / scale, x / scale
        norm, out = (y**2).sum(axis=1), []
        for a in range(0, len(x), 256):
            rough = norm[None, :] - 2 * x[a : a + 256] @ y.T
            for i, d in enumerate(rough):
                own, own_id = queries[a + i][:2]
                size = np.abs(d).max() + (x[a + i] ** 2).sum()
                near = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)] + 1e-9 * (1 + size))
                near = near[own_rows[near] != own]
                exact = np.sqrt(((y[near] - x[a + i]) ** 2).sum(axis=1)) * scale
                best = np.lexsort((own_rows[near], ids[near], exact))[:k]
                out += [(own, own_id, int(own_rows[near[b]]), int(ids[near[b]]), float(exact[b])) for b in best]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for batch in batches:
            for own, *value in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "vec_id", "query", "vector")), strict=True):
                if own != key:
                    out += search(rows)
                    key, rows = own, []
                rows.append(tuple(value))
            if out:
                yield _batch(out)
                out = []
        if out := search(rows):
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["query_row", "query_id", "row", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, query, k: int = NEIGHBOURS, parts: int = PARTS, sample: int = SAMPLE, wanted: float = WANTED) -> DataFrame:
    """The k nearest vectors found for each query, by Euclidean distance.

    Takes `vec_id`, `embedding`; `query` is a condition on `vec_id`.  Gives
    query_id, rank, vec_id, score.  The partition and the router are fitted on
    `sample` vectors, drawn by hash; every vector is filed.  A part goes to tasks
    in blocks of some thousand vectors against as many queries, so a part with a
    third of all vectors is many tasks; distances are exact on original vectors.

    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows without an id, take no part.  Ties go to the smaller vec_id; a query row is
    never its own neighbour.  Rows that repeat an id count each for itself: as
    candidates, also of one another, and as queries, each of which gives its own
    k rows.  Vectors are only compared with those of the same length.  A distance
    beyond the range of doubles is infinite.  An empty table gives an empty one.
    """
    scratch = Scratch(vectors.sparkSession)
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    whole = vectors.where(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    whole = scratch.store(whole.withColumns({"query": F.coalesce(query, F.lit(False)), "row": F.monotonically_increasing_id()}))
    drawn = [r[0] for r in whole.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample).select("vector").collect()]
    dim = max({len(v) for v in drawn}, key=[len(v) for v in drawn].count) if drawn else 0
    weights, visits = fit(np.array([v for v in drawn if len(v) == dim]), parts, k, wanted) if drawn else ([], 1)
    filed = scratch.store(whole.mapInArrow(_assigner(weights, visits, dim), "row long, vec_id long, part int, query boolean, vector binary"))
    sizes = filed.groupBy("part").agg(
        F.greatest(F.lit(1), F.ceil(F.sum((~F.col("query")).cast("int")) / BLOCK)).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.col("query").cast("int")) / BLOCK)).cast("int").alias("chunks"),
    )
    own = F.xxhash64("row", F.lit(9))
    # A row of the grid of blocks and chunks for each candidate, a column for each query.
    block = F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(own, F.col("blocks")).cast("int")))
    chunk = F.when(F.col("query"), F.array(F.pmod(own, F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = filed.join(scratch.store(sizes), "part").withColumn("block", F.explode(block)).withColumn("chunk", F.explode(chunk))
    dealt = dealt.select(F.struct("part", "block", "chunk").alias("place"), F.concat_ws("/", "part", "block", "chunk").alias("key"), "row", "vec_id", "query", "vector")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "vec_id", "row").drop("place")
    found = dealt.mapInArrow(_searcher(k), "query_row long, query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
