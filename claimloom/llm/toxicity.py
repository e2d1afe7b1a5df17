"""Toxic spans by a linear-chain conditional random field, and scores of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Scratch, pieces

SAMPLE = 12_000  # labelled documents that fit the model, at most half of them toxic
CHUNKS = 16_000  # token sequences that train the field
_LONG = 64  # tokens of a sequence: a line is cut there
_BITS = 18
_WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself, beginnings, endings, length."""
    names = [f"={word}", f"#{min(len(word), 12)}"]
    names += [f"<{word[:k]}" for k in (3, 4, 5) if len(word) > k]
    names += [f">{word[-k:]}" for k in (2, 3, 4) if len(word) > k]
    return [xxhash.xxh32_intdigest(n) & ((1 << _BITS) - 1) for n in names]


def affixes(word: str) -> list[str]:
    return [f"={word}"] + [f"<{word[:k]}" for k in (4, 5) if len(word) > k]


def lowered(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def sequences(text: str) -> list[list[str]]:
    """Lower-cased words by line and by at most `_LONG` words, in the order of the text."""
    lines = (_WORD.findall(line) for line in lowered(text).split("\n"))
    return [words[k : k + _LONG] for words in lines for k in range(0, len(words), _LONG)]


def marginals(emit: np.ndarray, size: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded sequences: P(toxic) per token, pair marginals summed, log Z.

    `emit` (sequences x tokens) is the score of the toxic state, that of the other
    is 0; `move` (2 x 2) are the scores of steps between states.
    """
    n, long = emit.shape
    alpha = np.zeros((n, long, 2))
    alpha[:, 0, 1] = emit[:, 0]
    for t in range(1, long):
        s = alpha[:, t - 1, :, None] + move
        alpha[:, t] = np.logaddexp(s[:, 0], s[:, 1])
        alpha[:, t, 1] += emit[:, t]
    beta = np.zeros((n, long, 2))
    for t in range(long - 2, -1, -1):
        nxt = beta[:, t + 1].copy()
        nxt[:, 1] += emit[:, t + 1]
        s = move + nxt[:, None, :]
        inner = np.logaddexp(s[:, :, 0], s[:, :, 1])
        beta[:, t] = np.where((t + 1 < size)[:, None], inner, 0.0)
    last = alpha[np.arange(n), size - 1]
    total = np.logaddexp(last[:, 0], last[:, 1])
    inside = np.arange(long)[None, :] < size[:, None]
    p = np.where(inside, np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - total[:, None], 0)), 0)
    pairs = np.zeros((2, 2))
    for t in range(long - 1):
        use = t + 1 < size
        nxt = beta[use, t + 1].copy()
        nxt[:, 1] += emit[use, t + 1]
        pairs += np.exp(alpha[use, t, :, None] + move + nxt[:, None, :] - total[use, None, None]).sum(axis=0)
    return p, pairs, total


def _padded(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros((len(size), max(1, int(size.max()))), values.dtype)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = values
    return out


def train(words: list[list[str]], tags: list[list[int]], rounds: int = 40, keep: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights of word features (the last is the bias) and steps, by gradient on the likelihood."""
    names = sorted({w for s in words for w in s})
    place = {w: i for i, w in enumerate(names)}
    owner, hashed = [], []
    for i, w in enumerate(names):
        f = features(w)
        owner += [i] * len(f)
        hashed += f
    owner, hashed = np.array(owner, np.int64), np.array(hashed, np.int64)
    size = np.array([len(s) for s in words])
    order = np.argsort(size, kind="stable")
    groups = []
    for own in np.array_split(order, max(1, len(order) // 4096)):
        own_size = size[own]
        flat = np.array([place[w] for i in own for w in words[i]])
        gold = np.array([t for i in own for t in tags[i]])
        moved = np.zeros((2, 2))
        for i in own:
            t = np.array(tags[i])
            np.add.at(moved, (t[:-1], t[1:]), 1)
        groups.append((own_size, flat, gold, moved))
    weight, move = np.zeros((1 << _BITS) + 1), np.zeros((2, 2))
    weight[-1] = -3.0
    state = [np.zeros_like(weight), np.zeros_like(weight), np.zeros((2, 2)), np.zeros((2, 2))]
    tokens = float(size.sum())
    for step in range(1, rounds + 1):
        emit = np.bincount(owner, weight[hashed], len(names)) + weight[-1]
        off, off_move = np.zeros(len(names)), np.zeros((2, 2))
        for own_size, flat, gold, moved in groups:
            p, pairs, _ = marginals(_padded(emit[flat], own_size), own_size, move)
            inside = np.arange(p.shape[1])[None, :] < own_size[:, None]
            off += np.bincount(flat, p[inside] - gold, len(names))
            off_move += pairs - moved
        grad = np.append(np.bincount(hashed, off[owner], 1 << _BITS), off.sum()) / tokens + keep * weight
        grads = (grad, off_move / tokens + keep * move)
        for k, (value, g) in enumerate(zip((weight, move), grads, strict=True)):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            value -= 0.2 * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return weight, move


def odds(emit: np.ndarray, size: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The marginals of `marginals`, by odds of the two states instead of logarithms.

    `emit` is tokens x sequences; places beyond a sequence's size are meaningless.
    """
    step, push = np.exp(move), np.exp(np.clip(emit, -30, 30))
    ahead, behind = np.empty_like(push), np.ones_like(push)
    ahead[0] = push[0]
    for t in range(1, len(push)):
        before = ahead[t - 1]
        ahead[t] = push[t] * (step[0, 1] + before * step[1, 1]) / (step[0, 0] + before * step[1, 0])
    for t in range(len(push) - 2, -1, -1):
        after = push[t + 1] * behind[t + 1]
        inner = (step[1, 0] + step[1, 1] * after) / (step[0, 0] + step[0, 1] * after)
        behind[t] = np.where(t + 1 < size, inner, 1.0)
    both = ahead * behind
    return both / (1 + both)


class _Known(dict):
    """Emission scores of words, made when a word is first met."""

    def __init__(self, weight: np.ndarray):
        self.weight = weight

    def __missing__(self, word: str) -> float:
        found = self[word] = float(self.weight[features(word)].sum() + self.weight[-1])
        return found


class Tagger:
    """Marginals of the tokens of whole texts; scores of met words are kept."""

    def __init__(self, weight: np.ndarray, move: np.ndarray):
        self.move, self.known = move, _Known(weight)

    def tag(self, texts: list[str | None]) -> list[tuple[np.ndarray, list[tuple[int, int, float]]]]:
        """For each text, P(toxic) of its words, and the likely ones with their places."""
        if len(self.known) > 500_000:
            self.known.clear()
        split = [sequences(text or "") for text in texts]
        size = np.array([len(s) for own in split for s in own], np.int64)
        flat = np.fromiter(map(self.known.__getitem__, (w for own in split for s in own for w in s)), np.float64)
        first = np.cumsum(size) - size
        p = np.empty(len(flat))
        order = np.argsort(size, kind="stable")
        for part in np.array_split(order, max(1, len(order) // 1024)) if len(order) else []:
            within = np.arange(int(size[part].max()))[:, None]
            inside = within < size[part]
            at = np.where(inside, first[part] + within, 0)
            p[at[inside]] = odds(flat[at], size[part], self.move)[inside]
        out, at = [], 0
        for text, own in zip(texts, split, strict=True):
            n = sum(map(len, own))
            mine = p[at : at + n]
            at += n
            likely = np.flatnonzero(mine >= 0.5)
            places = [m.span() for m in _WORD.finditer(lowered(text))] if len(likely) else []
            out.append((mine, [(*places[k], float(mine[k])) for k in likely]))
        return out


def _signals(p: np.ndarray) -> tuple[float, float]:
    """What a document's score is made of: expected toxic words, and the surest one."""
    return float(np.log(p.sum() + 1e-3)), float(p.max(initial=0.0))


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    z = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(len(b))
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-3 * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chunks: int = CHUNKS) -> dict | None:
    """The field and the document calibration, from `labels.toxic` of labelled documents.

    At most `sample` labelled documents are used, drawn by a hash of the id, toxic
    and clean ones alike; of texts that share their
    smallest shingle hash one stays.
    Words are labelled toxic in toxic documents when they, or their beginnings,
    occur there far more often than in clean ones (likelihood ratio 20 or more).
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = scratch.store(labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    sizes = dict(marks.groupBy("toxic").count().collect())
    if not sizes.get(1) or not sizes.get(0):
        return None
    draw = [marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for t in (0, 1)]
    # At most `sample` rows of two numbers.
    drawn = docs.join(F.broadcast(draw[0].union(draw[1])), "doc_id").select("doc_id", "toxic", "text")
    drawn = scratch.store(drawn.mapInArrow(_keyed, "doc_id long, toxic int, text string, alike long"))
    drawn = scratch.store(drawn.where("alike is not null").groupBy("alike", "toxic").agg(F.min_by("text", "doc_id").alias("text")))
    n = dict(drawn.groupBy("toxic").count().collect())
    if not n.get(1) or not n.get(0):
        return None
    seen = drawn.select("toxic", "text").mapInArrow(_affix_counts, "affix string, a long, b long").groupBy("affix").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rate = n[1] / (n[0] + n[1])
    all_ = F.col("a") + F.col("b")
    part = lambda k, share: F.when(k > 0, k * F.log(k / (all_ * share))).otherwise(0.0)
    ratio = (F.col("a") + 0.5) / (n[1] + 1) / ((F.col("b") + 0.5) / (n[0] + 1))
    strong = (2 * (part(F.col("a"), rate) + part(F.col("b"), 1 - rate)) >= 20) & (ratio >= 8)
    seeds = {r[0] for r in seen.where(strong).select("affix").collect()}  # affixes of a bounded sample
    cut = drawn.select("toxic", "text").mapInArrow(_labeller(seeds), "words array<string>, tags array<int>, hit boolean, place long")
    cut = scratch.store(cut)
    rows = [r for hit in (True, False) for r in cut.where(F.col("hit") == hit).orderBy("place", F.xxhash64("words")).limit(chunks // 2).collect()]
    if not rows:
        return None
    weight, move = train([r[0] for r in rows], [r[1] for r in rows])
    model = {"weight": weight.astype(np.float32), "move": move, "scale": None}
    signals = _tagged(drawn.select(F.lit(0).cast("long").alias("doc_id"), "text", "toxic"), model, "toxic").select("signal_words", "signal_top", "toxic").collect()
    y = np.array([r[2] for r in signals], float)
    balance = {t: sizes[t] / n[t] for t in (0, 1)}
    weights = np.where(y == 1, balance[1], balance[0])
    model["scale"] = _fit_logistic(np.array([r[:2] for r in signals], float), y, weights / weights.mean())
    return model


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of three words in a row: near copies mostly share it."""
    for batch in pieces(batches, "text"):
        alike = []
        for text in batch.column("text").to_pylist():
            words = (text or "").split()
            alike.append(min((xxhash.xxh64_intdigest(" ".join(words[k : k + 3])) >> 1 for k in range(max(1, len(words) - 2))), default=None) if words else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "text")), pa.array(alike, pa.int64())], ["doc_id", "toxic", "text", "alike"])


def _affix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        count: dict[str, list[int]] = {}
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for a in {a for w in set(_WORD.findall((text or "").lower())) for a in affixes(w)}:
                count.setdefault(a, [0, 0])[0 if toxic else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count)), *(pa.array([v[k] for v in count.values()], pa.int64()) for k in (0, 1))], ["affix", "a", "b"])


def _labeller(seeds: set[str]):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words, tags, place = [], [], []
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for own in sequences(text or ""):
                    words.append(own)
                    tags.append([int(bool(toxic) and any(a in seeds for a in affixes(w))) for w in own])
                    place.append(xxhash.xxh64_intdigest(" ".join(own)) >> 1)
            hit = [any(t) for t in tags]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int32())), pa.array(hit, pa.bool_()), pa.array(place, pa.int64())],
                ["words", "tags", "hit", "place"],
            )

    return label


def _tagged(docs: DataFrame, model: dict, *carried: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model["weight"], model["move"], model["scale"]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, move, scale = shared.value
        tagger = Tagger(weight, move)
        for batch in pieces(batches, "text"):
            found = tagger.tag(batch.column("text").to_pylist())
            signals = np.array([_signals(p) for p, _ in found]).reshape(-1, 2)
            score = np.zeros(len(found)) if scale is None else 1 / (1 + np.exp(-np.clip(signals @ scale[:2] + scale[2], -30, 30)))
            spans = [[{"first": a, "last": b, "p": q} for a, b, q in places] for _, places in found]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(c) for c in carried), pa.array(score), pa.array(signals[:, 0]), pa.array(signals[:, 1]), pa.array(spans, kind)],
                ["doc_id", *carried, "score", "signal_words", "signal_top", "spans"],
            )

    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.mapInArrow(tag, f"doc_id long{more}, score double, signal_words double, signal_top double, spans array<struct<first:long,last:long,p:double>>")


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """Toxicity of each whole text: doc_id, score, predicted, spans.

    Takes `doc_id`, `text`.  `spans` are the words whose marginal is at least one
    half, as places in the text (characters) with their probability.

    Null, empty and wordless texts get the score of a text without toxic words.
    Without a model (no labels of both kinds) every score is 0.  Rows that repeat
    an id are scored each; null ids too.  An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        spans = F.array().cast("array<struct<first:long,last:long,p:double>>")
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), spans.alias("spans"))
    found = _tagged(docs, model)
    return found.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
