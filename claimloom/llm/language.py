"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import Scratch, mixed, pieces

ORDER = 5
FOLDS = 5  # each labelled document is scored by models counted without its fold
ENOUGH = 20  # documents from which a limit is fitted
QUANTILE, TAIL = 0.9, 4.0  # a limit lies so many times as far above the median as this quantile
UNKNOWN = "und"
_BITS = 12
_SYMBOL = np.uint64((1 << _BITS) - 1)
_ALPHABET = float(1 << _BITS)
_SLOTS = 19
_REACH = 400  # characters from which a text's cross-entropy counts as settled
_COUNT = "lang string, fold int, gram long, n long"
_LETTER: list[np.ndarray] = []


def _letters(points: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0][points]


def grams(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text, one per letter or gap, packed into integers; where each text's begin.

    Texts are lower-cased; every run of other characters is one gap, and each text
    starts with a gap.  A text without letters has none.
    """
    joined = "\x00".join((t or "").lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    end = points == 0
    if int(end.sum()) != len(texts) - 1:  # a text holds the separator itself
        joined = "\x00".join((t or "").lower().replace("\x00", " ") for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        end = points == 0
    letter = _letters(points)
    symbol = np.where(letter, (points ^ (points >> _BITS)) & 0xFFF, 0).astype(np.uint64)
    keep = letter | end
    keep[1:] |= letter[:-1]
    text = np.cumsum(end) - end
    symbol, text, letter = symbol[keep], text[keep], letter[keep]
    key = symbol.copy()
    for k in range(1, order):
        before = np.zeros(len(symbol), np.uint64)
        before[k:] = np.where(text[k:] == text[:-k], symbol[:-k], 0)
        key |= before << np.uint64(_BITS * k)
    some = np.bincount(text[letter], minlength=len(texts)) > 0
    use = some[text] & ~end[keep]
    return key[use], np.searchsorted(text[use], np.arange(len(texts) + 1))


class Model:
    """Sorted arrays of one language: n-grams with counts, contexts with totals, for each order."""

    def __init__(self, levels: list):
        self.levels = levels

    @classmethod
    def counted(cls, keys: np.ndarray, counts: np.ndarray, order: int) -> Model:
        levels = []
        shift = np.uint64(_BITS)
        for m in range(order, 0, -1):
            at = np.argsort(keys)
            keys, counts = keys[at], counts[at].astype(np.float64)
            once, twice = float((counts == 1).sum()), float((counts == 2).sum())
            discount = min(0.95, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))
            context, where = np.unique(keys >> shift, return_index=True)
            total = np.add.reduceat(counts, where) if len(keys) else counts
            kinds = np.diff(np.append(where, len(keys)))
            share = np.maximum(counts - discount, 0) / np.repeat(total, kinds) if len(keys) else counts
            levels.append((keys, share.astype(np.float32), context, (discount * kinds / total).astype(np.float32) if len(keys) else total))
            keys, counts = np.unique(keys & np.uint64((1 << (_BITS * (m - 1))) - 1), return_counts=True)
        return cls(levels[::-1])

    def logs(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / _ALPHABET)
        for m, (own, share, contexts, back) in enumerate(self.levels, 1):
            if not len(own):
                continue
            key = keys & np.uint64((1 << (_BITS * m)) - 1)
            context = key >> np.uint64(_BITS)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            p *= np.where(contexts[at] == context, back[at], 1)
            at = np.minimum(np.searchsorted(own, key), len(own) - 1)
            p += np.where(own[at] == key, share[at], 0)
        return np.log(p).astype(np.float32)


class Scorer:
    """Cross-entropy of texts under all models; scores of met n-grams are kept in slots."""

    def __init__(self, models: list[Model], order: int):
        self.models, self.order = models, order
        self.keys = np.full(1 << _SLOTS, 2**64 - 1, np.uint64)
        self.scores = np.zeros((1 << _SLOTS, len(models)), np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log probability per model, and the n-grams, of each text."""
        keys, at = grams(texts, self.order)
        if not self.models:
            return np.zeros((len(texts), 0)), np.diff(at)
        slot = (mixed(keys) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        found = self.scores[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            made = np.stack([m.logs(new) for m in self.models], axis=1)
            found[miss] = made[back]
            place = (mixed(new) >> np.uint64(64 - _SLOTS)).astype(np.int64)
            self.keys[place], self.scores[place] = new, made
        n = np.diff(at)
        out = np.zeros((len(texts), len(self.models)))
        some = np.flatnonzero(n)
        if len(some):
            out[some] = -np.add.reduceat(found, at[some], axis=0, dtype=np.float64) / n[some, None]
        return out, n


def _counter(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flushed(group: tuple) -> pa.RecordBatch:
            keys, n = _merged(held.pop(group))
            lang, fold = group
            columns = [pa.array([lang] * len(keys)), pa.array([fold] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n)]
            return pa.RecordBatch.from_arrays(columns, ["lang", "fold", "gram", "n"])

        for batch in pieces(batches, "text", 1 << 21):
            rows: dict[tuple, list] = {}
            for *group, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "fold", "text")), strict=True):
                rows.setdefault(tuple(group), []).append(text)
            for group in sorted(rows):
                keys, _ = grams(rows[group], order)
                if len(keys):
                    own = held.setdefault(group, [])
                    own.append(np.unique(keys, return_counts=True))
                    if sum(len(k) for k, _ in own) > 1_000_000:
                        own[:] = [_merged(own)]
                        if len(own[0][0]) > 500_000:
                            yield flushed(group)
        for group in list(held):
            yield flushed(group)

    return count


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def learn(docs: DataFrame, order: int = ORDER) -> dict:
    """Models of all languages of `text`, `lang` (null languages are left out).

    n-grams are counted over all documents and all of them are kept, whatever their
    count: discounts and continuation counts are those of the whole text.  Counts
    come to the driver language by language, and the models grow with the number of
    different n-grams, not with the rows.
    A language's limit of rejection is fitted on all of its documents: each different
    one is scored once, by models counted without its fold (a fifth, by hash of the
    text).  It is `TAIL` times the `QUANTILE` of what they lie above their median.
    Fewer than `ENOUGH` take those of all languages; if these are too few, none is rejected.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.where("lang is not null and text is not null")
    docs = docs.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    without = [F.sum(F.when(F.col("fold") != k, F.col("n")).otherwise(0)).alias(f"without{k}") for k in range(FOLDS)]
    counts = docs.mapInArrow(_counter(order), _COUNT).groupBy("lang", "gram").agg(F.sum("n").alias("n"), *without)
    counts = scratch.store(counts)
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())

    def counted(column: str) -> list[Model]:
        models = []
        for lang in langs:
            own = counts.where((F.col("lang") == lang) & (F.col(column) > 0)).select("gram", column).toArrow()
            models.append(Model.counted(own.column("gram").to_numpy().view(np.uint64), own.column(column).to_numpy(), order))
        return models

    models = counted("n")
    scored = []
    for k in range(FOLDS if langs else 0):
        own = docs.where(F.col("fold") == k).select(F.xxhash64("lang", "text").alias("doc_id"), "text")
        apart = _scored(own, dict(order=order, langs=langs, models=counted(f"without{k}"), usual=[], limit=[]))
        scored.append(scratch.store(apart.where("n_grams > 0").select("doc_id", "lang_pred", "entropy", "n_grams")))
    usual, limit = _limits(langs, reduce(DataFrame.union, scored).dropDuplicates(["doc_id"])) if scored else ([], [])
    scratch.keep()
    return dict(order=order, langs=langs, models=models, usual=usual, limit=limit)


def _limits(langs: list[str], scored: DataFrame) -> tuple[list, list]:
    """Each language's median entropy, and how far above it a text may lie.

    Quantiles are exact to a thousandth, to which values are rounded: the number of
    different values, not of documents, bounds what is held of a language.
    """

    def quantiles(value: Column, q: float) -> list[float] | None:
        some = F.count("*").alias("n"), F.percentile(F.round(value, 3), q).alias("at")
        every = scored.agg(*some).first()
        if every["n"] < ENOUGH:
            return None
        own = {r["lang_pred"]: r["at"] for r in scored.groupBy("lang_pred").agg(*some).where(F.col("n") >= ENOUGH).collect()}
        return [own.get(lang, every["at"]) for lang in langs]

    usual = quantiles(F.col("entropy"), 0.5)
    if usual is None:
        return [0.0] * len(langs), [float("inf")] * len(langs)
    middle = F.create_map(*[F.lit(x) for pair in zip(langs, usual, strict=True) for x in pair])
    settled = F.sqrt(F.least("n_grams", F.lit(_REACH)))
    far = quantiles((F.col("entropy") - F.element_at(middle, F.col("lang_pred"))) * settled, QUANTILE)
    return usual, [TAIL * max(0.1, x) for x in far]


def _judge(docs: DataFrame, model: dict):
    """Makes, on a worker, the function from texts to names, shares, n-gram counts and verdicts."""
    order, langs = model["order"], model["langs"]
    shared = docs.sparkSession.sparkContext.broadcast(([m.levels for m in model["models"]], model["usual"], model["limit"]))

    def judge():
        models, usual, limit = shared.value
        scorer = Scorer([Model(levels) for levels in models], order)

        def judged(texts: list[str | None]):
            ce, n = scorer.entropies(texts)
            known = (n > 0) & (len(langs) > 0)
            if not langs:
                return [UNKNOWN] * len(texts), np.zeros(len(n)), n, known, np.zeros(len(n))
            best = ce.argmin(axis=1)
            least = ce[np.arange(len(ce)), best]
            share = 1 / np.exp((least[:, None] - ce) * np.sqrt(n)[:, None]).sum(axis=1)
            near = known.copy()
            if usual:
                near &= (least - np.array(usual)[best]) * np.sqrt(np.minimum(n, _REACH)) <= np.array(limit)[best]
            names = [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            return names, np.where(known, share, 0.0), n, near, least

        return judged

    return judge


def _scored(docs: DataFrame, model: dict) -> DataFrame:
    judge = _judge(docs, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = judge()
        for batch in pieces(batches, "text"):
            names, share, n, near, least = own(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(share), pa.array(near), pa.array(least), pa.array(n)],
                ["doc_id", "lang_pred", "score", "accepted", "entropy", "n_grams"],
            )

    return docs.mapInArrow(score, "doc_id long, lang_pred string, score double, accepted boolean, entropy double, n_grams long")


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """The language of each whole text: doc_id, lang_pred, score, accepted, entropy, n_grams.

    Takes `doc_id`, `text`.  The language with the lowest cross-entropy per
    character wins (ties: the first by name); `score` is its share among all, by
    their entropies over the root of the length.  `accepted` is false for texts
    without a letter and for those further above the language's median entropy than
    its limit, which a tenth of bad documents among the labelled ones does not move far.

    Null, empty and letterless texts give `und`, score 0, not accepted.  Rows that
    repeat an id are scored each; null ids too.  An empty table gives an empty one.
    A model learned from nothing gives `und` for all.
    """
    return _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)


def accepted_documents(docs: DataFrame, model: dict) -> DataFrame:
    """Documents that are not rejected, all columns as they came; nothing is shuffled."""
    judge = _judge(docs, model)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = judge()
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.array(own(batch.column("text").to_pylist())[3]))

    return docs.mapInArrow(accept, docs.schema)
