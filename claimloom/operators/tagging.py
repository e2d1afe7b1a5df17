"""Lemmas chosen by sentence: the best path through the readings of its words.

A word can have several readings, each a lemma with a tag.  Tagged sentences teach
how often a tag follows another and how often a word has a reading; the readings of
a sentence are those on its cheapest path.  Costs are whole thousandths of a
negative logarithm, so sums are exact and ties are real ties, which go by tag and
then lemma.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.plans.layout import written

_READING = "array<struct<tag:int,lemma:string,cost:long>>"
BORDER = -1  # stands before the first and after the last word


@dataclass
class Tagger:
    """What tagged sentences teach.  Only numbers per tag and pair of tags are on the driver."""

    tags: list[str]
    moves: np.ndarray  # cost of a tag (column) after another (row); the last of both is the border
    unseen: list[int]  # cost of a word that was never seen, by tag
    readings: DataFrame  # word, readings


def _cost(n, of):
    return F.round(-1000 * F.log(n / of)).cast("long")


def learn(tagged: DataFrame, most_tags: int = 1000) -> Tagger:
    """Costs of readings and of neighbouring tags.

    Takes `sentence`, `at` (order in it), `word`, `lemma`, `tag`; rows that lack one
    of them are left out.  Pairs of tags count one more than seen.  A tag set of
    over `most_tags` is refused, since pairs of tags are held in memory.
    """
    rows = tagged.select("sentence", "at", F.lower("word").alias("word"), "lemma", "tag").dropna()
    # Written, since totals, single words and readings all come from it: the texts are read for it and the pairs only.
    counts = written(rows.groupBy("word", "lemma", "tag").agg(F.count("*").alias("n")))
    totals = {r["tag"]: r["n"] for r in counts.groupBy("tag").agg(F.sum("n").alias("n")).limit(most_tags + 1).toLocalIterator()}
    if len(totals) > most_tags:
        raise ValueError(f"more than {most_tags} tags")
    tags = sorted(totals)
    number = {t: k for k, t in enumerate(tags)}

    once = {r["tag"]: r["n"] for r in counts.where("n = 1").groupBy("tag").agg(F.count("*").alias("n")).toLocalIterator()}
    unseen = [round(-1000 * float(np.log((once.get(t, 0) + 1) / (totals[t] + len(tags) + 1)))) for t in tags]

    order = Window.partitionBy("sentence").orderBy("at", "word", "tag")
    ends = F.lead("tag").over(order).isNull()
    pair = rows.select(F.lag("tag").over(order).alias("before"), "tag", ends.alias("ends"))
    last = pair.where("ends").select(F.col("tag").alias("before"), F.lit(None).cast("string").alias("tag"))
    pairs = pair.select("before", "tag").union(last).groupBy("before", "tag").agg(F.count("*").alias("n"))
    seen = np.ones((len(tags) + 1, len(tags) + 1), np.int64)
    for r in pairs.toLocalIterator():
        seen[number.get(r["before"], BORDER), number.get(r["tag"], BORDER)] += r["n"]
    moves = np.rint(-1000 * np.log(seen / seen.sum(axis=1, keepdims=True))).astype(np.int64)

    spark = tagged.sparkSession
    known = spark.createDataFrame([(t, number[t], totals[t]) for t in tags], "tag string, k int, total long")
    reading = F.struct(F.col("k").alias("tag"), "lemma", _cost(F.col("n"), F.col("total") + len(tags) + 1).alias("cost"))
    readings = (
        counts.join(F.broadcast(known), "tag")  # one row a tag
        .groupBy("word")
        .agg(F.sort_array(F.collect_list(reading)).alias("readings"))
    )
    return Tagger(tags, moves, unseen, readings)


def best_path(readings: list[list[tuple[int, str, int]]], moves: np.ndarray) -> list[int]:
    """Place of the chosen reading of every word; of equal paths the one whose last
    differing word has the earlier reading."""
    if not readings:
        return []
    came: list[np.ndarray] = []
    tag = np.array([BORDER])
    spent = np.zeros(1, np.int64)
    for some in readings:
        own = np.array([t for t, _, _ in some])
        paths = spent[:, None] + moves[np.ix_(tag, own)]
        came.append(paths.argmin(axis=0))
        spent = paths.min(axis=0) + np.array([c for _, _, c in some])
        tag = own
    k = int((spent + moves[tag, BORDER]).argmin())
    out = []
    for before in came[::-1]:
        out.append(k)
        k = int(before[k])
    return out[::-1]


def _chooser(moves: np.ndarray, tags: list[str], unseen: list[int]):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for words in batch.column("words").to_pylist():
                readings = [
                    [(r["tag"], r["lemma"], r["cost"]) for r in w["readings"] or ()]
                    or [(t, w["word"].lower(), c) for t, c in enumerate(unseen)]
                    for w in words
                ]
                path = best_path(readings, moves)
                chosen.append(
                    [
                        {"at": w["at"], "word": w["word"], "lemma": some[k][1], "tag": tags[some[k][0]]}
                        for w, some, k in zip(words, readings, path, strict=True)
                    ]
                )
            kind = pa.list_(pa.struct([("at", pa.int64()), ("word", pa.string()), ("lemma", pa.string()), ("tag", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("sentence"), pa.array(chosen, kind)], ["sentence", "words"])

    return choose


def tag(words: DataFrame, tagger: Tagger) -> DataFrame:
    """Words with the lemma and tag of the cheapest path through their sentence.

    Takes `sentence`, `at`, `word`; gives sentence, at, word, lemma, tag.  A word that
    was never seen may have any tag and is its own lemma.  Rows without a word or a
    sentence are left out; without any tagged word nothing can be chosen, and the
    result is empty.  A sentence is one row of a task.
    """
    kind = words.schema["sentence"].dataType.simpleString()
    rows = words.select("sentence", F.col("at").cast("long").alias("at"), "word").dropna()
    if not tagger.tags:
        return rows.limit(0).select("*", F.lit("").alias("lemma"), F.lit("").alias("tag"))
    known = tagger.readings.withColumnRenamed("word", "_word")
    rows = rows.join(known, F.lower("word") == F.col("_word"), "left")
    entry = F.struct("at", "word", F.coalesce("readings", F.array().cast(_READING)).alias("readings"))
    sentences = rows.groupBy("sentence").agg(F.sort_array(F.collect_list(entry)).alias("words"))
    out = f"sentence {kind}, words array<struct<at:long,word:string,lemma:string,tag:string>>"
    found = sentences.mapInArrow(_chooser(tagger.moves, tagger.tags, tagger.unseen), out)
    return found.select("sentence", F.inline("words"))
