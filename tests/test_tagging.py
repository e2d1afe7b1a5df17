"""Readings chosen by sentence, on hand-made sentences and against enumeration."""

import itertools
import random

import numpy as np
import pytest

from claimloom.operators import tagging

SCHEMA = "sentence int, at int, word string, lemma string, tag string"
# "мати" is a noun (mother) after an adjective and a verb (to have) after "хоче".
TAUGHT = [
    [("добра", "добрий", "ADJ"), ("мати", "мати", "NOUN"), ("спить", "спати", "VERB")],
    [("стара", "старий", "ADJ"), ("мати", "мати", "NOUN"), ("хоче", "хотіти", "VERB")],
    [("він", "він", "PRON"), ("хоче", "хотіти", "VERB"), ("мати", "мати-дія", "INF"), ("дім", "дім", "NOUN")],
    [("він", "він", "PRON"), ("хоче", "хотіти", "VERB"), ("спати", "спати", "INF")],
]


@pytest.fixture(scope="module")
def tagger(spark):
    rows = [(s, k, *word) for s, words in enumerate(TAUGHT) for k, word in enumerate(words)]
    return tagging.learn(spark.createDataFrame(rows, SCHEMA))


def tagged(spark, tagger, *sentences):
    rows = [(s, k, w) for s, text in enumerate(sentences) for k, w in enumerate(text.split())]
    found = tagging.tag(spark.createDataFrame(rows, "sentence int, at int, word string"), tagger)
    return [(r.lemma, r.tag) for r in found.orderBy("sentence", "at").collect()]


def test_sentences_decide_between_readings(spark, tagger):
    got = tagged(spark, tagger, "Стара мати спить", "він хоче мати", "нова мати спить")
    assert got[1] == ("мати", "NOUN") and got[5] == ("мати-дія", "INF")
    assert got[6] == ("нова", "ADJ") and got[7] == ("мати", "NOUN")  # an unseen word takes the tag that fits


def cheapest(readings, moves):
    def price(path):
        tags = [tagging.BORDER, *(some[k][0] for some, k in zip(readings, path, strict=True)), tagging.BORDER]
        return sum(int(moves[a, b]) for a, b in itertools.pairwise(tags)) + sum(s[k][2] for s, k in zip(readings, path, strict=True))

    return min(itertools.product(*(range(len(s)) for s in readings)), key=lambda p: (price(p), p[::-1]))


def test_best_path_equals_enumeration():
    draw = random.Random(3)
    for _ in range(300):
        n = draw.randint(1, 4)
        moves = np.array([[draw.randint(0, 3) for _ in range(n + 1)] for _ in range(n + 1)])
        readings = [[(draw.randrange(n), "x", draw.randint(0, 2)) for _ in range(draw.randint(1, 3))] for _ in range(draw.randint(1, 6))]
        assert tuple(tagging.best_path(readings, moves)) == cheapest(readings, moves)


def test_odd_rows(spark, tagger):
    words = spark.createDataFrame([(1, 0, None), (None, 0, "він"), (2, 0, "він"), (2, 0, "він")], "sentence int, at int, word string")
    assert [r.lemma for r in tagging.tag(words, tagger).collect()] == ["він", "він"]
    assert tagging.tag(words.limit(0), tagger).count() == 0
    nothing = tagging.learn(spark.createDataFrame([], SCHEMA))
    assert tagging.tag(words, nothing).count() == 0
    with pytest.raises(ValueError):
        tagging.learn(spark.createDataFrame([(1, k, "a", "a", str(k)) for k in range(3)], SCHEMA), most_tags=2)


def test_tagged_words_are_read_for_counts_and_for_pairs_only(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = [(s, k, *word) for s, words in enumerate(TAUGHT) for k, word in enumerate(words)]
    taught = spark.createDataFrame(rows, SCHEMA)
    tagger = tagging.learn(taught.mapInArrow(counted, taught.schema))
    tagged(spark, tagger, "він хоче мати")
    assert reads.value == 2 * len(rows)
