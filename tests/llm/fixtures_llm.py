"""Small tables with every odd case, for all operators."""

import random

from pyspark.sql import types as T

CLASH = [T.StructField(c, T.StringType()) for c in ("n", "row", "band", "value", "size", "rate", "score", "label", "copies", "_id", "spans", "toxic", "_group", "docs", "tilt", "host", "page", "digest")]
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *CLASH,
    ]
)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "tu", "re", "Sa"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, rows=None):
    rng = random.Random(4)
    if rows is None:
        base, passage = words(rng, 300), words(rng, 120)
        edited = base.split()
        edited[40] = "changed"
        rows = [
            (1, base, "en", "a"),
            (2, base, "en", "a"),
            (3, " ".join(edited), "en", "b"),
            (4, words(rng, 80) + "\n" + passage + "\n" + words(rng, 50), "en", None),
            (5, passage + "  " + words(rng, 30), "de", "b"),
            (6, None, "de", "b"),
            (7, "", None, "c"),
            (8, "word", "en", "c"),
            (8, "word", "en", "c"),
            (9, "ü" * 700 + " é", "fr", "c"),
            (10, "a" * 900, "fr", None),
            (11, words(rng, 30000), "en", "a"),
            (None, base, "en", "a"),
            (12, " \t\n 123 !!! ", None, None),
            (13, words(rng, 3), "en", "d"),
        ]
    data = [(i, t, lang, s, None if t is None else len(t), *["x"] * len(CLASH)) for i, t, lang, s in rows]
    return spark.createDataFrame(data, DOCUMENTS)


VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), *CLASH, T.StructField("a", T.StringType()), T.StructField("part", T.StringType())]
)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *["x"] * (len(CLASH) + 2)) for i, v in rows], VECTORS)
