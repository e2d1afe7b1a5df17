"""Resampling, hard negatives and token blocks against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from fixtures_llm import documents, vectors, words
from pyspark.sql import functions as F

from claimloom.llm import hard_negatives, resampling, token_blocks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _plain_resample(docs, target, longest, buckets, seed, least, percent):
    def features(text):
        w = WORD.findall(_lower(text))
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return [zlib.crc32(r.encode()) % buckets for r in runs], len(w)

    raw, wanted = [0] * buckets, [0] * buckets
    for table, counts in ((docs, raw), (target, wanted)):
        for _, text in table:
            for b in features(text)[0]:
                counts[b] += 1
    s, t = sum(raw) + buckets, sum(wanted) + buckets
    gain = [math.floor(1000 * math.log((y + 1) * s / ((x + 1) * t))) for x, y in zip(raw, wanted, strict=True)]
    rows = []
    for doc, text in docs:
        found, n = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc, len(found), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    return able[:drawn], able[drawn:] + [r for r in rows if r[2] < least]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_plain(spark, longest):
    rng = random.Random(1)
    docs = documents(spark)
    more = documents(spark, [(100 + i, words(rng, rng.randint(0, 60)) + rng.choice(["", " É Ö\x00x-Y_z 12"]), "en", "a") for i in range(60)])
    docs = docs.unionByName(more)
    target = documents(spark, [(1, words(rng, 200), "en", "a"), (2, None, "en", "a"), (3, "Ka LO 12", "en", "a")])
    got = resampling.resample(docs, target, longest=longest, buckets=97, seed=5, least_words=3, percent=30).collect()
    drawn, rest = _plain_resample([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in target.collect()], longest, 97, 5, 3, 30)
    assert len(got) == docs.count()
    assert [tuple(r)[:5] for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [tuple(r) for r in drawn]
    assert sorted(r.rank for r in got if r.rank) == list(range(1, len(drawn) + 1))
    plain = sorted((str(tuple(r)) for r in rest))
    assert sorted(str(tuple(r)[:5]) for r in got if not r.rank) == plain


def test_resampling_odd_tables(spark):
    empty = documents(spark, [])
    assert resampling.resample(empty, empty).collect() == []
    got = resampling.resample(documents(spark), empty, least_words=1, percent=100).collect()
    assert len(got) == 15 and sum(r.rank is not None for r in got) == 13  # null and empty texts have no words


def _plain_negatives(rows, is_anchor, positives=5, negatives=5):
    able = [
        (n, i, label, [math.floor(256 * float(x)) for x in v])
        for n, (i, label, v) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a in able:
        if not is_anchor(a[1]):
            continue
        scored = []
        for c in able:
            if c[0] != a[0]:
                score = sum(x * y for x, y in zip(a[3], c[3], strict=False))
                score = max(-(2**63), min(2**63 - 1, score))
                scored.append((-score, c[1] is None, c[1] or 0, c[0], c[2] == a[2]))
        scored.sort()
        for p in [s for s in scored if s[4]][:positives]:
            fits = [s for s in scored if not s[4] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:negatives]
            for rank, s in enumerate(fits, 1):
                out.append((a[1], None if p[1] else p[2], rank, None if s[1] else s[2], -p[0], -s[0]))
    return sorted(out, key=str)


def _labelled(spark, rows):
    frame = vectors(spark, [(i, v) for i, _, v in rows]).drop("label", "embedding")
    plain = spark.createDataFrame([(n, i, label, v) for n, (i, label, v) in enumerate(rows)], "at long, vec_id long, label int, embedding array<double>")
    extra = [c for c in frame.columns if c not in ("vec_id", "at", "label", "embedding")]
    return plain.select("*", *[F.lit("x").alias(c) for c in [*extra, "_row", "vector", "cluster", "bound", "is_anchor"]]).drop("at")


def _check_negatives(spark, rows, **sizes):
    found = hard_negatives.hard_negatives(_labelled(spark, rows), F.col("vec_id") % 10 == 0, **sizes)
    assert sorted(map(tuple, found.collect()), key=str) == _plain_negatives(rows, lambda i: i is not None and i % 10 == 0)


def test_hard_negatives_on_clusters_and_copies(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 16)) * 3
    rows = []
    for i in range(700):
        c = int(rng.integers(6))
        v = middle[c] + rng.normal(size=16) * rng.choice([0.05, 0.5])
        rows.append((i, int(rng.integers(3)), v.tolist()))
    rows += [(1000 + i, i % 3, middle[0].tolist()) for i in range(200)]  # copies under three labels
    rows += [(1000, 1, middle[0].tolist())] * 3  # repeated rows
    _check_negatives(spark, rows, members=8, head=64, part=100, block=5)


def test_hard_negatives_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, rng.normal(size=4).tolist()) for i in range(30)]
    rows += [(40, None, [1.0] * 4), (41, 1, None), (42, 1, [1.0, None, 0.0, 0.0]), (43, 0, [float("nan")] * 4), (44, 0, [float("inf")] * 4)]
    rows += [(50, 0, [0.0] * 4), (51, 1, [0.0] * 4), (52, 0, []), (None, 0, [1.0] * 4), (60, 1, [1.0] * 6), (70, 9, [1.0] * 4)]
    _check_negatives(spark, rows, members=2, head=4)
    _check_negatives(spark, [*rows, (80, 0, [1e200] * 4), (81, 0, [3e200] * 4), (82, 1, [1e200] * 4), (90, 1, [-3e10] * 4)])
    _check_negatives(spark, [(10, 1, [1.0]), (20, 1, [1.0])])
    _check_negatives(spark, [(11, 1, [1.0])])
    _check_negatives(spark, [])


def test_walk_ends_where_the_bound_certifies(spark):
    """On separate clusters most of a list is never sent."""
    rng = np.random.default_rng(5)
    middle = np.eye(8) * 4
    rows = [(i, i % 2, (middle[i % 8] + rng.normal(size=8) * 0.02).tolist()) for i in range(1600)]
    unit = np.array([v for _, _, v in rows])
    centres = hard_negatives.centres_of(np.floor(256 * unit[::10]), 8)
    wide = np.zeros(8) + 0.05
    bound = hard_negatives.bounds(np.floor(256 * unit), centres, wide)
    assert (bound >= 0.8 * 256 * 4 * 0.9).mean() < 0.3
    _check_negatives(spark, rows, members=20, head=50, part=64)


def test_blocks_round_trip():
    rng = np.random.default_rng(6)
    lengths = [0, 1, 2, 700, 40_000, 3, 0, 150_000]
    documents_ = [np.minimum(rng.zipf(1.3, n), 49_000).astype(np.int64) for n in lengths]
    data = token_blocks.encode_block(documents_, 49_408)
    back = token_blocks.decode_block(data)
    assert len(back) == len(lengths) and all((a == b).all() for a, b in zip(documents_, back, strict=True))
    assert len(data) < 2 * sum(lengths)
    stream = data + token_blocks.encode_block([], 10) + token_blocks.encode_block([np.arange(9)], 10)
    assert [len(b) for b in token_blocks.read_stream(stream)] == [8, 0, 1]
    for wide in (2, 70_000, 1 << 18):
        ids = [rng.integers(0, wide, 5_000)]
        assert (token_blocks.decode_block(token_blocks.encode_block(ids, wide))[0] == ids[0]).all()


def test_order_two_is_learned():
    rng = np.random.default_rng(7)
    phrase = rng.integers(0, 40_000, 300)
    ids = np.concatenate([phrase] * 400)
    assert len(token_blocks.encode_block([ids], 49_408)) < len(ids) // 2  # 4 bits an id; 16 without contexts


def test_damaged_block_is_refused():
    data = bytearray(token_blocks.encode_block([np.arange(500)], 1000))
    for at in (0, 5, 9, 40, len(data) - 1):
        broken = data.copy()
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_blocks.decode_block(bytes(broken))
    with pytest.raises(ValueError):
        token_blocks.decode_block(bytes(data[:-2]))


TEXTS = [
    None,
    "",
    " \t\n ",
    "It's we'll DON'T ''s ''' 'S 12 3½ ²",
    "ÄÖÜ straße ŸŽ ĸ ŉ ſ µ ª º × ÷ \xad \xa0 x",
    "İstanbul ΑΣ σς é   ﬁ Ⱥ ɐ 漢字 \U0001f600 и їжак",
    "<|endoftext|> <|STARTOFTEXT|> a <|b|>",
    "\x00\x1c\x1f\x7f\x85 a\x0bb\x0cc",
    " " * 1_000_000 + "x",
    "ab" * 60_000,
    "# \" ! #",
]


def test_word_ids_equal_the_library():
    ids = token_blocks.WordIds(token_blocks.vocabulary_file(), most=10)
    for _ in range(2):
        got = ids(TEXTS)
        for text, found in zip(TEXTS, got, strict=True):
            assert ids.tokenizer.encode(text or "", add_special_tokens=False).ids == found.tolist(), (text or "")[:30]


def test_new_words_are_asked_for_together():
    ids = token_blocks.WordIds(token_blocks.vocabulary_file())
    whole, asked = ids._whole, []
    ids._whole = lambda texts: asked.append(texts) or whole(texts)
    text = " ".join(f"word{chr(97 + i % 26)}é{chr(97 + i // 26)} x'll, 7" for i in range(600))
    assert ids([text, "new"])[0].tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert not asked  # one call a word made half of the work
    ids.ends[:] = False  # a vocabulary whose ids do not tell words apart
    assert ids(["others of it"])[0].tolist() == ids.tokenizer.encode("others of it", add_special_tokens=False).ids
    assert asked == [["others", "of", "it"]]


def test_words_cut_at_once_equal_the_library():
    rng = np.random.default_rng(8)
    parts = ["'", "'s", "'re", "'LL", "'v", "s", "ve", "l", "Aé", "ÿ", "ß", "7", "½", "²", "-", "!!", "×", "\xad", " ", "  ", "\n", "\t\r\n"]
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 12, 1500)]
    ids = token_blocks.WordIds(token_blocks.vocabulary_file(), most=200)
    for a in range(0, len(texts), 300):
        for text, found in zip(texts[a : a + 300], ids(texts[a : a + 300]), strict=True):
            assert ids.tokenizer.encode(text, add_special_tokens=False).ids == found.tolist(), text


def test_words_met_again_are_not_asked_for_again():
    ids = token_blocks.WordIds(token_blocks.vocabulary_file(), most=60)
    own, asked = ids._asked, []
    ids._asked = lambda words: asked.extend(words) or own(words)
    for i in range(10):
        text = "some words stay " + " ".join(f"rare{chr(97 + i)}{chr(97 + k)}" for k in range(20))
        assert ids([text])[0].tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(ids.words) <= 60 + 24
    assert asked.count("stay") == 1  # all words were forgotten once they were too many
    ids([" ".join(f"more{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100))] * 2)
    ids(["x"])
    assert len(ids.words) < 60


def test_round_trip_of_documents(spark):
    docs = documents(spark)
    more = documents(spark, [(20 + i, t, "en", "a") for i, t in enumerate(TEXTS)])
    table = docs.unionByName(more)
    got = sorted((tuple(r) for r in token_blocks.round_trip(table, size=500).collect()), key=lambda r: r[1])
    ids = token_blocks.WordIds(token_blocks.vocabulary_file())
    rows = sorted(((r.doc_id, r.text) for r in table.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    start, expected = 0, []
    for doc, text in rows:
        found = np.array([*ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((doc, start, len(found), zlib.crc32(found.tobytes())))
        start += len(found)
    assert got == expected
    assert token_blocks.round_trip(documents(spark, [])).collect() == []
