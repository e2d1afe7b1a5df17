"""Suffix, min-max and lattice dedup against brute force, and their odd cases."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from fixtures_llm import documents, vectors

from claimloom.llm import lattice_dedup, minmax_dedup, suffix_dedup, suffix_order


def removed(texts, length, first):
    """Which bytes go, window by window."""
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            seen[t[j : j + length]].append((i, j))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        for i, j in places[1:] if first else places if len(places) > 1 else []:
            gone[i][j : j + length] = b"\1" * length
    return gone


@pytest.mark.parametrize(("length", "first"), [(400, False), (200, True), (120, False)])
def test_suffix_dedup_is_brute_force(spark, sf, length, first):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = suffix_dedup.remove_repeats(docs, length=length, keep_first=first, whole_characters=False).collect()
    rows = sorted(docs.select("doc_id", "text").collect())
    texts = [(t or "").encode() for _, t in rows]
    for (i, _), text, gone, got in zip(rows, texts, removed(texts, length, first), sorted(found), strict=True):
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        assert (got.doc_id, got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256) == (i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_odd_cases(spark):
    docs = documents(spark)
    got = suffix_dedup.remove_repeats(docs, length=400, keep_first=False, whole_characters=False).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_removed == by[2].n_removed == by[None].n_removed == by[1].n_bytes
    assert by[6].n_bytes == by[7].n_bytes == by[7].n_removed == 0
    assert by[10].n_removed == 900  # the same letter, within one text
    assert by[8].n_removed == by[13].n_removed == by[12].n_removed == 0
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    whole = suffix_dedup.without_repeats(docs, 200)
    assert whole.columns == docs.columns
    kept = {r.doc_id: r.text for r in whole.collect()}
    assert 2 not in kept and kept[9].startswith("ü") and len(kept[11]) > 20000


def test_suffix_dedup_long_text_in_steps(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_STEP", 5000)
    docs = documents(spark)
    got = {(r.doc_id, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, keep_first=False, whole_characters=False).collect()}
    monkeypatch.undo()
    assert got == {(r.doc_id, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, keep_first=False, whole_characters=False).collect()}


def shingle_sets(rows, words):
    sets = {}
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    return sets


def groups(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)) or not x:
                continue
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("words", [4, 5])
def test_minmax_dedup_is_brute_force(spark, sf, words):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = shingle_sets(docs.select("doc_id", "text").collect(), words)
    roots = groups(sets)
    for r in minmax_dedup.near_duplicates(docs, words=words).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), roots[r.doc_id], roots[r.doc_id] == r.doc_id)


def test_minmax_dedup_odd_cases(spark):
    docs = documents(spark)
    got = minmax_dedup.near_duplicates(docs, words=4).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert (by[None].component_id, by[None].kept) == (None, False)
    assert by[6].n_shingles == by[7].n_shingles == 0 and by[7].kept
    assert by[8].n_shingles == 1 and by[8].kept
    kept = minmax_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "8", "8", "9", "10", "11", "None", "12", "13"])
    assert minmax_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_minmax_chain_and_hot_group(spark):
    """A chain of links is one group; a large group of near copies is found whole."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 200 - i]) + f" tail{i}", "en", "a") for i in range(40)]
    sets = shingle_sets([r[:2] for r in rows], 4)
    roots = groups(sets)
    got = minmax_dedup.near_duplicates(documents(spark, rows), words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == roots


def neighbours(ids, x, cosine=0.9):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], 2**62).min(axis=1))
        if (least == label).all():
            return near.sum(axis=1), label
        label = least


def test_lattice_dedup_is_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    near = np.repeat(centres, 30, axis=0) + 0.12 * rng.normal(size=(600, 16))
    x = np.concatenate([near, rng.normal(size=(400, 16)), near[:5]]).astype(np.float32)
    ids = list(range(len(x)))
    links, label = neighbours(ids, x.astype(float))
    got = sorted(lattice_dedup.near_vectors(vectors(spark, [(i, v.tolist()) for i, v in zip(ids, x, strict=True)])).collect())
    found = np.array([r.n_links for r in got])
    assert (found <= links).all() and found.sum() >= 0.995 * links.sum()
    assert np.mean([r.component_id == c for r, c in zip(got, label, strict=True)]) > 0.99


def test_lattice_blocks_and_odd_cases(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    hot = (np.ones(8) + 0.01 * rng.normal(size=(60, 8))).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(hot)]
    rows += [(100, None), (101, []), (102, [0.0] * 8), (103, [float("nan")] + [1.0] * 7), (104, [None] + [1.0] * 7), (105, [float("inf")] * 8), (106, [1.0] * 3), (None, hot[0]), (107, hot[5]), (5, hot[5])]
    got = lattice_dedup.near_vectors(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert all(by[i].n_links == 61 and by[i].component_id == 0 for i in (*range(60), 107))
    assert all((by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True) for i in range(100, 107))
    assert by[None].component_id is None and not by[None].kept
    assert lattice_dedup.near_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 2
    near = lattice_dedup.decode(x)
    others = near[:, None] + lattice_dedup._roots()[None]
    assert (((x - near) ** 2).sum(1)[:, None] <= ((x[:, None] - others) ** 2).sum(2) + 1e-9).all()


@pytest.mark.parametrize("length", [7, 12, 40])
def test_suffix_order_is_brute_force(spark, length):
    texts = {1: "a common passage of some words here " * 2, 2: "xx a common passage of some words here yy", 3: "", 4: None, 5: "aaaaaaaaaaaaaaaaaaaaaa", 6: "\0\0\0\0\0\0\0\0\0ü\0\0\0\0\0\0\0"}
    docs = spark.createDataFrame(list(texts.items()) + [(5, texts[5])], "doc_id long, text string")
    seen = defaultdict(list)
    for i, t in texts.items():
        own = (t or "").encode()
        for j in range(len(own) - length + 1):
            seen[own[j : j + length]].append((i, j))
    want = sorted(p for places in seen.values() for p in places[1:])
    assert sorted((r.doc_id, r.place) for r in suffix_order.matched_before(docs, length).collect()) == want
    ranked = {}
    for r in suffix_order.runs(docs, length).collect():
        ranked.setdefault((texts[r.doc_id] or "").encode()[r.place : r.place + length], set()).add(r.rank)
    assert all(len(ranks) == 1 for ranks in ranked.values())
    assert [min(ranked[b]) for b in sorted(ranked)] == sorted(min(r) for r in ranked.values())
