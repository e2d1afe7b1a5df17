"""Language, toxicity, routed search: held-out accuracy, recall, odd cases."""

import itertools

import numpy as np
import pytest
from fixtures_llm import documents, vectors
from pyspark.sql import functions as F

from claimloom.llm import language, routed_search, toxicity
from claimloom.llm.common import held

MIDDLE = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = language.learn(docs.where(~held("doc_id", 4, 2)))
    found = language.identify(docs, model).join(docs.where(held("doc_id", 4, 2)).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98
    assert np.mean([r.accepted for r in found]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_kneser_ney_sums_to_one():
    keys, _ = language.grams(["abracadabra abra cad", "bad cab"], 3)
    model = language.Model.counted(*np.unique(keys, return_counts=True), 3)
    context = np.uint64(((ord("a") << 12) | ord("b")) << 12)
    every = context | np.arange(1 << 12, dtype=np.uint64)
    assert np.exp(model.logs(every).astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_language_odd_cases(spark):
    docs = documents(spark)
    model = language.learn(docs.where("doc_id < 12"))
    assert model["langs"] == ["de", "en", "fr"]
    by = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all((by[i].lang_pred, by[i].score, by[i].accepted) == ("und", 0.0, False) for i in (6, 7, 12))
    assert by[None].lang_pred == "en"
    kept = language.accepted_documents(docs, model)
    assert kept.columns == docs.columns and {1, 2, 11} <= {r.doc_id for r in kept.collect()}
    assert language.identify(docs.limit(0), model).count() == 0
    empty = language.learn(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.accepted_documents(docs, empty).count() == 0


def test_language_rejects_another_script(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = language.learn(docs)
    strange = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок да выпей чаю " * 3)], "doc_id long, text string")
    assert not language.identify(strange, model).first().accepted


def test_language_keeps_all_ngrams(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 4000)]
    rng = np.random.default_rng(3)
    texts = ["".join(letters[k] for k in rng.integers(0, 4000, 9000)) for _ in range(40)]
    docs = spark.createDataFrame([("zz", t) for t in texts + texts[:10]], "lang string, text string")
    levels = language.learn(docs)["models"][0].levels
    every = np.unique(language.grams(texts, language.ORDER)[0])
    assert len(levels[-1][0]) == len(every) > 300_000 and (levels[-1][0] == every).all()
    low = every & np.uint64((1 << 48) - 1)
    assert (levels[-2][0] == np.unique(low)).all()


@pytest.mark.parametrize("bad_rows", [0, 30])
def test_language_rejects_what_stands_far_off(spark, bad_rows):
    rng = np.random.default_rng(5)
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("lang is not null and n_chars > 1000").select("lang", "text")
    english = [r.text for r in docs.where("lang = 'en'").orderBy("text").limit(bad_rows + 2).collect()]
    junk = ["".join(rng.permutation(list(t[:2000]))) for t in english]
    polish = "Nie wiem, dlaczego wszyscy mieszkańcy tego miasteczka przyszli wczoraj wieczorem na rynek, żeby posłuchać orkiestry. "
    finnish = "Pohjoisen järven rannalla asui vanha kalastaja, joka lähti joka aamu ennen auringonnousua soutamaan saaren taakse. "
    bad = [("en", t) for t in junk[2:]] + [("fr", polish * 3)] * bool(bad_rows)
    model = language.learn(docs.union(spark.createDataFrame(bad, "lang string, text string")) if bad else docs)
    strange = [junk[0], junk[1][:100], finnish, finnish * 3] + [polish, polish * 3] * (not bad)
    found = language.identify(spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string"), model)
    assert not [r.doc_id for r in found.collect() if r.accepted]


def test_language_limits_come_from_every_document(spark, monkeypatch):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("lang is not null")
    fitted, seen = language._limits, []

    def spied(langs, scored):
        seen.extend(scored.collect())
        return fitted(langs, scored)

    monkeypatch.setattr(language, "_limits", spied)
    model = language.learn(docs.select("lang", "text").union(docs.select("lang", "text")))
    texts = {(r.lang, r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert len(seen) == len(texts)
    for k, lang in enumerate(model["langs"]):
        own = [r for r in seen if r.lang_pred == lang]
        entropy, n = np.array([r.entropy for r in own]), np.array([r.n_grams for r in own])
        assert model["usual"][k] == pytest.approx(np.median(entropy), abs=2e-3)
        far = (entropy - model["usual"][k]) * np.sqrt(np.minimum(n, 400))
        assert model["limit"][k] == pytest.approx(4 * np.quantile(far, 0.9), abs=0.01)


def all_paths(emit, move):
    """Marginals by listing every path."""
    n, total, on = len(emit), 0.0, np.zeros(len(emit))
    for path in itertools.product((0, 1), repeat=n):
        s = np.exp(sum(emit[t] * path[t] for t in range(n)) + sum(move[path[t], path[t + 1]] for t in range(n - 1)))
        total += s
        on += s * np.array(path)
    return on / total


def test_field_marginals_are_exact():
    rng = np.random.default_rng(0)
    move, size = rng.normal(size=(2, 2)), np.array([5, 3])
    emit = rng.normal(size=(2, 5)) * 2
    p, pairs, _ = toxicity.marginals(emit, size, move)
    other = toxicity.odds(emit.T.copy(), size, move).T
    for row, own, n in zip(p, other, size, strict=True):
        want = all_paths(emit[list(size).index(n)][:n], move)
        assert row[:n] == pytest.approx(want) and own[:n] == pytest.approx(want)
    assert pairs.sum() == pytest.approx((size - 1).sum())


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id")
    model = toxicity.learn(docs, labels.where(~held("doc_id", 5, 0)), sample=3000, chunks=4000)
    found = toxicity.score(docs.where(held("doc_id", 5, 0)), model).join(labels, "doc_id").collect()
    toxic, clean = [r for r in found if r.toxic], [r for r in found if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.85
    assert np.mean([r.predicted for r in clean]) < 0.03
    assert all(r.spans for r in toxic if r.predicted and r.score > 0.9)


def test_toxicity_odd_cases(spark):
    docs = documents(spark)
    rows = [(100 + i, f"some plain words {i} here and there number {i}" + (" horrid nasty" if i % 3 == 0 else ""), "en", "a") for i in range(120)]
    more = docs.union(documents(spark, rows))
    labels = spark.createDataFrame([(100 + i, int(i % 3 == 0)) for i in range(120)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(more, labels)
    by = {r.doc_id: r for r in toxicity.score(more, model).collect()}
    assert by[100].predicted == 1 and by[101].predicted == 0
    text = rows[0][1]
    assert [text[s.first : s.last] for s in by[100].spans] == ["horrid", "nasty"]
    assert by[6].score == by[7].score and by[6].predicted == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def exact(ids, x, i, k):
    d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
    d[i] = np.inf
    return [(ids[j], d[j]) for j in np.lexsort((ids, d))[:k]]


def test_routed_search_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = sorted(table.select("vec_id", "embedding").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = routed_search.nearest(table, F.col("vec_id") % 50 == 0).collect()
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[i])
        assert [r[0] for r in own] == list(range(1, 11))
        want = dict(exact(ids, x, i, 10))
        hits, total = hits + len(want.keys() & {r[1] for r in own}), total + 10
        assert all(want.get(v, s) == s for _, v, s in own)
    assert hits / total >= 0.9


def test_routed_search_odd_cases(spark, monkeypatch):
    monkeypatch.setattr(routed_search, "BLOCK", 4)
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)] + [(50, None), (51, [0.0, 0.0]), (52, [float("nan"), 1.0]), (100, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [3.0, 1.0])]
    got = routed_search.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, k=10).collect()
    own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 0)
    x = np.array([r[1] for r in rows[:40]])
    want = exact(np.arange(40), x, 0, 10)
    assert [(v, s) for _, v, s in own] == want
    assert not [r for r in got if r.query_id == 100]
    assert routed_search.nearest(vectors(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0


def test_routed_search_repeated_ids_and_huge_components(spark):
    """Every row is a candidate and every query row a query, in whatever order they come."""
    rows = [(i, [float(i), 1.0]) for i in range(1, 40)] + [(0, [1.0, 1.0]), (0, [50.0, 50.0]), (7, [1.0, 1.5]), (7, [1.0, 1.5])]
    found = []
    for given in (rows, rows[::-1]):
        got = routed_search.nearest(vectors(spark, given), F.col("vec_id") == 0, k=5).collect()
        found.append(sorted((r.score, r.vec_id) for r in got))
    want = []
    for x in ([1.0, 1.0], [50.0, 50.0]):
        d = sorted((float(np.sqrt((v[0] - x[0]) ** 2 + (v[1] - x[1]) ** 2)), i) for i, v in rows if v != x or i != 0)
        want += d[:5]
    assert found[0] == found[1] == sorted(want)
    for factor in (1e200, 1e-200):
        huge = [(i, [factor * i, factor]) for i in range(30)]
        got = routed_search.nearest(vectors(spark, huge), F.col("vec_id") == 0, k=4).toPandas()
        assert got.sort_values("rank").vec_id.tolist() == [1, 2, 3, 4]
        assert np.allclose(got.sort_values("rank").score / factor, [1, 2, 3, 4])
