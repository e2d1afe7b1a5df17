"""Samples, replies, agreement, packing and figures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import agreement as A
from claimloom.operators import coding as C
from claimloom.operators import figures, packing, sampling
from claimloom.plans import analysis
from claimloom.sources.tables import coder_entries


@pytest.fixture(scope="module")
def claims(spark):
    cats = ["church_actors", "urgency", "decolonisation"]
    data = [
        (i, f"d{i % 20}", "t", f"20{18 + i % 8}-03-01", "u", cats[0] if i % 3 else cats[1 + i % 2], f"term{i % 7}",
         f"Form{i % 5}", f"sentence {i}", "", "")
        for i in range(200)
    ]
    names = "claim_id int, doc_id string, doc_title string, doc_date string, doc_url string, category string, matched_term string, surface_form string, sentence string, context_before string, context_after string"
    from claimloom.functions.dates import juncture_of

    return spark.createDataFrame(data, names).withColumn("juncture", juncture_of(F.col("doc_date")))


def test_coding_sample_sizes_and_columns(claims):
    sheet = sampling.coding_sample(claims, n_per_category=15).collect()
    per_category = {}
    for r in sheet:
        per_category[r["category"]] = per_category.get(r["category"], 0) + 1
    sizes = {r["category"]: r["count"] for r in claims.groupBy("category").count().collect()}
    assert per_category == {c: min(15, n) for c, n in sizes.items()}
    assert sheet[0]["coder_notes"] is None
    again = sampling.coding_sample(claims.repartition(7), n_per_category=15).collect()
    assert {r["claim_id"] for r in again} == {r["claim_id"] for r in sheet}
    other = sampling.coding_sample(claims, n_per_category=15, seed=1).collect()
    assert {r["claim_id"] for r in other} != {r["claim_id"] for r in sheet}
    topped = sampling.coding_sample(claims, 15, 3).collect()
    ids = [r["claim_id"] for r in topped]
    assert len(ids) == len(set(ids)) > len(sheet)


def test_filters(claims):
    renamed = claims.withColumnsRenamed({"matched_term": "matched_term_lemma", "surface_form": "matched_surface_form"})
    assert sampling.filter_claims(renamed, term="FORM1").count() == 40
    assert sampling.filter_claims(renamed, term=".").count() == 0  # literal, no pattern
    assert sampling.filter_claims(renamed, juncture="J3_law_2024").count() == 25
    with pytest.raises(ValueError):
        sampling.filter_claims(renamed, juncture="J9")
    first = sampling.sample_claims(renamed, 3, category="urgency").collect()
    assert [r["claim_id"] for r in first] == sorted(r["claim_id"] for r in first)


def test_audit_sample_fills_up_with_negatives(claims):
    few = claims.withColumn("is_securitising", F.when(F.col("claim_id") % 50 != 1, F.col("claim_id") < 10))
    drawn = sampling.audit_sample(few, n=50).collect()
    positives = sum(r["is_securitising"] for r in drawn)
    assert positives == 9 and len(drawn) == 50
    many = claims.withColumn("is_securitising", F.col("claim_id") < 150)
    drawn = sampling.audit_sample(many, n=51).collect()
    assert sum(r["is_securitising"] for r in drawn) == 26 and len(drawn) == 51
    assert [r["claim_id"] for r in drawn] == sorted(r["claim_id"] for r in drawn)


def coded_pairs(spark, tp, fp, fn, tn):
    rows = [(True, True)] * tp + [(True, False)] * fp + [(False, True)] * fn + [(False, False)] * tn
    return spark.createDataFrame(rows, "is_securitising boolean, human_is_securitising boolean")


def test_agreement_worked_example(spark):
    r = A.binary_agreement(coded_pairs(spark, 20, 5, 10, 15)).collect()[0]
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (20, 5, 10, 15)
    assert r["kappa"] == pytest.approx(0.4)
    assert r["precision"] == pytest.approx(0.8) and r["recall"] == pytest.approx(2 / 3)
    k = A.cohen_kappa(coded_pairs(spark, 20, 5, 10, 15), "is_securitising", "human_is_securitising").collect()[0]
    assert k["kappa"] == pytest.approx(0.4) and k["agreement"] == pytest.approx(0.7)
    assert k["p_value"] == pytest.approx(math.erfc(abs(k["z"]) / math.sqrt(2)), abs=2e-7)
    assert k["band"] == "fair"


def test_agreement_of_one_category(spark):
    same = coded_pairs(spark, 7, 0, 0, 0)
    assert A.binary_agreement(same).collect()[0]["kappa"] == 1.0
    assert A.cohen_kappa(same, "is_securitising", "human_is_securitising").collect()[0]["kappa"] is None


def test_missing_codes_stay_in_the_denominator(spark):
    rows = [(None, True), (True, True), (True, None)]
    df = spark.createDataFrame(rows, "is_securitising boolean, human_is_securitising boolean")
    r = A.binary_agreement(df).collect()[0]
    assert r["n"] == 2 and r["tp"] == 1 and r["agreement"] == 0.5


def test_kappa_with_itself_is_one(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert A.cohen_kappa(labels, "quality", "quality").collect()[0]["kappa"] == pytest.approx(1.0)


def test_reliability_report(spark):
    manual, key = [], []
    for i in range(30):
        sec = i % 2 == 0
        manual.append((i, f"d{i}", " TRUE" if sec else "false", "material" if i % 4 else "Both", "state", "Russia"))
        key.append((i, f"d{i}", "true" if sec or i == 1 else "FALSE", "material", "state" if i % 6 else "nation", "Russia"))
    fields = "is_securitising securitisation_type referent_object threat_actor".split()
    m = spark.createDataFrame(manual, "sample_id int, doc_id string, " + ", ".join(f"manual_{f} string" for f in fields))
    k = spark.createDataFrame(key, "sample_id int, doc_id string, " + ", ".join(f"llm_{f} string" for f in fields))
    report = {r["variable"]: r for r in A.reliability(m, k).collect()}
    assert report["is_securitising"]["n"] == 30
    assert report["is_securitising"]["agreement"] == pytest.approx(29 / 30)
    assert report["securitisation_type"]["n"] == 15
    assert "threat_actor" not in report  # one code only
    assert "doc_id.llm" in A.joined_codes(m, k).columns


def test_replies_and_resume(spark, claims, tmp_path):
    replies = spark.createDataFrame(
        [(i, '{"is_securitising": true, "confidence": 2}' if i % 2 else "no json", 10, 5) for i in range(200)],
        "claim_id int, raw_response string, input_tokens int, output_tokens int",
    )
    results = spark.createDataFrame(
        [(f"d{i}", ["church_actors", "urgency"] if i < 10 else ["urgency"]) for i in range(20)],
        "id string, matched_categories array<string>",
    )
    original = claims.withColumnsRenamed(
        {"matched_term": "matched_term_lemma", "surface_form": "matched_surface_form"}
    ).withColumn("matched_term_lang", F.lit("uk")).drop("juncture")
    progress = str(tmp_path / "progress")
    first = analysis.run_coding(original, results, C.reply_coder(replies), progress)
    assert first.count() == 100
    assert first.where("rationale = 'API_ERROR'").count() == first.where("is_securitising IS NULL").count() == 50
    analysis.run_coding(original, results, C.reply_coder(replies), progress, str(tmp_path / "out"))
    assert spark.read.parquet(progress).count() == 100  # nothing was coded twice
    log = spark.read.json(str(tmp_path / "out/coding_log")).collect()[0]
    assert log["n_claims"] == 100 and log["n_coded"] == 50 and len(log["system_prompt_hash"]) == 12


def test_prompt(spark):
    row = spark.createDataFrame(
        [("T", None, "urgency", "term", "Form", "", "S", None)],
        "doc_title string, doc_date string, category string, matched_term string, surface_form string, context_before string, sentence string, context_after string",
    )
    text = row.select(C.claim_prompt().alias("p")).collect()[0]["p"]
    assert "Date: unknown" in text and "[Previous sentence]: (none)" in text and text.endswith("[Next sentence]: (none)")


def test_coder_entries(spark):
    replies = spark.createDataFrame(
        [
            ('```json\n[{"doc_id": "a", "is_securitising": "yes", "confidence": 3}, {"doc_id": "b"}]\n```', "batch_01.json"),
            ('{"doc_id": "c", "passage": "p", "is_securitising": true}', "batch_02.json"),
            ("broken [", "batch_03.json"),
            ("[]", "batch_04.json"),
        ],
        "value string, batch_file string",
    )
    found = coder_entries(replies).collect()
    assert sorted(r["doc_id"] for r in found) == ["a", "b", "c"]
    corpus = spark.createDataFrame(
        [("a", "Old", "2022-03-01", "risu.ua", "speech", "u", "1.json"), ("a", "New", "2022-03-02", "risu.ua", "speech", "u", "2.json")],
        "id string, title string, date string, source string, content_type string, url string, file_name string",
    )
    merged = {r["doc_id"]: r for r in analysis.merge_results(coder_entries(replies), corpus).collect()}
    assert merged["a"]["doc_title"] == "New" and merged["a"]["is_securitising"] and merged["a"]["confidence"] == 3
    assert merged["b"]["juncture"] == "unknown" and merged["b"]["is_securitising"] is False
    assert merged["c"]["is_securitising"] and merged["c"]["doc_title"] is None


def greedy(sizes, limit):
    batch, fill, out = 1, 0, []
    for s in sizes:
        if fill and fill + s > limit:
            batch, fill = batch + 1, 0
        fill += s
        out.append(batch)
    return out


def test_packing_equals_the_sequential_fold(spark):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 5, 300, 900, rng.randint(1, 899)]) for _ in range(700)]
    docs = spark.createDataFrame([(f"{i:05}", s) for i, s in enumerate(sizes)], "id string, packed_tokens bigint")
    for partitions in (1, 7, 64):
        got = packing.assign_batches(docs, ["id"], limit=1000, partitions=partitions).collect()
        assert [r["batch"] for r in sorted(got, key=lambda r: r["id"])] == greedy(sizes, 1000)


def _folded(sizes, fill, limit):
    closed = 0
    for size in sizes:
        if fill and fill + size > limit:
            closed, fill = closed + 1, 0
        fill += size
    return closed, fill


def test_fill_maps_compose_like_the_fold():
    rng = random.Random(12)
    for _ in range(150):
        limit = rng.choice([1, 7, 30, 100])
        parts = [[rng.choice([0, 1, rng.randint(0, limit)]) for _ in range(rng.randint(0, 12))] for _ in range(3)]
        a, b, c = (packing.fill_map(p, limit) for p in parts)
        left, right = packing.followed(packing.followed(a, b), c), packing.followed(a, packing.followed(b, c))
        whole = packing.fill_map(sum(parts, []), limit)
        for fill in range(limit + 1):
            want = _folded(sum(parts, []), fill, limit)
            assert packing.enter(left, fill) == packing.enter(right, fill) == packing.enter(whole, fill) == want
        assert len(left) <= limit + 1


def test_fill_maps_are_bounded_by_the_limit():
    """A million documents of one token are as many steps as the limit allows, not a million."""
    steps = None
    for _ in range(1_000_000 // packing.BLOCK):
        own = packing.fill_map([1] * packing.BLOCK, 20_000)
        steps = own if steps is None else packing.followed(steps, own)
        assert len(steps) <= 20_001
    n = 1_000_000 // packing.BLOCK * packing.BLOCK
    assert packing.enter(steps, 0) == ((n - 1) // 20_000, (n - 1) % 20_000 + 1)


def test_packing_through_a_tree_of_ranges(spark, monkeypatch):
    """More ranges than one task of the tree merges, and many tiny documents."""
    monkeypatch.setattr(packing, "FANOUT", 3)
    monkeypatch.setattr(packing, "BLOCK", 50)
    docs = spark.range(5000).select(F.format_string("d%05d", "id").alias("id"), (F.col("id") * 7919 % 4).alias("packed_tokens"))
    got = {r["id"]: r["batch"] for r in packing.assign_batches(docs, ["id"], limit=97, partitions=20).collect()}
    batch, used = 1, 0
    for i in range(5000):
        size = i * 7919 % 4
        if used and used + size > 97:
            batch, used = batch + 1, 0
        used += size
        assert got[f"d{i:05d}"] == batch


def test_packing_example_and_oversize(spark):
    sizes = [30000, 40000, 20000, 75000, 10000]
    docs = spark.createDataFrame([(str(i), s) for i, s in enumerate(sizes)], "id string, t int")
    packed = docs.withColumn("packed_tokens", packing.packed_size(F.col("t")))
    got = {r["id"]: (r["batch"], r["packed_tokens"]) for r in packing.assign_batches(packed, ["id"]).collect()}
    assert got == {"0": (1, 30000), "1": (1, 40000), "2": (2, 20000), "3": (3, 72000), "4": (4, 10000)}
    body = " ".join(["слово"] * 22000)
    cut = spark.range(1).select(packing.capped_body(F.lit(body), F.lit(77000)).alias("b")).collect()[0]["b"]
    assert len(cut.split()) == 20571 + 3 and cut.endswith("[... TRUNCATED ...]")


def test_prepared_batches_are_written(spark, tmp_path):
    body = "Церква і митрополит згадані тут разом. " * 10
    docs = spark.createDataFrame(
        [(f"d{i}", f"T{i}", f"2020-01-{i + 1:02}", "president.gov.ua", "speech", body) for i in range(6)]
        + [("x", "X", "2020-01-09", "president.gov.ua", "speech", "Погода гарна сьогодні. " * 10),
           ("y", "Y", None, "risu.ua", "risu_article", "Погода гарна сьогодні. " * 10),
           ("z", "Z", None, "risu.ua", "risu_article", "коротко")],
        "id string, title string, date string, source string, content_type string, body_text string",
    )
    out = analysis.prepare_batches(docs, str(tmp_path / "b"), max_tokens=500, codebook="read this")
    assert {r["id"] for r in out["prepared"].collect()} == {"d0", "d1", "d2", "d3", "d4", "d5", "y"}
    manifest = spark.read.option("header", True).csv(str(tmp_path / "b/manifest")).collect()
    assert sum(int(r["n_docs"]) for r in manifest) == 7
    texts = spark.read.text(str(tmp_path / "b/batches"), wholetext=True).collect()
    assert len(texts) == len(manifest)
    assert any("=== DOC d0 | 2020-01-01 | president.gov.ua | T0 ===" in r["value"] for r in texts)
    assert spark.read.text(str(tmp_path / "b/codebook_prompt")).collect()[0]["value"] == "read this"


def test_figures(spark):
    coded = spark.createDataFrame(
        [("a", "speech", "2020", True, "material", "state", "Russia", "ban"),
         ("a", "speech", "2020", False, "neither", "none", "none", "none"),
         ("b", "dess_statement", None, True, "x", "state", "other", "ban"),
         ("c", "speech", "2016", True, "both", "faith", "none", "none")],
        "doc_id string, doc_content_type string, year string, is_securitising boolean, securitisation_type string, referent_object string, threat_actor string, extraordinary_measure string",
    )
    frames = analysis.generate_figures(coded)
    funnel = {r["source"]: r for r in figures.funnel(figures.in_scope(coded)).collect()}
    assert (funnel["Zelensky"]["scraped"], funnel["Zelensky"]["relevant"], funnel["Zelensky"]["claims"]) == (1780, 56, 2)
    assert funnel["DESS"]["relevant"] == 1 and funnel["Rada"]["claims"] == 0
    assert frames["fig1_pipeline_funnel"].count() == 20
    assert {r["source_label"]: r["pct"] for r in frames["fig2_source_breakdown"].collect()} == {"Zelensky": 66.7, "DESS": 33.3}
    assert {(r["source_label"], r["sec_type"]) for r in frames["fig3_sec_type_by_source"].collect()} == {("Zelensky", "Material"), ("DESS", "Other")}
    assert [tuple(r) for r in frames["fig6_temporal"].collect()] == [(2020, "Zelensky", 1)]
    assert len(frames) == 7
