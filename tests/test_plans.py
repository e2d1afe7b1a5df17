"""What the physical plans must and must not contain, and skew."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from claimloom.catalog import base
from claimloom.operators import matching, reports, sampling
from claimloom.plans import layout


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def corpus(spark, sf):
    """The corpus without the spreading of small inputs."""
    return base.study_corpus(spark, sf)


def test_matching_is_one_stage_in_the_jvm(spark, corpus):
    text = plan(matching.surface_claims(corpus, base.study_lexicon()))
    assert "BroadcastHashJoin" in text
    assert not re.search(r"Python|SortMergeJoin|CartesianProduct|NestedLoop|Window|\bSort\b", text)
    # The only exchange is the spreading of the small test input.
    assert text.count("Exchange hashpartitioning") <= 1
    lemma = plan(matching.lemma_claims(corpus, base.study_lemma_lexicon()))
    assert "BroadcastHashJoin" in lemma and not re.search(r"Python|Window|SortMergeJoin", lemma)


@pytest.mark.parametrize("found", ["surface", "overlapping", "lemma"])
def test_words_probe_the_lexicon_in_generated_code(spark, corpus, found):
    # Outside generated code every word would be a row that holds all words of its sentence.
    claims = {
        "surface": lambda: matching.surface_claims(corpus, base.study_lexicon()),
        "overlapping": lambda: matching.surface_claims(corpus, base.overlapping_lexicon()),
        "lemma": lambda: matching.lemma_claims(corpus, base.study_lemma_lexicon()),
    }[found]()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joins = re.findall(r"(\* )?BroadcastHashJoin", plan(claims).split("\n\n\n")[0])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert joins and all(joins)


def test_texts_are_split_once(spark, corpus):
    text = plan(matching.surface_claims(corpus, base.study_lexicon()))
    assert len(re.findall(r"split\(text#\d+, \(\?U\)", text)) == 1


def test_counts_read_only_needed_columns(spark, sf):
    text = plan(reports.claims_by_category(base.study_claims(spark, sf)))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "context_before" not in text


def test_filters_reach_the_scan(spark, sf):
    docs = base.table(spark, sf, "documents").where(F.col("source") == "src3").select("doc_id")
    text = plan(docs)
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in text
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in text


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    text = plan(reports.top_terms_by_juncture(base.study_prepared(spark, sf)))
    assert "WindowGroupLimit" in text
    drawn = sampling.per_stratum(base.study_coded(spark, sf).select("claim_id", "category"), ["category"], "claim_id", 5, 1)
    assert "WindowGroupLimit" in plan(drawn)


def test_no_query_has_a_cross_or_nested_loop_join(spark, sf):
    for name in ("summary_overview", "kappa_type", "cooccurrence", "agreement_binary", "funnel", "juncture_breakdown"):
        text = plan(base.QUERIES[name](spark, sf))
        assert not re.search(r"CartesianProduct|NestedLoop", text), name


def test_preparing_texts_needs_no_shuffle(spark, sf):
    text = plan(base.QUERIES["prepared_documents"](spark, sf))
    assert text.count("Exchange hashpartitioning") <= 1
    assert "Python" not in text


def test_spread_only_where_the_session_asks(spark):
    many = spark.range(0, 1000, 1, 64)
    before = spark.conf.get(layout.SPREAD, None)
    spark.conf.unset(layout.SPREAD)
    assert layout.spread(many) is many
    spark.conf.set(layout.SPREAD, "5")
    assert layout.spread(many).rdd.getNumPartitions() == 5
    spark.conf.set(layout.SPREAD, before) if before else spark.conf.unset(layout.SPREAD)


def test_a_large_lexicon_is_broadcast_in_parts(spark, corpus, monkeypatch):
    """Beyond the limit the table is cut; word rows are still not shuffled."""
    from claimloom.operators import lexicon

    whole = matching.surface_claims(corpus, base.study_lexicon()).count()
    monkeypatch.setattr(lexicon, "BROADCAST_LIMIT_BYTES", 400)
    assert len(base.study_lexicon().frames(spark)) > 1
    found = matching.surface_claims(corpus, base.study_lexicon())
    assert "SortMergeJoin" not in plan(found) and "Union" in plan(found)
    assert found.count() == whole > 0


def test_numbers_are_exact_under_skew(spark):
    """One key with most of the rows is cut into ranges like any other."""
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"),
        "id",
    )
    numbered = layout.number_rows(rows, ["k", "id"], "n", partitions=16).collect()
    ordered = sorted(numbered, key=lambda r: r["n"])
    assert [r["n"] for r in ordered] == list(range(1, 20001))
    keys = [(r["k"].encode(), r["id"]) for r in ordered]
    assert keys == sorted(keys)


def test_checkpoint_folder_is_the_named_one(spark):
    frame = layout.cut_lineage(spark.range(3))
    assert frame.count() == 3
    assert spark.sparkContext.getCheckpointDir()


def test_functions_reach_workers_that_lack_the_package(sf, tmp_path):
    """Workers find neither the package on their path nor in their folder."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as e\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "q = e.queries()\n"
        "for n in ('html_articles_by_source', 'session_pages', 'next_pages', 'batch_pack'):\n"
        f"    print(n, q[n](s, {sf!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch_pack 200" in done.stdout


def test_claim_numbers_exchange_no_sentence(corpus):
    narrow = matching.surface_claims(corpus, base.study_lexicon()).select(*matching.CLAIM_ORDER, "match_start")
    numbered = matching.claim_numbers(narrow, base.study_lexicon())
    text = plan(numbered)
    ids = sorted(r[0] for r in numbered.select("claim_id").collect())
    assert ids == list(range(1, len(ids) + 1)) and ids
    assert "rangepartitioning" not in text
    for line in text.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "sentence#" not in line and "body_text" not in line
    widths = [f.name for f in numbered.schema]
    assert widths == [*matching.CLAIM_ORDER, "match_start", "claim_id"]


def test_prefix_sums(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"), (F.col("id") % 5).alias("v"))
    got = sorted((r.k, r.v, r.s) for r in layout.prefix_sums(rows, ["k"], "v", "s", rows_per_range=100).collect())
    total = 0
    for _, v, s in got:
        assert s == total
        total += v
    assert layout.prefix_sums(rows.where("false"), ["k"], "v", "s").count() == 0
