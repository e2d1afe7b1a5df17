"""Reports on a corpus small enough to count by hand, and their invariants."""

import pytest

from claimloom.operators import matching as M
from claimloom.operators import reports as R
from claimloom.operators.lexicon import surface_lexicon
from claimloom.plans import analysis, console
from claimloom.settings import fixed
from claimloom.settings.lexicons import DIMENSIONS

GOLDEN = [
    # church + material + ontological: score 3; J1
    ("g1", "A", "2018-06-01", "u1", "speech", "Церква зазнала загрози учора. Духовний вимір важливий тут."),
    # gate only: score 0; J2
    ("g2", "B", "2022-03-01", "u2", "press_release", "Церква стоїть на горі довго. Томос і томос тут лежать."),
    # others only, not relevant; J2
    ("g3", "C", "2023-03-01", "u3", "rada_stenogram", "Загроза та ворог поруч стоять."),
    # no match; J3
    ("g4", "D", "2024-03-01", "u4", "speech", "Сьогодні гарна погода надворі."),
    # relevant, undated
    ("g5", "E", None, "u5", "speech", "Лавра та заборона поруч стоять."),
    # relevant, outside all periods
    ("g6", "F", "2016-03-01", "u6", "press_release", "Патріарх і воля поруч стоять."),
]
SCHEMA = "id string, title string, date string, url string, content_type string, body_text string"


@pytest.fixture(scope="module")
def golden(spark):
    docs = spark.createDataFrame(GOLDEN, SCHEMA)
    return analysis.analyse_corpus(docs, surface_lexicon())


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_claims(golden):
    found = sorted((r["doc_id"], r["category"], r["matched_surface_form"]) for r in golden.claims.collect())
    assert found == sorted(
        [
            ("g1", "church_actors", "Церква"),
            ("g1", "material_security", "загрози"),
            ("g1", "ontological_security", "Духовний"),
            ("g2", "church_actors", "Церква"),
            ("g2", "church_actors", "Томос"),
            ("g2", "church_actors", "томос"),
            ("g3", "material_security", "Загроза"),
            ("g3", "material_security", "ворог"),
            ("g5", "church_actors", "Лавра"),
            ("g5", "urgency", "заборона"),
            ("g6", "church_actors", "Патріарх"),
            ("g6", "decolonisation", "воля"),
        ]
    )
    ids = sorted(r["claim_id"] for r in golden.claims.collect())
    assert ids == list(range(1, 13))


def test_summary(golden):
    overview = golden.summary["overview"].collect()[0].asDict()
    assert overview == {
        "total_documents": 6, "total_speeches": 3, "total_press": 2, "relevant_docs": 3,
        "relevant_speeches": 2, "relevant_press": 1, "total_claims": 12, "unique_sentences": 7,
    }
    assert rows(golden.summary["claims_by_category"]) == [
        ("church_actors", 6), ("material_security", 3), ("decolonisation", 1),
        ("ontological_security", 1), ("urgency", 1),
    ]
    assert rows(golden.summary["top_terms"])[:2] == [("загроза", 2), ("томос", 2)]
    yearly = {r["year"]: r.asDict() for r in golden.summary["yearly"].collect()}
    assert set(yearly) == {"2016", "2018", "2022", "2023", "2024", "unknown"}
    assert yearly["unknown"]["relevant_speeches"] == 1
    assert yearly["2023"]["press_releases"] == 0
    periods = {r["juncture"]: (r["total_docs"], r["relevant_docs"], r["total_claims"]) for r in golden.summary["juncture"].collect()}
    assert periods == {
        "J1_autocephaly_2018-19": (1, 1, 3), "J2_invasion_2022": (2, 0, 5), "J3_law_2024": (1, 0, 0),
        "J4_enforcement_2025": (0, 0, 0), "interstitial_2019-2022": (0, 0, 0),
    }
    assert dict(rows(golden.summary["category_sets"])) == {
        "church_actors, material_security, ontological_security": 1,
        "church_actors, urgency": 1,
        "church_actors, decolonisation": 1,
    }
    text = console.summary_text(golden.summary)
    assert "CORPUS ANALYSIS SUMMARY" in text and "загроза" in text


def test_yearly_two_ways_to_count_press(golden):
    two = {r["year"]: r["press_releases"] for r in R.yearly_breakdown(golden.results, True).collect()}
    assert two["2023"] == 1


def test_scores_and_tables(golden):
    built = analysis.run_coding_analysis(golden.claims)
    scores = {r["doc_id"]: r["sec_score"] for r in built["scored"].select("doc_id", "sec_score").distinct().collect()}
    # Both security dimensions give the extra point.
    assert scores == {"g1": 3, "g2": 0, "g3": 0, "g5": 1, "g6": 1}
    assert rows(built["intensity_by_juncture"]) == [
        ("J1_autocephaly_2018-19", 1, 1, 100.0, 3.0, 3.0, 3),
        ("J2_invasion_2022", 2, 0, 0.0, 0.0, 0.0, 0),
    ]
    assert rows(built["claims_by_juncture"]) == [
        ("J1_autocephaly_2018-19", 1, 1, 1, 0, 0),
        ("J2_invasion_2022", 3, 2, 0, 0, 0),
    ]
    assert rows(built["yearly_trend"]) == [
        ("2016", 2, 1, 2), ("2018", 3, 1, 3), ("2022", 3, 1, 1), ("2023", 2, 1, 1),
    ]
    assert rows(built["category_summary"])[0] == ("church_actors", 6, 4, 4)
    assert rows(built["material_vs_ontological"]) == [("2018", 1, 1), ("2023", 2, 0)]
    matrix = {r["cat_a"]: r for r in built["cooccurrence"].collect()}
    assert list(matrix) == list(DIMENSIONS)
    assert matrix["church_actors"]["church_actors"] == 4
    assert matrix["church_actors"]["urgency"] == matrix["urgency"]["church_actors"] == 1
    assert matrix["urgency"]["decolonisation"] == 0
    top = rows(built["top_terms_by_juncture"])
    assert top[0][0] == "J1_autocephaly_2018-19"
    first = {r["doc_id"]: r for r in R.document_summary(built["scored"]).collect()}
    assert first["g1"]["n_claims"] == 3 and len(first) == 5
    assert "claims by" not in console.tables_text(built)


def test_invariants(spark, sf):
    from claimloom.catalog import base

    claims = base.study_prepared(spark, sf)
    results = base.study_results(spark, sf)
    total = claims.count()
    assert sum(r["n"] for r in R.claims_by_category(claims).collect()) == total
    assert sum(r["n_claims"] for r in R.category_summary(claims).collect()) == total
    assert sum(r["total_docs"] for r in R.yearly_breakdown(results).collect()) == results.count()
    in_periods = sum(r["total_docs"] for r in R.juncture_breakdown(results).collect())
    assert in_periods + results.where("date IS NULL").count() == results.count()
    scores = [r["sec_score"] for r in R.document_scores(claims).collect()]
    assert min(scores) >= 0 and max(scores) <= 5


def test_exports_read_back(spark, golden, tmp_path):
    from claimloom.sources import tables

    analysis.write_analysis(golden, str(tmp_path / "out"))
    claims = tables.read_claim_lines(spark, str(tmp_path / "out/claims"))
    assert claims.count() == 12
    assert tables.read_results(spark, str(tmp_path / "out/results")).count() == 6
    analysis.run_coding_analysis(claims, str(tmp_path / "tables"))
    schema = "year string, n_claims bigint, n_documents bigint, n_categories bigint"
    back = tables.read_coded_csv(spark, str(tmp_path / "tables/table_yearly_trend"), schema)
    assert sorted(rows(back))[0] == ("2016", 2, 1, 2)
    scored = spark.read.option("header", True).csv(str(tmp_path / "tables/scored_claims"))
    assert scored.columns == list(R.EXPORT_COLUMNS)


def test_listing_and_periods(golden, spark):
    listed = {r["category"]: r["description"] for r in R.category_listing(golden.claims, surface_lexicon().description_frame(spark)).collect()}
    assert listed["urgency"].startswith("Urgency")
    assert R.juncture_table(spark).count() == len(fixed.JUNCTURES)
    assert M.CLAIM_ORDER[0] == "doc_id"
