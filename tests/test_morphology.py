"""Paradigms and the suffix trie, on hand-made tables."""

import pytest

from claimloom.operators import matching, morphology
from claimloom.operators.lexicon import surface_lexicon
from claimloom.settings.lexicons import SURFACE_PROFILE, Dimension

# Feminine nouns, neuter nouns and one masculine noun; the held-out words follow the first two.
FEMININE = "а и і у ою о ам ами ах".split()
NEUTER = "о а у ом і ам ами ах".split()
TABLE = (
    [("uk", stem + "а", stem + e) for stem in ("загроз", "держав", "мов") for e in FEMININE]
    + [("uk", stem + "о", stem + e) for stem in ("сел", "вікн") for e in NEUTER]
    + [("uk", "народ", "народ" + e) for e in ("", "у", "ові", "ом", "и")]
)
SCHEMA = "lang string, word string, form string"


@pytest.fixture(scope="module")
def known(spark):
    return morphology.lexemes(spark.createDataFrame(TABLE, SCHEMA))


def readings(spark, known, *words, **how):
    asked = spark.createDataFrame([("uk", w) for w in words], "lang string, word string")
    rows = morphology.analyses(asked, known, morphology.suffix_trie(known, **how), **how).collect()
    return {(r.word, r.rank): r for r in rows}


def test_stems_and_paradigms(known):
    rows = {r.word: r for r in known.collect()}
    assert rows["мова"].lemma_ending == "а" and set(rows["мова"].endings) == set(FEMININE)
    assert rows["мова"].letters == 3 and rows["мова"].endings == rows["держава"].endings
    assert rows["народ"].lemma_ending == ""


def test_held_out_words_follow_their_paradigm(spark, known):
    found = readings(spark, known, "основою", "основи", "крилом", "хребтом", "МОВАМИ")
    assert found["основою", 1].lemma == "основа" and not found["основою", 1].in_table
    assert found["основою", 1].forms == sorted("основ" + e for e in FEMININE)
    # "вами" and "ви" end other feminine nouns; the deepest node decides.
    assert found["основи", 1].lemma == "основа"
    # "лом" ends "селом" alone, "ом" also "народом".
    assert [r.lemma for (w, _), r in sorted(found.items()) if w == "крилом"] == ["крило"]
    assert [r.lemma for (w, _), r in sorted(found.items()) if w == "хребтом"] == ["хребто", "хребт"]
    assert found["мовами", 1].in_table and found["мовами", 1].lemma == "мова"


def test_ranks_by_number_of_forms_with_ties_by_name(spark, known):
    found = readings(spark, known, "рікам")
    assert [found["рікам", k].n for k in (1, 2)] == [3, 2]  # three feminine nouns, two neuter ones
    assert [found["рікам", k].lemma for k in (1, 2)] == ["ріка", "ріко"]
    assert ("рікам", 3) not in found
    assert len(readings(spark, known, "рікам", most=1)) == 1


def test_odd_words(spark, known):
    assert readings(spark, known, "q", "а", "", None, "xyz") == {}
    twice = spark.createDataFrame(TABLE + TABLE + [("uk", None, "x"), (None, "a", "b"), ("uk", "a", None)], SCHEMA)
    assert sorted(morphology.lexemes(twice).collect()) == sorted(known.collect())
    empty = known.limit(0)
    assert readings(spark, empty, "мова") == {}


def test_lemmas_of_text_words(spark, known):
    words = spark.createDataFrame([("uk", "Основи", 1), ("uk", "xyz", 2), (None, "Q", 3)], "lang string, word string, at int")
    got = morphology.lemmas(words, morphology.analyses(words, known, morphology.suffix_trie(known)))
    assert {r["at"]: r["lemma"] for r in got.collect()} == {1: "основа", 2: "xyz", 3: "q"}


def test_phrase_of_inflected_words_in_a_text(spark):
    dimension = Dimension(SURFACE_PROFILE[0].name, "", {"uk": ("основа крило",)}, {})
    table = spark.createDataFrame(TABLE, SCHEMA)
    lexicon = surface_lexicon([dimension], forms=morphology.lexicon_forms(spark, [dimension], table))
    docs = spark.createDataFrame(
        [("1", "u", "t", "2020-01-01", "speech", "s", "Під основами крилом стоїть. Основа крилу. Крило основи.")],
        "id string, url string, title string, date string, content_type string, source string, body_text string",
    )
    claims = matching.surface_claims(docs, lexicon)
    assert sorted(r.matched_surface_form for r in claims.collect()) == ["Основа крилу", "основами крилом"]


def test_a_wide_paradigm_stays_with_its_word(spark):
    # 3,000 forms of one word: with their endings, each of 8 nodes of each form would hold 3,000 strings.
    wide = [("uk", "держава", "держава" + "".join(chr(1072 + k // 30**i % 30) for i in range(3))) for k in range(3000)]
    known = morphology.lexemes(spark.createDataFrame(TABLE + wide, SCHEMA))
    trie = morphology.suffix_trie(known)
    assert {f.name for f in trie.schema} == {"lang", "node", "rank", "n", "cut", "paradigm"}
    found = readings(spark, known, "державабав", "основою", "мишабав")
    assert len(found["державабав", 1].forms) == len(found["мишабав", 1].forms) >= 3000
    assert found["мишабав", 1].lemma == "миша" and found["основою", 1].lemma == "основа"
