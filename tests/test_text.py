"""Text functions on hand-written texts and against plain Python models."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.settings import fixed


def model_sentences(text):
    """Protect abbreviations, split, restore: the rule in words, one step at a time."""
    for abbreviation in fixed.ABBREVIATIONS:
        text = text.replace(abbreviation, abbreviation.replace(".", "\x00"))
    parts = re.split(fr"(?<={fixed.SENTENCE_END})\s+(?={fixed.SENTENCE_START})", text)
    parts = [p for part in parts for p in re.split(r"\n\s*\n", part)]
    stripped = [p.replace("\x00", ".").strip() for p in parts]
    return [p for p in stripped if len(p) > 10]


UK = (
    "Відповідно до ст. 5 Закону. Церква є частиною народу! Це сказав проф. Іваненко «Так» "
    "Він прийшов з народом. Потім пішов\n\nНовий абзац тут. Коротко. «Цитата» Далі йде текст."
)


def test_sentences_keep_abbreviations_together(one):
    found = one(T.sentences(F.lit(UK)))
    assert found == model_sentences(UK)
    assert found[0] == "Відповідно до ст. 5 Закону."
    # An abbreviation may be the end of a longer word.
    assert any("народом. Потім" in s for s in found)


def test_strict_abbreviations_stand_alone(one):
    found = one(T.sentences(F.lit(UK), strict_abbreviations=True))
    assert not any("народом. Потім" in s for s in found)
    assert any("проф. Іваненко" in s for s in found)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.lists(
            st.sampled_from(["ст.", "м.", "Текст", "слово", ". ", "! ", '" ', "» ", "«", "\n\n", "\n", " ", "A", "т.д. ", "д.ю.н. ", "? ", "і", "Ї"]),
            max_size=30,
        ).map("".join),
        min_size=30,
        max_size=60,
    )
)
def test_sentences_agree_with_the_model(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = {r["i"]: r["s"] for r in rows.select("i", T.sentences(F.col("t")).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert found[i] == model_sentences(text), repr(text)


def test_short_pieces_are_dropped_and_empty_text_has_none(one):
    assert one(T.sentences(F.lit("Так. Ні. Добре дуже гарно."))) == ["Добре дуже гарно."]
    assert one(T.sentences(F.lit(""))) == []


def test_word_count_ignores_edges(one):
    assert one(T.word_count(F.lit("  одне  два\nтри "))) == 3
    assert one(T.word_count(F.lit(""))) == 0
    assert one(T.estimate_tokens(F.lit("a b c"))) == 10


def test_clean_body_drops_furniture_and_blank_lines(one):
    text = "Головна\n\nПерший  рядок\n25.12.2024\nПн 5\nFacebook\nДругий рядок\n\n\nПоділитися цим"
    assert one(T.clean_body(F.lit(text))) == "Перший рядок\nДругий рядок"
    assert one(T.clean_body(F.lit(None).cast("string"))) == ""


def test_relevance_counts_repeated_stems_twice(one):
    def relevant(text, title=""):
        return one(T.is_relevant(F.lit(text), F.lit(title)))

    assert relevant("один митрополит приїхав")  # listed twice: two distinct stems
    assert relevant("церква, церкви, церквою")  # three mentions
    assert not relevant("один храм стоїть")
    assert not relevant("нічого тут немає")
    assert relevant("храм стоїть", "Про УПЦ")


def test_stem_density_against_counting(one):
    stems = ("that", "hat", "ana", "with", "with")
    text = "thathat with banana hat that withwith"
    found = one(T.stem_density(F.lit(text), stems))
    assert found["n_total"] == sum(text.count(s) for s in stems)
    assert found["n_distinct"] == sum(1 for s in stems if s in text)


def test_relevant_sections(one):
    filler = [f"Речення номер {i} без теми взагалі." for i in range(300)]
    filler[50] = "Тут згадано церкву прямо."
    filler[200] = "Знову церква у тексті."
    long_text = " ".join(filler)
    found = one(T.relevant_sections(F.lit(long_text), max_words=100))
    first, second = found.split(fixed.SECTION_JOINER)
    assert first == "[...] " + " ".join(filler[45:56]) + " [...]"
    assert second == "[...] " + " ".join(filler[195:206]) + " [...]"
    assert one(T.relevant_sections(F.lit("короткий текст"), max_words=100)) == "короткий текст"
    none = " ".join(f"слово{i}" for i in range(200))
    assert one(T.relevant_sections(F.lit(none), max_words=100)) == " ".join(none.split()[:100])


def test_relevant_sections_at_the_operators_own_limit(one):
    whole = " ".join(f"слово{i}" for i in range(1200))
    assert one(T.relevant_sections(F.lit(whole))) == whole
    assert one(T.relevant_sections(F.lit(whole + " зайве"))) == whole
    named = [f"Церква згадана тут разом {i} раз." for i in range(310)]
    assert one(T.relevant_sections(F.lit(" ".join(named[:300])))) == " ".join(named[:300])  # 1,800 words
    cut = " ".join(" ".join(named).split()[:1800])
    assert one(T.relevant_sections(F.lit(" ".join(named)))) == cut + fixed.TRUNCATED_MARK


def test_relevant_sections_merges_neighbours_and_caps(one):
    many = " ".join(f"Церква згадана тут разом {i} раз." for i in range(200))
    found = one(T.relevant_sections(F.lit(many), max_words=100))
    assert found.endswith(fixed.TRUNCATED_MARK)
    assert len(found.removesuffix(fixed.TRUNCATED_MARK).split()) == 150


def test_boilerplate(one):
    def broken(text):
        return one(T.is_boilerplate(F.lit(text).cast("string")))

    assert broken(None)
    assert broken("коротко")
    menu = "Головна сторінка Контакти Карта сайту " + "ГОЛОВУЮЧИЙ. Слово має депутат. " * 200
    assert broken(menu)
    assert broken("Звичайний текст без ознак. " * 50)
    assert not broken("Звичайний текст без ознак. " * 100)
    assert not broken("ГОЛОВУЮЧИЙ. Прошу голосувати. " * 15)
    # The question mark belongs to the pattern, not to the literal marker.
    assert broken("Хто за? " * 50)


def test_speaker_detection(one):
    def speaks(url="", title="", body=""):
        return one(T.is_speech_by(F.lit(url), F.lit(title), F.lit(body)))

    assert speaks(url="https://risu.ua/Poroshenko-statement")
    assert speaks(body="Учора Порошенко заявив про томос.")
    assert speaks(body="Томос — це подія — Порошенко")
    assert speaks(title="Порошенко у Києві", body="Порошенко прибув. Порошенко вийшов.")
    assert not speaks(title="Порошенко у Києві", body="Порошенко прибув.")
    assert speaks(body="Порошенко. " * 5)
    assert not speaks(body="Порошенко. " * 4)
    assert not speaks(body="нічого")


def test_json_from_text(one):
    schema = "a int, b string"
    assert one(T.json_from_text(F.lit('{"a": 1, "b": "x"}'), schema))["a"] == 1
    assert one(T.json_from_text(F.lit('Text {"a": 2} more'), schema))["a"] == 2
    assert one(T.json_from_text(F.lit('```json\n{"a": 3}\n```'), schema))["a"] == 3
    assert one(T.json_from_text(F.lit("nothing"), schema)) is None


def test_small_helpers(one):
    assert one(T.strip_code_fence(F.lit("```json\n[1]\n```\n"))) == "[1]"
    assert one(T.tidy_whitespace(F.lit(" a\tb   c\n\n\n\nd "))) == "a b c\n\nd"
    assert one(T.truthy(F.lit("YES"))) and not one(T.truthy(F.lit("ні")))
    assert not one(T.truthy(F.lit(None).cast("string")))
    paragraphs = F.array(F.lit(" довгий абзац тут "), F.lit("ні"))
    assert one(T.paragraph_text(paragraphs, 10)) == "довгий абзац тут"
