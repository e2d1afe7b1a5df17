import pytest
from pyspark.sql import functions as F

from claimloom.functions import dates as D

CASES = [
    ("2024-12-25T10:00:00+02:00", dict.fromkeys(("strict", "prefix", "article", "session", "browser"), "2024-12-25")),
    (" 25.12.2024 ", dict.fromkeys(D.VARIANTS, "2024-12-25")),
    ("25.12.2024 10:00", {"strict": None, "prefix": "2024-12-25", "browser": "2024-12-25", "scraper": None}),
    ("25. 12. 2024", {"prefix": None, "session": "2024-12-25", "browser": None}),
    ("5 січня 2023 року", dict.fromkeys(("strict", "prefix", "article", "session", "browser", "scraper"), "2023-01-05")),
    ("5 Січня 2023", {"prefix": "2023-01-05", "browser": None, "scraper": "2023-01-05"}),
    ("грудня 2024", {"prefix": None, "article": "2024-12-01"}),
    ("5 января 2023", dict.fromkeys(D.VARIANTS)),
    ("Подано 7 травня 2020 р.", {"prefix": "2020-05-07"}),
    ("25.12.2024р.", {"prefix": "2024р-12-25", "strict": None}),
    ("3 December 2021", {"scraper": "2021-12-03", "prefix": None}),
    ("31.02.2021", {"scraper": None, "prefix": "2021-02-31"}),
    ("5/6/2021", {"scraper": "2021-06-05"}),
    ("junk", dict.fromkeys(D.VARIANTS)),
    (None, dict.fromkeys(D.VARIANTS)),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_parse_date(one, text, expected):
    for variant, value in expected.items():
        assert one(D.parse_date(F.lit(text).cast("string"), variant)) == value, variant


def test_unknown_variant():
    with pytest.raises(ValueError):
        D.parse_date(F.lit("x"), "other")


def test_date_in_opening_only_for_years_in_scope(one):
    assert one(D.date_in_opening(F.lit("Київ, 3 березня 2022 року"))) == "2022-03-03"
    assert one(D.date_in_opening(F.lit("3 березня 2015, потім 04.05.2019"))) == "2019-05-04"
    assert one(D.date_in_opening(F.lit("x" * 600 + " 3 березня 2022"))) is None


def test_date_in_text_prefers_ukrainian_then_russian(one):
    def found(text):
        return one(D.date_in_text(F.lit(text)))

    assert found("Спершу 01.02.2020, далі 5 мая 2019, і 7 червня 2018") == "2018-06-07"
    assert found("Спершу 01.02.2020, далі 5 мая 2019 года") == "2019-05-05"
    assert found("Подія сталася 01.02.2020 у Києві") == "2020-02-01"
    assert found("Подія сталася 2020-02-03 у Києві") == "2020-02-03"
    assert found("5 мая 2019") is None  # too short a text


def test_first_plausible_date_skips_old_years(one):
    text = "Указ 1 травня 1995 року, засідання 12 червня 2019 року"
    assert one(D.first_plausible_date(F.lit(text))) == "2019-06-12"
    assert one(D.first_plausible_date(F.lit("від 05. 06. 2018"))) == "2018-06-05"


def test_resolve_date_priority_and_rejection(one):
    def resolved(json, mapped, body=""):
        return one(D.resolve_date(F.lit(json).cast("string"), F.lit(mapped).cast("string"), F.lit(body)))

    assert resolved("2020-01-01", "05.06.2019") == "2019-06-05"
    assert resolved("2020-01-01", "05.06.2026") == "2020-01-01"
    assert resolved("2027-01-01", "", "Київ, 7 липня 2021 року.") == "2021-07-07"
    assert resolved(None, None, "нічого") is None


def test_periods_years_and_scope(one):
    assert one(D.juncture_of(F.lit("2019-05-19"))) == "J1_autocephaly_2018-19"
    assert one(D.juncture_of(F.lit("2019-05-20"))) == "interstitial_2019-2022"
    assert one(D.juncture_of(F.lit("2017-01-01"))) is None
    assert one(D.juncture_of(F.lit("2017-01-01"), missing="unknown", outside="out")) == "out"
    assert one(D.juncture_of(F.lit(""), missing="unknown")) == "unknown"
    assert one(D.year_of(F.lit("202"), "unknown")) == "unknown"
    assert one(D.year_of(F.lit("2024-01-01"))) == "2024"
    for year, kept in [(None, True), ("NA", True), ("", True), ("2017", False), ("2018", True), ("x", False)]:
        assert one(D.in_year_scope(F.lit(year).cast("string"))) is kept
    assert one(D.unix_date(F.lit("1600000000"))) == "2020-09-13"
    assert one(D.unix_date(F.lit("12"))) is None
    assert one(D.has_date(F.lit("2020"))) is False
