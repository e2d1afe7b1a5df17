"""Both matchers against plain search by regular expression and by position."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from claimloom.functions.inflect import inflect, same
from claimloom.operators import lexicon as L
from claimloom.operators import matching as M
from claimloom.settings.lexicons import Dimension, LEMMA_PROFILE, SURFACE_PROFILE
from test_text import model_sentences

DOCS = [
    ("d1", "Єпархія УПЦ", "2019-01-10", "u1", "speech",
     "Голова УПЦ сказав про загрозу. Церкви та монастирі хочуть безпеки! Національна  безпека важлива. "
     "Держава-агресор має агента, і п'ята колона теж. Агент, агенти, агентура тут."),
    ("d2", None, "2022-03-01", "u2", "press_release",
     "Духовна незалежність є цінністю. Православ'я і духовний суверенітет. Києво-Печерська лавра стоїть."),
    ("d3", "t", None, "u3", "speech", "Лавра та лавра. ЛАВРА і лавра знову. Рішуча заборона негайна!"),
    ("d4", "t", "2024-05-05", "u4", "rada_stenogram", "Нічого особливого тут немає взагалі."),
    ("d5", "t", "2016-05-05", "u5", "speech", ""),
    ("d6", "t", "2025-05-05", "u6", "speech", "Церковь и враг изнутри. Агент врага. Российские путы сняты навсегда."),
]
SCHEMA = "id string, title string, date string, url string, content_type string, body_text string"


def searched(docs, dimensions, expand):
    """Regular-expression search term by term; the first term keeps a span."""
    claims = []
    for doc_id, _, _, _, _, body in docs:
        sentences = model_sentences(body)
        seen = set()
        for dimension in dimensions:
            listed = [(lang, t) for lang, terms in dimension.terms.items() for t in terms]
            for lang, term in listed:
                words = [sorted(expand(w, lang), key=len, reverse=True) for w in term.split()]
                alternatives = ["(?:" + "|".join(map(re.escape, w)) + ")" for w in words]
                regex = re.compile(r"\b" + r"\s+".join(alternatives) + r"\b", re.I)
                for i, sentence in enumerate(sentences):
                    for m in regex.finditer(sentence):
                        key = (dimension.name, i, m.start(), m.end())
                        if key not in seen:
                            seen.add(key)
                            before = sentences[i - 1] if i else ""
                            after = sentences[i + 1] if i + 1 < len(sentences) else ""
                            claims.append(
                                (doc_id, dimension.name, term, lang, m.group(), sentence, i, before, after,
                                 m.start(), m.end())
                            )
    return claims


FIELDS = (
    "doc_id", "category", "matched_term_lemma", "matched_term_lang", "matched_surface_form",
    "sentence", "sentence_index", "context_before", "context_after", "match_start", "match_end",
)


def test_surface_claims_equal_the_search(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    found = M.surface_claims(docs, L.surface_lexicon())
    mine = sorted(tuple(r[f] for f in FIELDS) for r in found.collect())
    assert mine == sorted(searched(DOCS, SURFACE_PROFILE, inflect))
    assert len(mine) > 25


def test_claims_are_numbered_in_search_order(spark):
    from claimloom.plans.layout import number_rows

    docs = spark.createDataFrame(DOCS, SCHEMA)
    lexicon = L.surface_lexicon()
    numbered = number_rows(
        M.surface_claims(docs, lexicon), M.claim_order(lexicon), "claim_id", partitions=5
    )
    rows = sorted(numbered.collect(), key=lambda r: r["claim_id"])
    assert [r["claim_id"] for r in rows] == list(range(1, len(rows) + 1))
    assert [tuple(r[f] for f in FIELDS) for r in rows] == searched(DOCS, SURFACE_PROFILE, inflect)


def test_random_texts_equal_the_search(spark):
    rng = random.Random(7)
    words = ["this", "of", "the", "That", "les", "x-les", "der", "with", "WITH", "foo_", "o'the", "ünd", "of the"]
    dimensions = (
        Dimension("church_actors", "", {"a": ("this", "of the", "the"), "b": ("THIS", "der")}, {}),
        Dimension("urgency", "", {"a": ("les", "o'the", "x-les", "with foo_"), "b": ("les",)}, {}),
    )
    docs = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", ". ", "! A ", "-", "\n", "\n\n"]) for _ in range(rng.randint(1, 60)))
        docs.append((f"r{i:03}", "t", "2020-01-01", "u", "speech", text))
    found = M.surface_claims(spark.createDataFrame(docs, SCHEMA), L.surface_lexicon(dimensions, expand=same))
    mine = sorted(tuple(r[f] for f in FIELDS) for r in found.collect())
    assert mine == sorted(searched(docs, dimensions, same))


def test_one_sentence_of_many_words(spark):
    """A text without any break is one sentence; its hits keep their offsets."""
    text = "the of the x " * 3000
    dims = (Dimension("church_actors", "", {"a": ("of the", "x")}, {}),)
    docs = spark.createDataFrame([("a", "t", None, "u", "speech", text)], SCHEMA)
    rows = M.surface_claims(docs, L.surface_lexicon(dims, expand=same)).collect()
    assert len(rows) == 6000
    assert all(text.strip()[r["match_start"] : r["match_end"]] == r["matched_surface_form"] for r in rows)


def found_and_searched(spark, texts, dimensions, expand):
    docs = [(f"d{i}", "t", None, "u", "speech", t) for i, t in enumerate(texts)]
    found = M.surface_claims(spark.createDataFrame(docs, SCHEMA), L.surface_lexicon(dimensions, expand=expand))
    mine = sorted(tuple(r[f] for f in FIELDS) for r in found.collect())
    return mine, sorted(searched(docs, dimensions, expand))


def test_overlapping_terms_are_leftmost(spark):
    """Terms that can overlap themselves are found as a left-to-right search finds them."""
    dims = (
        Dimension("c", "", {"a": ("ho ho", "day by day", "ho"), "b": ("day by", "ho ho")}, {}),
        Dimension("e", "", {"a": ("a b a b a", "b a", "by day by")}, {}),
    )
    texts = [
        "Ho ho ho ho ho said the tall man. And ho, ho ho; then ho ho.",
        "Day by day by day by day  by day and by day by night.",
        "A b a b a b a b a b a b, b a b a b a in all of it.",
        "Ho " * 700 + "day by " * 700 + "day.",
    ]
    mine, theirs = found_and_searched(spark, texts, dims, same)
    assert mine == theirs and len(mine) > 1000


def test_starts_far_apart_are_leftmost(spark):
    """Sentences of several runs of words, some without a start; terms that overlap beside others that do not."""
    words = ["ho", "Ho", "ha", "day", "by", "of", "the", "man"]
    dims = (
        Dimension("c", "", {"a": ("ho ho", "ho ho ho", "of the", "ho ha ho")}, {}),
        Dimension("e", "", {"a": ("day by day", "man", "ho ho")}, {}),
        Dimension("f", "", {"a": ("ha ho ha", "day")}, {}),
    )
    rng = random.Random(9)
    texts = ["x " * 700 + "ho ho ho " + "x " * 300 + "ho ha ho ha ho.", "x " * 255 + "ho ho x ho ho" + " x" * 255 + " ho", "Nothing is in it."]
    for _ in range(30):
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "-"]) for _ in range(rng.randint(1, 900))) + "end.")
    mine, theirs = found_and_searched(spark, texts, dims, same)
    assert mine == theirs and len(mine) > 1000
    # Without terms that match anywhere, only the words where matches start are looked up.
    chained = (Dimension("c", "", {"a": ("ho ho", "ho ho ho", "ho ha ho")}, {}), Dimension("f", "", {"a": ("ha ho ha",)}, {}))
    assert not any(row["anywhere"] for row in L.surface_lexicon(chained, expand=same).rows)
    mine, theirs = found_and_searched(spark, texts, chained, same)
    assert mine == theirs and len(mine) > 500


def test_overlapping_terms_cost_little_more_than_others(spark):
    """Only words that can start a match are walked through, not every word once a term."""
    import time

    from claimloom.catalog import base

    rng = random.Random(10)
    words = ["the", "of", "to", "in", "was", "that", *["house", "garden", "morning", "letter", "river"] * 4]
    docs = [(f"d{i}", "t", None, "u", "speech", " ".join(rng.choices(words, k=4000))) for i in range(160)]
    corpus = spark.createDataFrame(docs, SCHEMA).repartition(8).localCheckpoint()
    took = {}
    for name, lexicon in [("plain", base.study_lexicon()), ("overlapping", base.overlapping_lexicon())] * 3:
        start = time.perf_counter()
        M.surface_claims(corpus, lexicon).groupBy("category").agg(F.max("token_index")).collect()
        took[name] = min(took.get(name, 1e9), time.perf_counter() - start)
    assert took["overlapping"] < 3 * took["plain"] + 0.5, took


def test_phrases_of_four_inflected_words(spark):
    """Thirty forms a word: 120 entries, where their products would be 810,000 a term."""
    endings = ["", *[a + b for a in "aeiou" for b in "stnrl"], "x", "-ed", "-ed-ly", "'s"]
    expand = lambda word, lang: frozenset(word + e for e in endings)
    dims = (
        Dimension("c", "", {"a": ("kor mel tib san", "kor mel", "kor"), "b": ("mel kor mel kor",)}, {}),
        Dimension("e", "", {"a": ("tib",)}, {}),
    )
    lexicon = L.surface_lexicon(dims, expand=expand)
    assert len(endings) >= 30 and lexicon.size_bytes < 2_000_000
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        words = [rng.choice(["kor", "mel", "tib", "san"]) + rng.choice(endings) for _ in range(60)]
        texts.append("".join(w + rng.choice([" ", " ", "  ", " ", " ", ", ", "-"]) for w in words) + "end of it.")
    mine, theirs = found_and_searched(spark, texts, dims, expand)
    assert mine == theirs and any(len(r[4].split()) == 4 for r in mine)


def test_automaton_shares_forms():
    built = L.automaton([frozenset({"day", "day-by-night", "day-off"}), frozenset({"work"})], L._written)
    assert built.longest == 4 and len(built.steps) == 5 and not built.chained
    assert L.automaton([frozenset({"a"}), frozenset()], L._written).first == {}
    assert L.automaton([frozenset({"a", "b"}), frozenset({"b"})], L._written).chained


def test_words_behind_the_first():
    built = L.automaton([frozenset({"a", "b-c"}), frozenset({"b", "a"}), frozenset({"d"})], L._written)
    assert built.seconds == {"a", "b", "c"}
    assert L.automaton([frozenset({"a", "a-b"})], L._written).seconds is None


def test_large_lexicon_is_joined_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    lexicon = L.surface_lexicon()
    whole = sorted(tuple(r[f] or "" for f in FIELDS) for r in M.surface_claims(docs, lexicon).collect())
    monkeypatch.setattr(L, "BROADCAST_LIMIT_BYTES", lexicon.size_bytes // 3)
    found = M.surface_claims(docs, lexicon)
    assert len(lexicon.frames(spark)) > 2
    assert sorted(tuple(r[f] or "" for f in FIELDS) for r in found.collect()) == whole


def lemma_model(docs, dimensions, lemma_of):
    """Match word by word on lemmas, keep each surface form once per sentence."""
    claims = []
    token = re.compile(r"[^\W]+(?:['’ʼ\-][^\W]+)*|[^\s\w]")
    for doc_id, *_, body in docs:
        sentences = [token.findall(s) for s in _any_length(body)]
        single = [(d.name, l, t) for d in dimensions for l, ts in d.terms.items() for t in ts]
        multi = [(d.name, l, t.split()) for d in dimensions for l, ts in d.phrases.items() for t in ts]
        hits = []
        for i, tokens in enumerate(sentences):
            for t in tokens:
                hits += [(c, term, lang, t, i) for c, lang, term in single if term in lemma_of(t)]
        for c, lang, words in multi:
            for i, tokens in enumerate(sentences):
                for j in range(len(tokens) - len(words) + 1):
                    part = tokens[j : j + len(words)]
                    if all(w in lemma_of(p) for w, p in zip(words, part)):
                        hits.append((c, " ".join(words), lang, " ".join(part), i))
        seen = set()
        for c, term, lang, surface, i in hits:
            if (c, i, surface) not in seen:
                seen.add((c, i, surface))
                claims.append((doc_id, c, term, lang, surface, " ".join(sentences[i]), i + 1))
    return claims


def _any_length(text):
    from claimloom.settings import fixed

    for abbreviation in fixed.ABBREVIATIONS:
        text = text.replace(abbreviation, abbreviation.replace(".", "\x00"))
    parts = re.split(fr"(?<={fixed.SENTENCE_END})\s+(?={fixed.SENTENCE_START})", text)
    parts = [p for part in parts for p in re.split(r"\n\s*\n", part)]
    return [s for s in (p.replace("\x00", ".").strip() for p in parts) if s]


def test_lemma_claims_equal_the_model(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    words = {(lang, w) for d in LEMMA_PROFILE for group in (d.terms, d.phrases) for lang, ts in group.items() for t in ts for w in t.split()}
    lemmas = {}
    for lang, word in words:
        for form in inflect(word, lang):
            lemmas.setdefault(form, set()).add(word)
    found = M.lemma_claims(docs, L.lemma_lexicon())
    mine = sorted(
        (r["doc_id"], r["category"], r["matched_term_lemma"], r["matched_term_lang"],
         r["matched_surface_form"], r["sentence"], r["sentence_index"])
        for r in found.collect()
    )
    expected = sorted(lemma_model(DOCS, LEMMA_PROFILE, lambda t: lemmas.get(t.lower(), {t.lower()})))
    assert mine == expected
    assert any(" " in r[4] for r in mine)


def test_dictionary_forms_drive_the_lemma_lexicon(spark):
    from claimloom.sources.tables import lemma_forms

    dictionary = spark.createDataFrame(
        [("ran", "run"), ("running", "run"), ("runs", "run"), ("saw", "see"), ("run", "run")],
        "form string, lemma string",
    )
    forms = lemma_forms(dictionary, ["run", "saw"], ("en",))
    assert forms[("en", "run")] == {"ran", "running", "runs", "run"}
    # The dictionary gives "saw" another lemma, so the lemma "saw" has no form.
    dims = (Dimension("church_actors", "", {"en": ("run", "saw")}, {}),)
    lexicon = L.lemma_lexicon(dims, expand=same, forms=forms)
    docs = spark.createDataFrame([("a", "t", None, "u", "s", "He ran and saw it.")], SCHEMA)
    assert [r["matched_surface_form"] for r in M.lemma_claims(docs, lexicon).collect()] == ["ran"]


def test_document_results(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    lexicon = L.surface_lexicon()
    found = M.surface_claims(docs, lexicon)
    rows = {r["id"]: r for r in M.document_results(docs, found, lexicon).collect()}
    claims = searched(DOCS, SURFACE_PROFILE, inflect)
    for doc in DOCS:
        mine = [c for c in claims if c[0] == doc[0]]
        row = rows[doc[0]]
        cats = sorted({c[1] for c in mine})
        assert row["matched_categories"] == cats
        assert row["match_count"] == row["claim_count"] == len(mine)
        assert row["is_relevant"] == ("church_actors" in cats and len(cats) > 1)
        assert row["sentence_count"] == len(model_sentences(doc[5]))
        terms = {}
        for c in mine:
            terms.setdefault(c[1], [])
            if c[2] not in terms[c[1]]:
                terms[c[1]].append(c[2])
        assert row["matched_terms"] == terms
    assert "body_text" not in rows["d1"].asDict()


def test_forms_given_by_the_user_replace_the_rules():
    dims = (Dimension("church_actors", "", {"uk": ("церква",)}, {}),)
    lexicon = L.surface_lexicon(dims, forms={("uk", "церква"): frozenset({"церква", "церковця"})})
    assert {r["anchor"] for r in lexicon.rows} == {"церква", "церковця"}


def test_inflection_covers_regular_paradigms():
    assert {"загрози", "загрозу", "загрозою", "загроз", "загрозам", "загрозами", "загрозах"} <= inflect("загроза", "uk")
    assert {"церкви", "церкву", "церков"} <= inflect("церква", "uk")
    assert {"духовного", "духовна", "духовних"} <= inflect("духовний", "uk")
    assert {"безопасности", "безопасностью"} <= inflect("безопасность", "ru")
    assert inflect("УПЦ", "uk") == {"упц"}
    assert "держави-агресора" in inflect("держава-агресор", "uk")


def test_every_pair_of_dimensions_is_counted(spark):
    from claimloom.operators.reports import cooccurrence

    docs = spark.createDataFrame(DOCS, SCHEMA)
    cells = {(r["cat_a"], r["cat_b"]): r["n"] for r in cooccurrence(M.surface_claims(docs, L.surface_lexicon())).collect()}
    assert len(cells) == 25
    for a, b in itertools.product({k[0] for k in cells}, repeat=2):
        assert cells[a, b] == cells[b, a] <= min(cells[a, a], cells[b, b])


def test_offsets_are_linear_in_the_sentence(spark):
    """Doubling a sentence of hits only about doubles the time of its spans."""
    import time

    from claimloom.operators.lexicon import surface_lexicon
    from claimloom.operators.matching import surface_claims

    lexicon = surface_lexicon()
    word = next(r["anchor"] for r in lexicon.rows if r["n"] == 1)
    took = {}
    for n in (300, 10_000, 20_000):
        docs = spark.createDataFrame([("1", f"{word}, " * n + "x.")], "id string, body_text string")
        start = time.perf_counter()
        rows = surface_claims(docs, lexicon).select("match_start").distinct().orderBy("match_start").collect()
        took[n] = time.perf_counter() - start
        assert [r[0] for r in rows] == [k * (len(word) + 2) for k in range(n)]
    assert took[20_000] < 3 * took[10_000] + 2
