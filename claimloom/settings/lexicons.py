"""Seed-term lexicons, one per matcher.

Fixed values: the term lists below decide which claims are found, so they are
kept word for word and in their original order.  The order matters: where two
terms of one dimension hit the same words, the earlier one names the claim.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dimension:
    """One coding dimension: its label and its terms per language."""

    name: str
    description: str
    terms: dict[str, tuple[str, ...]]
    phrases: dict[str, tuple[str, ...]]


GATE = "church_actors"
DIMENSIONS = (
    "church_actors",
    "material_security",
    "ontological_security",
    "decolonisation",
    "urgency",
)
DESCRIPTIONS = {
    "church_actors": "Terms identifying the churches and religious actors",
    "material_security": "Material security / threat to the physical state",
    "ontological_security": "Ontological security / threat to the national self",
    "decolonisation": "Decolonisation and identity-restorative language",
    "urgency": "Urgency, existential intensity, exceptional measures",
}

# --- fixed values: dictionary forms for the surface matcher -----------------
_SURFACE = {
    "church_actors": {
        "uk": (
            "церква", "УПЦ", "ПЦУ", "МП", "автокефалія", "томос", "православний",
            "православ'я", "патріарх", "митрополит", "єпархія", "парафія",
            "Онуфрій", "Епіфаній", "Московський патріархат", "Константинопольський",
            "релігійний", "конфесія", "священник", "монастир", "лавра",
            "Києво-Печерська",
        ),
        "ru": (
            "церковь", "УПЦ", "ПЦУ", "МП", "автокефалия", "томос", "православный",
            "православие", "патриарх", "митрополит", "епархия", "приход",
            "Онуфрий", "Епифаний", "Московский патриархат", "Константинопольский",
            "религиозный", "конфессия", "священник", "монастырь", "лавра",
            "Киево-Печерская",
        ),
    },
    "material_security": {
        "uk": (
            "національна безпека", "загроза", "п'ята колона", "держава-агресор",
            "колабораціонізм", "колаборант", "диверсія", "шпигунство", "агент",
            "агентура", "зрада", "державна зрада", "ворог", "суверенітет",
            "територіальна цілісність", "оборона", "СБУ", "безпека", "спецслужба",
            "контррозвідка", "санкція", "підрив",
        ),
        "ru": (
            "национальная безопасность", "угроза", "пятая колонна",
            "государство-агрессор", "коллаборационизм", "коллаборант", "диверсия",
            "шпионаж", "агент", "агентура", "предательство",
            "государственная измена", "враг", "суверенитет",
            "территориальная целостность", "оборона", "СБУ", "безопасность",
            "спецслужба", "контрразведка", "санкция", "подрыв",
        ),
    },
    "ontological_security": {
        "uk": (
            "духовна незалежність", "духовна безпека", "духовний", "ідентичність",
            "Київська Русь", "самобутність", "духовний суверенітет",
            "національна ідентичність", "національна самосвідомість",
            "цивілізаційний вибір", "європейський вибір", "духовна єдність",
            "національна єдність",
        ),
        "ru": (
            "духовная независимость", "духовная безопасность", "духовный",
            "идентичность", "Киевская Русь", "самобытность",
            "духовный суверенитет", "национальная идентичность",
            "национальное самосознание", "цивилизационный выбор",
            "европейский выбор", "духовное единство", "национальное единство",
        ),
    },
    "decolonisation": {
        "uk": (
            "деколонізація", "дерусифікація", "визволення", "звільнення", "кайдани",
            "московські пута", "російські пута", "деокупація", "окупант",
            "імперський", "колоніальний", "незалежність", "воля",
        ),
        "ru": (
            "деколонизация", "дерусификация", "освобождение", "избавление", "оковы",
            "московские путы", "российские путы", "деоккупация", "оккупант",
            "имперский", "колониальный", "независимость", "воля",
        ),
    },
    "urgency": {
        "uk": (
            "заборона", "ліквідація", "позбавлення громадянства", "надзвичайний",
            "негайний", "рішучий", "невідкладний", "ворог зсередини",
            "внутрішній ворог", "заборонити", "ліквідувати", "припинити",
            "розірвати",
        ),
        "ru": (
            "запрет", "ликвидация", "лишение гражданства", "чрезвычайный",
            "немедленный", "решительный", "неотложный", "враг изнутри",
            "внутренний враг", "запретить", "ликвидировать", "прекратить",
            "разорвать",
        ),
    },
}

# --- fixed values: lemmas and lemma sequences for the lemma matcher ---------
_LEMMA_WORDS = {
    "church_actors": {
        "uk": (
            "церква", "упц", "пцу", "мп", "автокефалія", "томос", "православний",
            "православ'я", "патріарх", "митрополит", "єпархія", "парафія",
            "онуфрій", "епіфаній", "релігійний", "конфесія", "священник",
            "монастир", "лавра", "києво-печерський",
        ),
        "ru": (
            "церковь", "упц", "пцу", "мп", "автокефалия", "томос", "православный",
            "православие", "патриарх", "митрополит", "епархия", "приход",
            "онуфрий", "епифаний", "религиозный", "конфессия", "священник",
            "монастырь", "лавра", "киево-печерский",
        ),
    },
    "material_security": {
        "uk": (
            "загроза", "колабораціонізм", "колаборант", "диверсія", "шпигунство",
            "агент", "агентура", "зрада", "ворог", "суверенітет", "оборона", "сбу",
            "безпека", "спецслужба", "контррозвідка", "санкція", "підрив",
        ),
        "ru": (
            "угроза", "коллаборационизм", "коллаборант", "диверсия", "шпионаж",
            "агент", "агентура", "предательство", "враг", "суверенитет", "оборона",
            "сбу", "безопасность", "спецслужба", "контрразведка", "санкция",
            "подрыв",
        ),
    },
    "ontological_security": {
        "uk": ("духовний", "ідентичність", "самобутність", "самосвідомість"),
        "ru": ("духовный", "идентичность", "самобытность", "самосознание"),
    },
    "decolonisation": {
        "uk": (
            "деколонізація", "дерусифікація", "визволення", "звільнення", "кайдани",
            "деокупація", "окупант", "імперський", "колоніальний", "незалежність",
            "воля",
        ),
        "ru": (
            "деколонизация", "дерусификация", "освобождение", "избавление", "оковы",
            "деоккупация", "оккупант", "имперский", "колониальный", "независимость",
            "воля",
        ),
    },
    "urgency": {
        "uk": (
            "заборона", "ліквідація", "надзвичайний", "негайний", "рішучий",
            "невідкладний", "заборонити", "ліквідувати", "припинити", "розірвати",
        ),
        "ru": (
            "запрет", "ликвидация", "чрезвычайный", "немедленный", "решительный",
            "неотложный", "запретить", "ликвидировать", "прекратить", "разорвать",
        ),
    },
}

_LEMMA_PHRASES = {
    "church_actors": {
        "uk": ("московський патріархат", "константинопольський патріарх"),
        "ru": ("московский патриархат", "константинопольский патриарх"),
    },
    "material_security": {
        "uk": (
            "національний безпека", "п'ятий колона", "держава агресор",
            "державний зрада", "територіальний цілісність",
        ),
        "ru": (
            "национальный безопасность", "пятый колонна", "государство агрессор",
            "государственный измена", "территориальный целостность",
        ),
    },
    "ontological_security": {
        "uk": (
            "духовний незалежність", "духовний безпека", "київський русь",
            "духовний суверенітет", "національний ідентичність",
            "національний самосвідомість", "цивілізаційний вибір",
            "європейський вибір", "духовний єдність", "національний єдність",
        ),
        "ru": (
            "духовный независимость", "духовный безопасность", "киевский русь",
            "духовный суверенитет", "национальный идентичность",
            "национальный самосознание", "цивилизационный выбор",
            "европейский выбор", "духовный единство", "национальный единство",
        ),
    },
    "decolonisation": {
        "uk": ("московський пута", "російський пута"),
        "ru": ("московский путы", "российский путы"),
    },
    "urgency": {
        "uk": ("позбавлення громадянство", "ворог зсередини", "внутрішній ворог"),
        "ru": ("лишение гражданство", "враг изнутри", "внутренний враг"),
    },
}
# --- end of fixed values ----------------------------------------------------

SURFACE_PROFILE = tuple(
    Dimension(name, DESCRIPTIONS[name], _SURFACE[name], {}) for name in DIMENSIONS
)
LEMMA_PROFILE = tuple(
    Dimension(name, DESCRIPTIONS[name], _LEMMA_WORDS[name], _LEMMA_PHRASES[name])
    for name in DIMENSIONS
)
