"""Rule-based inflection of dictionary forms, used to build a lexicon.

No morphological model is bundled.  These suffix rules cover the regular
Ukrainian and Russian paradigms; a table of forms given to the lexicon builder
replaces them word by word (see ``claimloom.sources.tables.load_forms``).
The rules run on the driver over the few hundred words of a lexicon.
"""

from __future__ import annotations

# Per language: ending of the dictionary form -> endings of the inflected forms.
# The longest ending that fits is used; "-" is the bare stem.
RULES: dict[str, dict[str, str]] = {
    "uk": {
        "ість": "ість ості істю остей остям остями остях",
        "ія": "ія ії ію ією іє ій іям іями іях",
        "ення": "ення енню енням ені ень енням еннями еннях",
        "лля": "лля ллю ллям лль ллями ллях",
        "ський": "ський ського ському ським ськім ська ської ській ську ською ське ські ських ськими",
        "ьний": "ьний ьного ьному ьним ьнім ьна ьної ьній ьну ьною ьне ьні ьних ьними",
        "ий": "ий ого ому им ім а ої ій у ою е і их ими",
        "ій": "ій ія ію ієві ієм ії іїв іям іями іях",
        "ька": "ька ької ьку ькою ькій ьці ько ьок ькам ьками ьках",
        "ква": "ква кви кві кву квою кво ков квам квами квах",
        "ка": "ка ки ці ку кою ко ок кам ками ках",
        "га": "га ги зі гу гою го г гам гами гах",
        "на": "на ни ні ну ною но н нам нами нах ної ній",
        "а": "а и і у ою о - ам ами ах ої ій ів",
        "я": "я і ю ею є е й ь ям ями ях",
        "ни": "ни нів нам ними нами нах",
        "о": "о а у ом і - ам ами ах",
        "ити": "ити ить ив ила ило или имо ите ять иш лю ю ено ений ена ені",
        "вати": "вати ує ував увала увало ували уємо уєте ують уєш ую овано ований увати",
        "ати": "ати е ав ала ало али емо ете уть еш у ано",
        "": "- а у ові ом і е и ів ам ами ах",
    },
    "ru": {
        "ость": "ость ости остью остей остям остями остях",
        "ия": "ия ии ию ией ий иям иями иях",
        "ие": "ие ия ию ием ии ий иям иями иях",
        "ский": "ский ского скому ским ском ская ской скую ское ские ских скими",
        "ий": "ий ия ию ием ии иев иям иями иях",
        "ый": "ый ого ому ым ом ая ой ую ое ые ых ыми",
        "ая": "ая ой ую ою ое ые ых ым ыми",
        "ое": "ое ого ому ым ом ая ой ые ых ыми",
        "овь": "овь ви овью вей вам вами вах",
        "ырь": "ырь ыря ырю ырем ырём ыре ыри ырей ырям ырями ырях",
        "ка": "ка ки ке ку кой кою ок кам ками ках",
        "га": "га ги ге гу гой гою г гам гами гах",
        "а": "а ы и е у ой ою - ам ами ах",
        "я": "я и е ю ей ею ь ям ями ях",
        "ство": "ство ства ству ством стве ств ствам ствами ствах",
        "о": "о а у ом е - ам ами ах",
        "ы": "ы ов ам ами ах",
        "ить": "ить ит ил ила ило или им ите ят ишь лю ю ен ено",
        "овать": "овать ует овал овала овало овали уем уете уют уешь ую ован",
        "ать": "ать ет ал ала ало али ем ете ут ешь у ан",
        "": "- а у ом е ы и ов ам ами ах",
    },
}
INVARIABLE = frozenset({"зсередини", "изнутри", "мп", "упц", "пцу", "сбу"})
_FIRST_HALF_FIXED = frozenset({"києво", "киево"})


def inflect(word: str, lang: str) -> frozenset[str]:
    """All lower-case forms of a word, its own form among them.

    Parts of a hyphenated word are inflected each; capitals-only abbreviations
    and listed adverbs have one form.
    """
    lowered = word.lower()
    if "-" in lowered:
        left, right = lowered.split("-", 1)
        lefts = {left} if left in _FIRST_HALF_FIXED else inflect(left, lang)
        return frozenset(f"{a}-{b}" for a in lefts for b in inflect(right, lang))
    if lowered in INVARIABLE or (word.isupper() and len(word) <= 4) or lang not in RULES:
        return frozenset({lowered})
    rules = RULES[lang]
    ending = max((e for e in rules if e and lowered.endswith(e)), key=len, default="")
    stem = lowered[: len(lowered) - len(ending)] if ending else lowered
    forms = {stem + suffix.strip("-") for suffix in rules[ending].split()}
    return frozenset(forms | {lowered})


def same(word: str, lang: str) -> frozenset[str]:
    """No inflection: a word stands for itself."""
    return frozenset({word.lower()})
