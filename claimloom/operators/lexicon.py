"""Turn a list of dimensions into the lookup table the matchers join with.

One row per dimension and first word (``anchor``), with the terms that can start
there.  A term of several words is an automaton over words: a state is left by a
word together with what stands before it, so the written forms of each word of a
phrase are listed once and never multiplied.  A text word is looked up once; only
where it starts a phrase are the words behind it followed, state by state.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.inflect import inflect
from claimloom.settings.lexicons import GATE, LEMMA_PROFILE, SURFACE_PROFILE, Dimension

Forms = Mapping[tuple[str, str], frozenset[str]]
Expander = Callable[[str, str], frozenset[str]]
Pieces = Callable[[str], list[tuple[str, str]]]

# A table above this size is cut into several, each joined by broadcast on its own.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

_WORD = re.compile(r"[^\W]+", re.UNICODE)


@dataclass
class Automaton:
    """A term over words.  States are numbers; an arrival is twice the state, plus one
    where a match may end.

    ``first`` maps the first word to its arrival, ``steps`` every later "state|glue|word".
    """

    first: dict[str, int]
    steps: dict[str, int]
    longest: int

    @property
    def chained(self) -> bool:
        """Whether two matches could overlap, so that the leftmost has to be chosen."""
        return any(key.rpartition("|")[2] in self.first for key in self.steps)

    @property
    def seconds(self) -> set[str] | None:
        """The words behind the first one of a match, or None where a match may have one word."""
        if any(arrival % 2 for arrival in self.first.values()):
            return None
        begun = {str(arrival // 2) for arrival in self.first.values()}
        return {key.rpartition("|")[2] for key in self.steps if key.partition("|")[0] in begun}


def automaton(words: Sequence[frozenset[str]], pieces: Pieces) -> Automaton:
    """The automaton of a term, given the forms of each of its words.

    ``pieces`` gives a form's words, each with the glue before it (the first one's does not
    count: words of a term stand apart by white space).  A position is a form begun and
    how much of it is read; the sets of positions a text can be in are the states.
    """
    forms = [sorted({tuple(pieces(form)) for form in some} - {()}) for some in words]
    if not all(forms):
        return Automaton({}, {}, 0)
    begun = [frozenset((w, f, 0) for f in range(len(forms[w]))) for w in range(len(forms))]
    numbers: dict[frozenset, int] = {begun[0]: 0}
    todo, first, steps = [begun[0]], {}, {}
    while todo:
        here = todo.pop()
        moves: dict[tuple[str, str], tuple[set, bool]] = {}
        for word, form, read in here:
            glue, token = forms[word][form][read]
            key = (glue if read else " ", token)
            to, ends = moves.get(key, (set(), False))
            if read + 1 < len(forms[word][form]):
                to.add((word, form, read + 1))
            elif word + 1 < len(forms):
                to |= begun[word + 1]
            else:
                ends = True
            moves[key] = (to, ends)
        for (glue, token), (to, ends) in sorted(moves.items(), key=lambda m: m[0]):
            target = frozenset(to)
            if target not in numbers:
                numbers[target] = len(numbers)
                todo.append(target)
            arrival = numbers[target] * 2 + ends
            if here is begun[0]:
                first[token] = arrival
            else:
                steps[f"{numbers[here]}|{glue}|{token}"] = arrival
    return Automaton(first, steps, sum(max(map(len, some)) for some in forms))


@dataclass
class Lexicon:
    """Rows of the lookup table, with what the planner needs to know."""

    matcher: str
    gate: str
    rows: list[dict] = field(default_factory=list)
    descriptions: dict[str, str] = field(default_factory=dict)
    # Terms whose own matches could overlap; rows name them by their place here.
    chained: list[Automaton] = field(default_factory=list)

    @property
    def max_words(self) -> int:
        return max((t["longest"] for row in self.rows for t in row["terms"]), default=1)

    def _row_size(self, row: dict) -> int:
        return 64 + 2 * len(row["anchor"]) + sum(
            96 + 2 * len(t["term"]) + sum(24 + 2 * len(k) for k in t["steps"] or ()) for t in row["terms"]
        )

    @property
    def size_bytes(self) -> int:
        return sum(map(self._row_size, self.rows))

    def frames(self, spark: SparkSession) -> list[DataFrame]:
        """The table in parts of a size that may be broadcast; mostly one."""
        term = pa.struct(
            [
                ("term", pa.string()),
                ("lang", pa.string()),
                ("term_ord", pa.int32()),
                ("first", pa.int32()),
                ("steps", pa.map_(pa.string(), pa.int32())),
                ("longest", pa.int32()),
                ("chained", pa.int32()),
            ]
        )
        schema = pa.schema(
            [
                ("anchor", pa.string()),
                ("category", pa.string()),
                ("cat_ord", pa.int32()),
                ("simple", pa.bool_()),
                ("anywhere", pa.bool_()),
                ("chained", pa.list_(pa.int32())),
                ("terms", pa.list_(term)),
            ]
        )
        parts: list[list[dict]] = [[]]
        held = 0
        for row in self.rows:
            size = self._row_size(row)
            if parts[-1] and held + size > BROADCAST_LIMIT_BYTES:
                parts.append([])
                held = 0
            held += size
            parts[-1].append(
                row | {"terms": [t | {"steps": None if t["steps"] is None else list(t["steps"].items())} for t in row["terms"]]}
            )
        return [F.broadcast(spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))) for rows in parts]

    def description_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(self.descriptions.items()), "category string, description string"
        )


def _term_words(
    term: str, lang: str, expand: Expander, forms: Forms | None
) -> list[frozenset[str]]:
    given = forms or {}
    return [
        given.get((lang, word)) or given.get((lang, word.lower())) or expand(word, lang)
        for word in term.split()
    ]


def _written(form: str) -> list[tuple[str, str]]:
    """The words of a form, each with what stands before it; white space is one blank."""
    found = list(_WORD.finditer(form))
    before = [""] + [form[a.end() : b.start()] for a, b in zip(found, found[1:])]
    return [(" " if glue.isspace() else glue, m.group()) for glue, m in zip(before, found)]


def _apart(form: str) -> list[tuple[str, str]]:
    """The parts of a form that stand apart by a blank."""
    return [(" ", part) for part in form.split(" ") if part]


def _collect(
    dimensions: Sequence[Dimension],
    words_of: Callable[[str, str], list[frozenset[str]]],
    pieces: Pieces,
    matcher: str,
) -> Lexicon:
    lexicon = Lexicon(matcher, dimensions[0].name)
    for cat_ord, dimension in enumerate(dimensions):
        lexicon.descriptions[dimension.name] = dimension.description
        starting: dict[str, list[dict]] = {}
        term_ord = 0
        for terms in (dimension.terms, dimension.phrases):
            for lang, listed in terms.items():
                for term in listed:
                    built = automaton(words_of(term, lang), pieces)
                    place = None
                    # Lemma sequences count by surface form, wherever they stand.
                    if built.chained and matcher == "surface":
                        place = len(lexicon.chained)
                        lexicon.chained.append(built)
                    for anchor, arrival in built.first.items():
                        entry = {
                            "term": term,
                            "lang": lang,
                            "term_ord": term_ord,
                            "first": arrival,
                            "steps": built.steps or None,
                            "longest": built.longest,
                            "chained": place,
                        }
                        known = starting.setdefault(anchor, [])
                        # A single word claimed by an earlier term keeps that term.
                        if built.longest > 1 or not any(t["longest"] == 1 for t in known):
                            known.append(entry)
                    term_ord += 1
        for anchor, found in sorted(starting.items()):
            simple = len(found) == 1 and found[0]["longest"] == 1
            # Whether a match can start here without being the leftmost of its term, and terms that need be.
            chained = [t["chained"] for t in found if t["chained"] is not None]
            anywhere = len(chained) < len(found)
            lexicon.rows.append(
                {"anchor": anchor, "category": dimension.name, "cat_ord": cat_ord, "n": max(t["longest"] for t in found), "simple": simple, "anywhere": anywhere, "chained": chained, "terms": found}
            )
    return lexicon


def surface_lexicon(
    dimensions: Sequence[Dimension] = SURFACE_PROFILE,
    expand: Expander = inflect,
    forms: Forms | None = None,
) -> Lexicon:
    """Lexicon for matching written forms: every inflection of every term."""
    return _collect(dimensions, lambda term, lang: _term_words(term, lang, expand, forms), _written, "surface")


def lemma_lexicon(
    dimensions: Sequence[Dimension] = LEMMA_PROFILE,
    expand: Expander = inflect,
    forms: Forms | None = None,
) -> Lexicon:
    """Lexicon for matching lemma sequences.

    Instead of looking up the lemma of every word of the corpus, the few lemmas
    of the lexicon are expanded to the words that have them: the same hits, and
    no dictionary-sized join against the text.
    """
    return _collect(dimensions, lambda term, lang: _term_words(term, lang, expand, forms), _apart, "lemma")


__all__ = ["GATE", "Automaton", "Lexicon", "automaton", "lemma_lexicon", "surface_lexicon"]
