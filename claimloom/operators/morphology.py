"""Inflected forms and lemmas of any word, learned from a table of forms.

A word of the table with its forms is a stem and a *paradigm*: the ending of its
dictionary form and those of all forms.  Which paradigm a word follows can be told
from its last letters, so all endings of all forms are filed in a suffix trie, one
row per node and paradigm, with the number of forms that stand behind it.  A word
the table lacks walks down that trie as far as it leads and follows the paradigms
most common there.

A paradigm can have thousands of endings, so it goes by its number; its endings are
fetched for the words that are asked for, never carried along with every form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.plans.layout import number_rows, written
from claimloom.settings.lexicons import Dimension

LONGEST = 8  # letters of an ending, the depth of the trie
READINGS = 3  # paradigms that a word may follow
_PARADIGM = ("lang", "lemma_ending", "endings")


def _common(a: Column, b: Column) -> Column:
    """Number of letters that two words begin with alike."""
    lengths = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.array_max(F.filter(lengths, lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))


def _after(word: Column, letters: Column) -> Column:
    return F.substring(word, letters + 1, F.length(word))


def lexemes(forms: DataFrame) -> DataFrame:
    """Words with all their forms as stem and paradigm.

    Takes `lang`, `word`, `form`; gives lang, word, forms (sorted), letters (of the
    stem), lemma_ending, endings, paradigm (numbered by language, lemma_ending and
    endings), sharing (words that follow it).  The word is a form of its own.  Case is
    ignored, rows that lack a value or repeat another teach nothing new.  The result
    is written once, since all that is learned from it reads it again.
    """
    rows = forms.select("lang", F.lower("word").alias("word"), F.lower("form").alias("form")).dropna()
    every = F.array_distinct(F.array_append(F.collect_set("form"), F.col("word")))
    whole = rows.groupBy("lang", "word").agg(F.sort_array(every).alias("forms"))
    # What the first and the last in order begin with, all between them begin with.
    whole = whole.withColumn("letters", _common(F.get("forms", F.lit(0)), F.element_at("forms", -1)))
    whole = written(
        whole.select(
            "*",
            _after(F.col("word"), F.col("letters")).alias("lemma_ending"),
            F.transform("forms", lambda f: _after(f, F.col("letters"))).alias("endings"),
        )
    )
    shared = whole.groupBy(*_PARADIGM).agg(F.count("*").alias("sharing"))
    numbered = whole.join(number_rows(shared, _PARADIGM, "paradigm"), list(_PARADIGM))
    return written(numbered.select(*whole.columns, "paradigm", "sharing"))


def suffix_trie(known: DataFrame, longest: int = LONGEST, most: int = READINGS) -> DataFrame:
    """Nodes of the trie with their `most` commonest paradigms.

    Takes `lexemes`; gives lang, node (last letters), rank, n, cut (letters that
    the form loses), paradigm.  A node holds a form's whole ending, so forms with
    endings of over `longest` letters teach nothing.
    """
    form = known.select("lang", "paradigm", "letters", F.explode("forms").alias("form"))
    form = form.withColumn("cut", F.length("form") - F.col("letters"))
    deepest = F.least(F.lit(longest), F.length("form"))
    depth = F.greatest(F.lit(1), F.col("cut"))
    nodes = form.where(depth <= deepest).select(
        "lang", "paradigm", "cut", "form", F.explode(F.sequence(depth, deepest)).alias("depth")
    )
    counted = nodes.groupBy("lang", "paradigm", "cut", F.right("form", F.col("depth")).alias("node")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang", "node").orderBy(F.desc("n"), "paradigm", "cut")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def analyses(words: DataFrame, known: DataFrame, trie: DataFrame, longest: int = LONGEST, most: int = READINGS) -> DataFrame:
    """Up to `most` readings of every word: its lemma and all forms of the lemma.

    Takes `lang`, `word`; gives lang, word (lower case), rank, n, in_table, lemma,
    forms.  A word of the table has the lexemes it is a form of: its own first, then
    by how many words share their paradigm.  Any other word has the paradigms of the
    deepest node of the trie that it ends in, with at least a letter before it, by
    number of forms.  Ties go by name.  A word that leads nowhere gives no row.
    """
    words = words.select("lang", F.lower("word").alias("word")).dropna().distinct()
    form = known.select("lang", F.explode("forms").alias("word"), F.col("word").alias("lemma"), F.col("sharing").alias("n"))
    order = Window.partitionBy("lang", "word").orderBy(F.col("lemma") != F.col("word"), F.desc("n"), "lemma")
    found = words.join(form, ["lang", "word"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    found = found.join(known.select("lang", F.col("word").alias("lemma"), "forms"), ["lang", "lemma"])

    depth = F.least(F.lit(longest), F.length("word") - 1)
    new = words.join(form, ["lang", "word"], "left_anti").where(depth >= 1)
    steps = new.select("lang", "word", F.explode(F.sequence(F.lit(1), depth)).alias("depth"))
    steps = steps.withColumn("node", F.right("word", F.col("depth")))
    deepest = F.rank().over(Window.partitionBy("lang", "word").orderBy(F.desc("depth")))
    led = steps.join(trie, ["lang", "node"]).withColumn("_place", deepest).where("_place = 1")
    followed = known.join(led.select("paradigm").distinct(), "paradigm", "left_semi")
    shape = followed.select("paradigm", "lemma_ending", "endings").dropDuplicates(["paradigm"])
    stem = F.substring("word", F.lit(1), F.length("word") - F.col("cut"))
    guessed = led.join(shape, "paradigm").select(
        "lang", "word", "rank", "n", F.lit(False).alias("in_table"),
        F.concat(stem, "lemma_ending").alias("lemma"),
        F.array_sort(F.transform("endings", lambda e: F.concat(stem, e))).alias("forms"),
    )
    return found.select("lang", "word", "rank", "n", F.lit(True).alias("in_table"), "lemma", "forms").union(guessed)


def lemmas(words: DataFrame, readings: DataFrame) -> DataFrame:
    """Words (`lang`, `word`, any more) with the lemma of the first reading, else themselves."""
    first = readings.where("rank = 1").select(
        F.col("lang").alias("_lang"), F.col("word").alias("_word"), F.col("lemma").alias("_lemma")
    )
    both = words.join(first, (F.col("lang") == F.col("_lang")) & (F.lower("word") == F.col("_word")), "left")
    return both.withColumn("lemma", F.coalesce("_lemma", F.lower("word"))).drop("_lang", "_word", "_lemma")


def lexicon_forms(spark: SparkSession, dimensions: Sequence[Dimension], forms: DataFrame, **how) -> dict:
    """Forms of every word of a lexicon, as the lexicon builders take them.

    What reaches the driver is bounded by the lexicon: at most `most` readings a word.
    """
    listed = {
        (lang, word.lower())
        for d in dimensions
        for terms in (d.terms, d.phrases)
        for lang, some in terms.items()
        for term in some
        for word in term.split()
    }
    known = lexemes(forms)
    words = spark.createDataFrame(sorted(listed), "lang string, word string")
    found: dict[tuple[str, str], set[str]] = {key: {key[1]} for key in listed}
    for row in analyses(words, known, suffix_trie(known, **how), **how).select("lang", "word", "forms").toLocalIterator():
        found[row["lang"], row["word"]].update(row["forms"])
    return {key: frozenset(some) for key, some in found.items()}
