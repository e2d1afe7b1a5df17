"""Term matching and claim extraction.

Each document row is split into sentences and each sentence into words, and the
words probe the broadcast lexicon.  Everything up to the claim table happens
inside the partition that read the document: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions import text as T
from claimloom.functions.compose import any_of, let, with_computed
from claimloom.operators.lexicon import Automaton, Lexicon
from claimloom.plans.layout import prefix_sums

Gap = Callable[[Column], Column]  # what stands before the word of a number, as a lexicon names it
Word = Callable[[Column], Column]  # the word of a number, as a lexicon names it

DOC_COLUMNS = ("id", "title", "date", "url", "content_type")
CLAIM_COLUMNS = (
    "doc_id", "doc_title", "doc_date", "doc_url", "content_type", "category",
    "matched_term_lemma", "matched_term_lang", "matched_surface_form",
    "sentence", "sentence_index", "context_before", "context_after",
)


def _with_missing(docs: DataFrame) -> DataFrame:
    absent = {c: F.lit(None).cast("string") for c in DOC_COLUMNS if c not in docs.columns}
    return docs.withColumns(absent) if absent else docs


def sentence_rows(docs: DataFrame, sentence_array: Column | None = None) -> DataFrame:
    """One row per sentence, with the document's sentence array at hand."""
    array = T.sentences(F.col("body_text")) if sentence_array is None else sentence_array
    with_array = docs.withColumn("_sents", array)
    kept = [c for c in with_array.columns if c != "body_text"]
    # The outer form keeps Spark from adding a size filter that would split the
    # text a second time.
    return with_array.select(
        *kept, F.posexplode_outer("_sents").alias("sentence_index", "sentence")
    ).where(F.col("sentence").isNotNull())


def _probe(sents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per word that starts an entry of the lexicon."""
    if lexicon.chained and not any(row["anywhere"] for row in lexicon.rows):
        # Only leftmost matches count, and where they start is known.
        at = F.array_distinct(F.flatten(F.flatten("_leftmost")))
        words = sents.select("*", F.explode_outer(at).alias("_at")).where(F.col("_at") >= 0)
        words = words.withColumn("_token", F.get("_tokens", "_at"))
    else:
        words = sents.select(
            "*", F.posexplode_outer("_tokens").alias("_at", "_token")
        ).where(F.col("_token").isNotNull())
    key = F.lower("_token") == F.col("anchor")
    probed = [words.join(part, key) for part in lexicon.frames(sents.sparkSession)]
    return reduce(DataFrame.unionAll, probed)


def _end_from(word: Word, at: Column, arrival: Column, steps: Column, longest: Column, gap: Gap) -> Column:
    """Where the longest match of a term that starts at word ``at`` ends, or null.

    The automaton reads on word by word until no step fits.
    """

    def step(seen: Column, i: Column) -> Column:
        key = F.concat_ws("|", F.shiftright(seen["on"], 1).cast("string"), gap(at + i), word(at + i))
        next_on = F.when(seen["on"] >= 0, F.coalesce(F.try_element_at(steps, key), F.lit(-1))).otherwise(F.lit(-1))

        def arrive(on: Column) -> Column:
            ends = (on >= 0) & (on % 2 == 1)
            return F.struct(on.alias("on"), F.when(ends, at + i + 1).otherwise(seen["end"]).alias("end"))

        return let(next_on, arrive)

    begin = F.struct(arrival.alias("on"), F.when(arrival % 2 == 1, at + 1).alias("end"))
    rest = F.when(longest > 1, F.sequence(F.lit(1), longest - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rest, begin, step, lambda seen: seen["end"])


def _leftmost(lexicon: Lexicon, gap: Gap) -> Column:
    """Per term whose matches could overlap: the words its leftmost matches start at.

    Only words that can start a match, by themselves and the word behind them, are walked
    through, once per sentence and term.  Words come in runs: a first pass finds which word
    is free where a run begins, a second one chooses within each run, because a fold copies
    what it has gathered at every step.  A hit looks through one run only.  Behind each
    start is its number of words, below zero.
    """
    none = F.array().cast("array<int>")

    def may_start(lower: Column, places: Column, terms: list[Automaton]) -> Column:
        first = {word for term in terms for word in term.first}
        seconds = None if any(term.seconds is None for term in terms) else {word for term in terms for word in term.seconds}

        def fits(at: Column) -> Column:
            begins = F.get(lower, at).isin(*sorted(first))
            return begins if seconds is None else begins & F.get(lower, at + 1).isin(*sorted(seconds))

        return F.filter(places, fits)

    def next_free(free: Column, m: Column) -> Column:
        return F.when(m["at"] >= free, m["end"]).otherwise(free)

    def enter(seen: Column, run: Column) -> Column:
        return F.concat(seen, F.array(F.aggregate(run, F.element_at(seen, -1), next_free)))

    def choose(seen: Column, m: Column) -> Column:
        kept = F.struct(m["end"].alias("free"), F.concat(seen["run"], F.array(m["at"], m["at"] - m["end"])).alias("run"))
        return F.when(m["at"] >= seen["free"], kept).otherwise(seen)

    def chosen(run: Column, free: Column) -> Column:
        return F.aggregate(run, F.struct(free.alias("free"), none.alias("run")), choose, lambda seen: seen["run"])

    def starts(term: Automaton, lower: Column, begun: Column) -> Column:
        first = F.create_map(*[F.lit(x) for pair in term.first.items() for x in pair])
        steps = F.create_map(*[F.lit(x) for pair in term.steps.items() for x in pair])

        def match(at: Column) -> Column:
            arrival = F.try_element_at(first, F.get(lower, at))
            end = let(arrival, lambda on: _end_from(lambda i: F.get(lower, i), at, on, steps, F.lit(term.longest), gap))
            return F.struct(at.alias("at"), end.alias("end"))

        def matches(run: Column) -> Column:
            return F.filter(F.transform(may_start(lower, run, [term]), match), lambda m: m["end"].isNotNull())

        def all_chosen(runs: Column) -> Column:
            entered = F.aggregate(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.lit(0)), enter)
            return let(entered, lambda free: F.transform(runs, lambda run, k: chosen(run, F.get(free, k))))

        return let(F.transform(begun, matches), all_chosen)

    def found(lower: Column) -> Column:
        last = F.size(lower) - 1
        runs = F.sequence(F.lit(0), F.floor(last / _RUN).cast("int"))
        begun = F.transform(
            runs, lambda k: may_start(lower, F.sequence(k * _RUN, F.least(k * _RUN + _RUN - 1, last)), lexicon.chained)
        )
        some = lambda at: F.exists(at, lambda run: F.size(run) > 0)
        return let(begun, lambda at: F.when(some(at), F.array(*[starts(term, lower, at) for term in lexicon.chained])))

    return F.when(F.size("_tokens") > 0, let(F.transform("_tokens", F.lower), found))


def _ahead(hits: DataFrame, lexicon: Lexicon, start: Column) -> DataFrame:
    """Of the sentence's arrays, what a hit needs: the few words that a term can have.

    Later steps hold many hits of a sentence at once; its arrays must not come with each.
    """
    n = F.lit(lexicon.max_words)
    few = {f"{c}_ahead": F.slice(c, F.col("_at") + 1, n) for c in ("_tokens", "_units") if c in hits.columns}
    if lexicon.chained:
        runs = [F.get(F.get("_leftmost", F.lit(k)), F.floor(F.col("_at") / _RUN).cast("int")) for k in range(len(lexicon.chained))]
        few["_chosen"] = F.array(*[-F.get(run, F.nullif(F.array_position(run, F.col("_at")).cast("int"), F.lit(0))) for run in runs])
        # A part of the probing join, in generated code: no later step sees the other hits.
        starts = [F.array_contains("chained", F.lit(k)) & F.array_contains(run, F.col("_at")) for k, run in enumerate(runs)]
        hits = hits.where(F.col("anywhere") | any_of(starts))
    return hits.withColumns({**few, "_start": start}).drop("_tokens", "_units", "_before", "_leftmost", "_lead")


def _resolve(hits: DataFrame, lexicon: Lexicon, gap: Gap) -> DataFrame:
    """The matches that start at each hit: ``_term`` with its number of words.

    Of two terms of one dimension with the same words the earlier one counts.  The
    matches are generated, not projected: as a condition of the probing join they would
    take it out of generated code, and every word would be a row with its sentence's arrays.
    """

    def match(t: Column) -> Column:
        n = _end_from(lambda i: F.lower(F.get("_tokens_ahead", i)), F.lit(0), t["first"], t["steps"], t["longest"], gap)
        if lexicon.chained:
            n = F.when(t["chained"].isNull(), n).otherwise(F.get("_chosen", t["chained"]))
        return F.struct(t["term"].alias("term"), t["lang"].alias("lang"), t["term_ord"].alias("term_ord"), n.alias("n"))

    first = F.get("terms", F.lit(0))
    alone = F.struct(first["term"].alias("term"), first["lang"].alias("lang"), first["term_ord"].alias("term_ord"), F.lit(1).alias("n"))
    if lexicon.max_words == 1:
        return hits.withColumn("_term", alone)
    if all(len(row["terms"]) == 1 for row in lexicon.rows):
        only = F.when(F.col("simple"), alone).otherwise(match(first))
        return with_computed(hits, {"_term": only}).where(F.col("_term.n").isNotNull()).drop("terms")
    found = F.filter(F.transform("terms", match), lambda m: m["n"].isNotNull())
    sizes = F.transform("_found", lambda m: m["n"])
    distinct = F.filter("_found", lambda m, i: F.array_position(sizes, m["n"]) == i + 1)
    matched = with_computed(hits, {"_found": F.when(F.col("simple"), F.array(alone)).otherwise(found)})
    return matched.withColumn("_term", F.explode(distinct)).drop("_found", "terms")


def _with_context(sents: DataFrame) -> DataFrame:
    """The neighbours of each sentence in place of the document's whole array."""
    before = F.get("_sents", F.col("sentence_index") - 1)
    after = F.get("_sents", F.col("sentence_index") + 1)
    return sents.withColumns({"_prev": F.coalesce(before, F.lit("")), "_next": F.coalesce(after, F.lit(""))}).drop("_sents")


_RUN = 256  # units whose lengths are summed ahead


def _lengths_before(units: str, glue: str) -> Column:
    """For every 256th unit of a sentence, the length of the text before it.

    One pass over the sentence; hits then add up at most one run each, so offsets
    stay linear in the length of the sentence.
    """
    runs = F.sequence(F.lit(0), F.floor((F.size(units) - 1) / _RUN).cast("int") - 1)
    lengths = F.transform(
        runs,
        lambda k: F.length(F.array_join(F.slice(units, k * _RUN + 1, F.lit(_RUN)), glue)) + len(glue),
    )
    sums = F.aggregate(
        lengths, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n))
    )
    return F.when(F.size(units) > _RUN, sums).otherwise(F.array(F.lit(0)))


def _length_before(units: str, before: str, glue: str) -> Column:
    """Length of the text before unit `_at`, the glue after each unit included."""
    run = F.floor(F.col("_at") / _RUN).cast("int")
    some = F.col("_at") - run * _RUN
    text = F.array_join(F.slice(units, run * _RUN + 1, some), glue)
    return F.get(before, run) + F.length(text) + F.when(some > 0, F.lit(len(glue))).otherwise(0)


def _claim_fields(index_base: int) -> list[Column]:
    return [
        F.col("id").alias("doc_id"),
        F.col("title").alias("doc_title"),
        F.col("date").alias("doc_date"),
        F.col("url").alias("doc_url"),
        F.col("content_type"),
        F.col("category"),
        F.col("_term.term").alias("matched_term_lemma"),
        F.col("_term.lang").alias("matched_term_lang"),
        F.col("_surface").alias("matched_surface_form"),
        F.col("sentence"),
        (F.col("sentence_index") + index_base).alias("sentence_index"),
        F.col("_prev").alias("context_before"),
        F.col("_next").alias("context_after"),
    ]


def surface_claims(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Claims for every written form of a term.

    Spans are offsets within the sentence.  Where two terms of one dimension
    cover the same span, the earlier one counts.  Of a term's own matches that
    overlap, the leftmost counts, and of those that start together the longest.
    """
    if lexicon.matcher != "surface":
        raise ValueError("surface_claims needs a surface lexicon")
    # Per sentence, once: its words, each word with the gap after it, and the
    # length of what stands before the first word.
    other = r"[^\p{L}\p{N}_]*"
    sents = _with_context(sentence_rows(_with_missing(docs))).withColumns(
        {
            "_tokens": F.regexp_extract_all("sentence", F.lit(T.WORD), F.lit(0)),
            "_units": F.regexp_extract_all("sentence", F.lit(T.WORD + other), F.lit(0)),
            "_lead": F.length(F.regexp_extract("sentence", "^" + other, 0)),
        }
    )
    def gap_in(tokens: str, units: str) -> Gap:
        def gap(i: Column) -> Column:
            before = F.get(units, i - 1)
            between = F.substring(before, F.length(F.get(tokens, i - 1)) + 1, F.length(before))
            return let(between, lambda b: F.when((b != " ") & b.rlike(r"(?U)^\s+$"), F.lit(" ")).otherwise(b))

        return gap

    sents = sents.withColumn("_before", _lengths_before("_units", ""))
    if lexicon.chained:
        sents = sents.withColumn("_leftmost", _leftmost(lexicon, gap_in("_tokens", "_units")))
    hits = _ahead(_probe(sents, lexicon), lexicon, F.col("_lead") + _length_before("_units", "_before", ""))
    matched = _resolve(hits, lexicon, gap_in("_tokens_ahead", "_units_ahead"))
    n = F.col("_term.n")
    whole = F.concat(F.array_join(F.slice("_units_ahead", F.lit(1), n - 1), ""), F.get("_tokens_ahead", n - 1))
    surface = F.when(n == 1, F.col("_token")).otherwise(whole)
    return (
        matched.withColumn("_surface", surface)
        .select(
            *_claim_fields(0),
            F.col("_start").alias("match_start"),
            (F.col("_start") + F.length("_surface")).alias("match_end"),
            "cat_ord",
            F.col("_term.term_ord").alias("term_ord"),
            F.col("_at").alias("token_index"),
            # Terms are searched in configured order.
            F.struct(
                F.lit(0).alias("pass"),
                F.col("_term.term_ord").alias("a"),
                F.lit(0).alias("b"),
            ).alias("seen_at"),
        )
    )


def lemma_claims(docs: DataFrame, lexicon: Lexicon, index_base: int = 1) -> DataFrame:
    """Claims for every lemma or lemma sequence.

    Sentences are rebuilt as words joined by blanks, and a surface form counts
    once per sentence and dimension.
    """
    if lexicon.matcher != "lemma":
        raise ValueError("lemma_claims needs a lemma lexicon")
    rebuilt = F.transform(
        T.sentences(F.col("body_text"), min_chars=0),
        lambda s: F.array_join(
            F.regexp_extract_all(s, F.lit(T.ANNOTATED_TOKEN), F.lit(0)), " "
        ),
    )
    sents = _with_context(sentence_rows(_with_missing(docs), rebuilt))
    sents = sents.withColumn("_tokens", F.split("sentence", " "))
    sents = sents.withColumn("_before", _lengths_before("_tokens", " "))
    hits = _ahead(_probe(sents, lexicon), lexicon, _length_before("_tokens", "_before", " ") + 1)
    matched = _resolve(hits, lexicon, lambda i: F.lit(" "))
    matched = matched.withColumn("_surface", F.array_join(F.slice("_tokens_ahead", F.lit(1), F.col("_term.n")), " "))
    # Only the first occurrence of a surface form in its sentence counts.
    padded = F.concat(F.lit(" "), F.col("sentence"), F.lit(" "))
    first = F.instr(padded, F.concat(F.lit(" "), F.col("_surface"), F.lit(" ")))
    phrase = (F.col("_term.n") > 1).cast("int")
    return matched.where(first == F.col("_start")).select(
        *_claim_fields(index_base),
        "cat_ord",
        F.col("_term.term_ord").alias("term_ord"),
        F.col("_at").alias("token_index"),
        # Single words come first in text order, then phrases term by term.
        F.struct(
            phrase.alias("pass"),
            F.when(phrase == 0, F.col("sentence_index"))
            .otherwise(F.col("cat_ord"))
            .alias("a"),
            F.when(phrase == 0, F.col("_at")).otherwise(F.col("_term.term_ord")).alias("b"),
            F.when(phrase == 0, F.lit(0)).otherwise(F.col("sentence_index")).alias("c"),
        ).alias("seen_at"),
    )


def claims(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Claims with the matcher the lexicon was built for."""
    found = surface_claims if lexicon.matcher == "surface" else lemma_claims
    return found(docs, lexicon)


CLAIM_ORDER = ("doc_id", "cat_ord", "term_ord", "sentence_index", "token_index")


def claim_order(lexicon: Lexicon) -> list[str]:
    """Columns that put claims into the order in which they are numbered."""
    if lexicon.matcher == "surface":
        return list(CLAIM_ORDER)
    return ["doc_id", "seen_at", "cat_ord", "term_ord", "sentence_index", "token_index"]


def claim_numbers(found: DataFrame, lexicon: Lexicon, name: str = "claim_id") -> DataFrame:
    """Claims numbered 1..N over the whole corpus, in the order in which they are found.

    A claim's number is its place in its document plus the number of claims of all
    documents before: the places need one exchange by document, the sums one row per
    document.  Give it the columns that are wanted; it orders by those of
    ``claim_order``, and nothing else is exchanged.
    """
    within = [c for c in claim_order(lexicon) if c != "doc_id"]
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*within))
    per_doc = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    before = prefix_sums(per_doc, ["doc_id"], "_n", "_earlier").select(F.col("doc_id").alias("_doc"), "_earlier")
    numbered = found.withColumn("_place", place).join(before, F.col("doc_id").eqNullSafe(F.col("_doc")))
    return numbered.withColumn(name, F.col("_earlier") + F.col("_place")).drop("_doc", "_earlier", "_place")


def document_results(docs: DataFrame, found: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per document: its dimensions, terms, counts and relevance flag.

    Two levels of aggregation: first per term, which bounds what is collected
    by the size of the lexicon however many claims a document has.
    """
    per_term = found.groupBy("doc_id", "category", "cat_ord", "matched_term_lemma").agg(
        F.min("seen_at").alias("seen_at"), F.count("*").alias("n")
    )
    entry = F.struct("cat_ord", "category", "seen_at", "matched_term_lemma")
    per_doc = per_term.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(entry)).alias("_entries"),
        F.sum("n").alias("match_count"),
    )
    ordered = F.col("_entries")
    names = F.array_sort(F.array_distinct(F.transform(ordered, lambda e: e["category"])))
    in_order = F.array_distinct(F.transform(ordered, lambda e: e["category"]))
    terms = F.map_from_entries(
        F.transform(
            in_order,
            lambda c: F.struct(
                c.alias("key"),
                F.transform(
                    F.filter(ordered, lambda e: e["category"] == c),
                    lambda e: e["matched_term_lemma"],
                ).alias("value"),
            ),
        )
    )
    per_doc = per_doc.select(
        F.col("doc_id").alias("id"),
        names.alias("matched_categories"),
        terms.alias("matched_terms"),
        "match_count",
    )
    min_chars = 10 if lexicon.matcher == "surface" else 0
    slim = docs.withColumn(
        "sentence_count", F.size(T.sentences(F.col("body_text"), min_chars=min_chars))
    ).drop("body_text", "body_html")
    joined = slim.join(per_doc, "id", "left")
    categories = F.coalesce("matched_categories", F.array().cast("array<string>"))
    return (
        joined.withColumn("matched_categories", categories)
        .withColumn(
            "matched_terms",
            F.coalesce("matched_terms", F.create_map().cast("map<string,array<string>>")),
        )
        .withColumn("match_count", F.coalesce("match_count", F.lit(0)).cast("bigint"))
        .withColumn("claim_count", F.col("match_count"))
        .withColumn("is_relevant", is_relevant(F.col("matched_categories"), lexicon.gate))
    )


def is_relevant(categories: Column, gate: str) -> Column:
    """The gate dimension and at least one other."""
    others = F.array_except(categories, F.array(F.lit(gate)))
    return F.array_contains(categories, gate) & (F.size(others) > 0)
