"""Claims, codes, coder replies and report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimloom.functions.text import strip_code_fence
from claimloom.operators.coding import RESULT_SCHEMA

CLAIM_SCHEMA = (
    "claim_id bigint, doc_id string, doc_title string, doc_date string, doc_url string, "
    "content_type string, category string, matched_term_lemma string, matched_term_lang string, "
    "matched_surface_form string, sentence string, sentence_index int, context_before string, "
    "context_after string, match_start int, match_end int"
)
RESULTS_SCHEMA = (
    "id string, url string, title string, date string, content_type string, word_count int, "
    "matched_categories array<string>, matched_terms map<string,array<string>>, "
    "match_count bigint, is_relevant boolean, sentence_count int, claim_count bigint"
)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims from JSON, one array or one object per line."""
    return spark.read.schema(CLAIM_SCHEMA).option("multiLine", True).json(path)


def read_claim_lines(spark: SparkSession, path: str) -> DataFrame:
    """Claims as ``write_json`` leaves them; splits within files are read in parallel."""
    return spark.read.schema(CLAIM_SCHEMA).json(path)


def read_results(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return spark.read.schema(RESULTS_SCHEMA).option("multiLine", not lines).json(path)


def read_coded_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Coding sheets and coded tables; ``NA`` and empty cells are null."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "NA")
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.withColumns({t: F.when(F.col(f"`{t}`") != "", F.col(f"`{t}`")) for t in texts})


def read_coder_results(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all coder result files of a folder."""
    raw = spark.read.option("wholetext", True).text(path, pathGlobFilter="*.json")
    return coder_entries(raw.select("value", F.col("_metadata.file_name").alias("batch_file")))


def coder_entries(replies: DataFrame) -> DataFrame:
    """Entries of ``replies(value, batch_file)``: a JSON array or object, fenced or
    not; unreadable replies drop out."""
    body = strip_code_fence(F.col("value"))
    as_array = F.when(body.startswith("["), body).otherwise(
        F.concat(F.lit("["), body, F.lit("]"))
    )
    entry = "array<struct<" + ",".join(
        f"{n}:{t}" for n, t in (p.split() for p in RESULT_SCHEMA.split(", "))
    ) + ">>"
    return (
        replies.select(
            "batch_file", F.posexplode_outer(F.from_json(as_array, entry)).alias("seq", "_e")
        )
        .where(F.col("_e").isNotNull())
        .select("_e.*", "batch_file", "seq")
        .where(F.to_json(F.struct("doc_id", "passage", "is_securitising")) != F.lit("{}"))
    )


def load_forms(spark: SparkSession, path: str, words: list[str]) -> dict:
    """Inflected forms of the lexicon's own words out of a forms table.

    ``path`` is a CSV of ``lang,word,form``.  Only the given words are fetched, so
    what reaches the driver is bounded by the lexicon.
    """
    table = spark.read.schema("lang string, word string, form string").option(
        "header", True
    ).csv(path)
    mine = spark.createDataFrame([(w.lower(),) for w in words], "word string")
    rows = (
        table.withColumn("word", F.lower("word"))
        .join(F.broadcast(mine), "word", "left_semi")
        .groupBy("lang", "word")
        .agg(F.collect_set(F.lower("form")).alias("forms"))
        .collect()
    )
    return {(r["lang"], r["word"]): frozenset(r["forms"]) | {r["word"]} for r in rows}


def lemma_forms(dictionary: DataFrame, words: list[str], langs: tuple[str, ...]) -> dict:
    """Words that a ``dictionary(form, lemma)`` gives one of the lexicon's lemmas.

    A lemma that the dictionary maps to something else is not its own form.
    """
    spark = dictionary.sparkSession
    wanted = spark.createDataFrame([(w.lower(),) for w in set(words)], "w string")
    lower = dictionary.select(F.lower("form").alias("form"), F.lower("lemma").alias("lemma"))
    hits = lower.join(F.broadcast(wanted), F.col("lemma") == F.col("w"), "left_semi").collect()
    own = lower.join(F.broadcast(wanted), F.col("form") == F.col("w"), "left_semi").collect()
    moved = {r["form"] for r in own if r["form"] != r["lemma"]}
    forms: dict[str, set[str]] = {w.lower(): set() for w in words}
    for r in hits:
        forms[r["lemma"]].add(r["form"])
    for word in forms:
        if word not in moved:
            forms[word].add(word)
    return {(lang, w): frozenset(f) or frozenset({"\0"}) for lang in langs for w, f in forms.items()}


def lemmatised(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Words with their lemma; a word the dictionary lacks is its own.

    The dictionary broadcasts only if its size allows.
    """
    known = dictionary.select(F.lower("form").alias("_form"), F.col("lemma").alias("_lemma"))
    joined = words.join(known, F.lower(word) == F.col("_form"), "left")
    return joined.withColumn("lemma", F.coalesce("_lemma", F.lower(word))).drop("_form", "_lemma")


# --- sinks -------------------------------------------------------------------


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, written by all tasks; no array is gathered in one place."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """CSV with header and doubled quotes; ``files=1`` for small report tables."""
    out = df.coalesce(files) if files else df
    out.write.mode(mode).option("header", True).option("escape", '"').option(
        "quoteAll", True
    ).option("nullValue", "NA").csv(path)


def write_texts(df: DataFrame, path: str, name: str | Column = "file", text: str = "text") -> None:
    """One folder per text, named by ``name``."""
    folder = F.col(name) if isinstance(name, str) else name
    df.select(folder.alias("batch"), F.col(text).alias("value")).write.partitionBy("batch").option(
        "lineSep", "\n"
    ).text(path)
