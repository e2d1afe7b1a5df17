"""Reading and writing the corpus and the exports it is built from.

JSON is the interchange format (one object per file, or an array); Parquet is
the store of record.  Schemas are explicit: nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.labels import normalised_source
from claimloom.settings.fixed import SOURCES

CORPUS_SCHEMA = (
    "id string, url string, title string, date string, content_type string, source string, "
    "body_text string, word_count int, scraped_at string, updated_at string, speaker string, "
    "speaker_attribution string, date_source string, rada_id int, fetch_method string, "
    "wayback_url string"
)
ARTICLE_SCHEMA = "url string, title string, date string, body string, rada_id int, word_count int"
ENVELOPE_SCHEMA = (
    f"articles array<struct<{', '.join(f'{n}:{t}' for n, t in (p.split() for p in ARTICLE_SCHEMA.split(', ')))}>>, "
    "failed array<struct<url:string,error:string,rada_id:int>>, total_listing_urls int"
)
SPEECH_SCHEMA = "url string, title string, date string, body_text string, word_count int"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents with a text; unreadable files are left out.

    ``file_name`` gives the order of the files.
    """
    raw = (
        spark.read.schema(CORPUS_SCHEMA + ", _corrupt_record string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path, pathGlobFilter="*.json")
    )
    return (
        raw.withColumn("file_name", F.col("_metadata.file_name"))
        .where(F.col("_corrupt_record").isNull() & (F.length("body_text") > 0))
        .drop("_corrupt_record")
    )


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """Names of corpus files that hold no JSON object."""
    raw = (
        spark.read.schema("id string, _corrupt_record string")
        .option("multiLine", True)
        .json(path, pathGlobFilter="*.json")
    )
    # Spark refuses a query on the corrupt-record column alone, so the id takes part.
    no_id = F.coalesce("id", F.lit("")) == ""
    return raw.where(F.col("_corrupt_record").isNotNull() & no_id).select("_metadata.file_name")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def store(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a new version; it must not be the path that is being read."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a browser export, with their position in it."""
    raw = spark.read.schema(ENVELOPE_SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.posexplode_outer("articles").alias("seq", "_a")).where(
        F.col("_a").isNotNull()
    ).select("seq", "_a.*").drop("word_count")


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ENVELOPE_SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.inline("failed"))


def read_speeches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPEECH_SCHEMA).option("multiLine", True).json(path)


def read_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A JSON object of strings as a two-column table."""
    raw = spark.read.option("wholetext", True).text(path)
    pairs = F.from_json("value", "map<string,string>")
    return raw.select(F.explode(pairs).alias(key, value))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Link lists of a folder, with the source taken from the file names."""
    return link_lines(spark.read.text(path).select("value", "_metadata.file_name"))


def link_lines(lines: DataFrame) -> DataFrame:
    """Sloppily quoted ``url,title`` lines of ``lines(value, file_name)``.

    Lines without an address, the header among them, are dropped.
    """
    raw = lines.select(
        F.regexp_replace(
            F.regexp_replace("value", r'\\"', ""), r'^"|"$', ""
        ).alias("line"),
        "file_name",
    )
    whole = F.col("line").rlike(r"^https?://[^,]+,.*$")
    address = r'https?://[^,"\s]+'
    url = F.when(whole, F.regexp_extract("line", r"^([^,]+),", 1)).otherwise(
        F.regexp_extract("line", address, 0)
    )
    title = F.when(whole, F.regexp_replace("line", r"^[^,]+,", "")).otherwise(
        F.regexp_replace("line", r"^.*?" + address + r",?\s*", "")
    )
    stamp = r"\s*\d{2}\.\d{2}\.\d{4},?\s*\d{2}:\d{2}\s*$"
    key = F.regexp_extract("file_name", r"poroshenko_(.+)_links\.csv", 1)
    source = (
        F.when(key == "", F.lit("unknown.ua"))
        .when(key.contains("."), key)
        .otherwise(F.concat(key, F.lit(".ua")))
    )
    return raw.select(
        F.btrim(F.regexp_replace(url, '"', "")).alias("url"),
        F.regexp_replace(F.btrim(F.regexp_replace(title, '"', "")), stamp, "").alias("title"),
        normalised_source(source).alias("source"),
    ).where(F.col("url").rlike("^https?://"))


def source_catalogue(spark: SparkSession) -> DataFrame:
    """The collections a corpus is made of."""
    return spark.createDataFrame(
        list(SOURCES), "key string, label string, path string, type string, source string"
    )


def find_document(corpus: DataFrame, doc_id: str) -> DataFrame:
    return corpus.where(F.col("id") == doc_id)


def list_documents(corpus: DataFrame, n: int = 20) -> DataFrame:
    """What to offer when a document is not found."""
    return (
        corpus.select(
            "id",
            F.coalesce("date", F.lit("?")).alias("date"),
            F.substring(F.coalesce("title", F.lit("?")), 1, 55).alias("title"),
        )
        .orderBy("id")
        .limit(n)
    )
