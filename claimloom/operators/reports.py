"""Aggregates over documents and claims.

Every report is a partial aggregation before its shuffle, so a category, year
or source holding most of the rows costs one small row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions.dates import juncture_of, year_of
from claimloom.settings import fixed
from claimloom.settings.lexicons import DIMENSIONS, GATE

Junctures = Mapping[str, tuple[str, str]]


def count_where(condition: Column) -> Column:
    """Number of rows where the condition is true; null counts as false."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * part / whole, digits)


def top(df: DataFrame, by: str, n: int, then: str) -> DataFrame:
    """The ``n`` largest rows; ties go by name."""
    return df.orderBy(F.desc(by), F.asc(then)).limit(n)


def top_per_group(df: DataFrame, group: str, by: str, then: str, n: int) -> DataFrame:
    """The ``n`` largest rows per group, cut inside each task first."""
    ranked = Window.partitionBy(group).orderBy(F.desc(by), F.asc(then))
    return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= n).drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per key in the given order, cut inside each task first."""
    ordered = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ordered)).where(F.col("_rank") == 1).drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_per_key(df, keys, [F.desc(c) for c in order])


# --- corpus summary ----------------------------------------------------------


def overview(results: DataFrame, claims: DataFrame) -> DataFrame:
    """One row of totals over documents and claims."""
    speech = F.col("content_type") == "speech"
    press = F.col("content_type") == "press_release"
    relevant = F.col("is_relevant")
    documents = results.agg(
        F.count("*").alias("total_documents"),
        count_where(speech).alias("total_speeches"),
        count_where(press).alias("total_press"),
        count_where(relevant).alias("relevant_docs"),
        count_where(relevant & speech).alias("relevant_speeches"),
        count_where(relevant & press).alias("relevant_press"),
        F.coalesce(F.sum("match_count"), F.lit(0)).cast("bigint").alias("total_claims"),
    )
    unique = claims.agg(F.countDistinct("sentence").alias("unique_sentences"))
    # Two single rows, put side by side by adding them up.
    both = documents.unionByName(unique, allowMissingColumns=True)
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def claims_by_category(claims: DataFrame) -> DataFrame:
    return claims.groupBy("category").agg(F.count("*").alias("n"))


def top_terms(claims: DataFrame, n: int = 30, term: str = "matched_term_lemma") -> DataFrame:
    counts = claims.groupBy(F.col(term).alias("term")).agg(F.count("*").alias("n"))
    return top(counts, "n", n, "term")


def yearly_breakdown(results: DataFrame, others_are_press: bool = False) -> DataFrame:
    """Counts per year; undated documents are the year ``unknown``.

    ``others_are_press`` counts every document that is no speech as a press
    release; by default only press releases are.
    """
    speech = F.col("content_type") == "speech"
    press = ~speech if others_are_press else F.col("content_type") == "press_release"
    relevant = F.col("is_relevant")
    return results.groupBy(year_of(F.col("date"), "unknown").alias("year")).agg(
        F.count("*").alias("total_docs"),
        count_where(speech).alias("speeches"),
        count_where(press).alias("press_releases"),
        count_where(relevant).alias("relevant_docs"),
        count_where(relevant & speech).alias("relevant_speeches"),
        count_where(relevant & press).alias("relevant_press"),
        F.sum("match_count").alias("total_claims"),
    )


def juncture_table(spark: SparkSession, junctures: Junctures = fixed.JUNCTURES) -> DataFrame:
    rows = [
        (i, name, f"{start} to {end}") for i, (name, (start, end)) in enumerate(junctures.items())
    ]
    return spark.createDataFrame(rows, "juncture_ord int, juncture string, date_range string")


def juncture_breakdown(results: DataFrame, junctures: Junctures = fixed.JUNCTURES) -> DataFrame:
    """Counts per period, periods without a document included."""
    counted = (
        results.withColumn("juncture", juncture_of(F.col("date"), junctures))
        .groupBy("juncture")
        .agg(
            F.count("*").alias("total_docs"),
            count_where(F.col("is_relevant")).alias("relevant_docs"),
            F.sum("match_count").alias("total_claims"),
        )
    )
    return (
        juncture_table(results.sparkSession, junctures)
        .join(counted, "juncture", "left")
        .na.fill(0, ["total_docs", "relevant_docs", "total_claims"])
        .select("juncture", "date_range", "total_docs", "relevant_docs", "total_claims")
    )


def category_sets(results: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent sets of dimensions among relevant documents."""
    counts = (
        results.where("is_relevant")
        .groupBy(F.array_join(F.array_sort("matched_categories"), ", ").alias("categories"))
        .agg(F.count("*").alias("n"))
    )
    return top(counts, "n", n, "categories")


# --- scoring -----------------------------------------------------------------

FLAGS = {
    "church_actors": "has_church",
    "material_security": "has_material",
    "ontological_security": "has_ontological",
    "decolonisation": "has_decolonise",
    "urgency": "has_urgency",
}


def prepared_claims(claims: DataFrame, junctures: Junctures = fixed.JUNCTURES) -> DataFrame:
    """Claims with report names, period and year."""
    return (
        claims.withColumnsRenamed(
            {
                "matched_term_lemma": "matched_term",
                "matched_term_lang": "term_lang",
                "matched_surface_form": "surface_form",
            }
        )
        .withColumn("context_before", F.coalesce("context_before", F.lit("")))
        .withColumn("context_after", F.coalesce("context_after", F.lit("")))
        .withColumn("juncture", juncture_of(F.col("doc_date"), junctures))
        .withColumn("year", year_of(F.col("doc_date")))
    )


def document_scores(claims: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Intensity score per document with claims.

    Zero without the gate dimension; otherwise one per further dimension and one
    more if both security dimensions are present.  ``keep`` names columns that
    are the same for all claims of a document.
    """
    flags = [
        F.max(F.col("category") == name).alias(flag) for name, flag in FLAGS.items()
    ]
    per_doc = claims.groupBy("doc_id").agg(
        *[F.min(c).alias(c) for c in keep],
        F.count_distinct("category").cast("int").alias("n_categories"),
        F.count("*").alias("n_claims"),
        *flags,
    )
    return with_score(per_doc)


def with_score(per_doc: DataFrame) -> DataFrame:
    others = [f for name, f in FLAGS.items() if name != GATE]
    base = sum((F.col(f).cast("int") for f in others), F.lit(0))
    bonus = (F.col("has_material") & F.col("has_ontological")).cast("int")
    any_other = F.greatest(*[F.col(f) for f in others])
    return per_doc.withColumn(
        "sec_score", F.when(F.col("has_church"), base + bonus).otherwise(F.lit(0))
    ).withColumn("is_securitising", F.col("has_church") & any_other)


def scored_claims(claims: DataFrame) -> DataFrame:
    """Document scores back on the claims."""
    return claims.join(document_scores(claims), "doc_id", "left")


def cooccurrence(claims: DataFrame) -> DataFrame:
    """Documents per pair of dimensions, zero cells and the diagonal included."""
    per_doc = claims.groupBy("doc_id").agg(
        *[F.max(F.col("category") == name).alias(name) for name in DIMENSIONS]
    )
    cells = per_doc.agg(
        *[
            F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}")
            for a in DIMENSIONS
            for b in DIMENSIONS
        ]
    )
    long = cells.unpivot([], [f"{a}|{b}" for a in DIMENSIONS for b in DIMENSIONS], "pair", "n")
    return long.select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("cat_a"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("cat_b"),
        "n",
    )


def cooccurrence_matrix(claims: DataFrame) -> DataFrame:
    """The same as a square table with the row label as first column."""
    order = F.create_map(*[x for i, c in enumerate(DIMENSIONS) for x in (F.lit(c), F.lit(i))])
    return (
        cooccurrence(claims)
        .groupBy("cat_a")
        .pivot("cat_b", list(DIMENSIONS))
        .agg(F.first("n"))
        .orderBy(order[F.col("cat_a")])
    )


# --- report tables -----------------------------------------------------------


def claims_by_juncture(claims: DataFrame, categories: Sequence[str] = DIMENSIONS) -> DataFrame:
    return (
        claims.where(F.col("juncture").isNotNull())
        .groupBy("juncture")
        .agg(*[F.count_if(F.col("category") == c).alias(c) for c in categories])
    )


def intensity_by_juncture(
    claims: DataFrame, junctures: Junctures = fixed.JUNCTURES
) -> DataFrame:
    """Score statistics per period; medians from exact per-score counts."""
    per_doc = document_scores(claims, keep=["juncture"]).where(F.col("juncture").isNotNull())
    return per_doc.groupBy("juncture").agg(
        F.count("*").alias("n_documents"),
        F.count_if("is_securitising").alias("n_securitising"),
        share(F.count_if("is_securitising"), F.count("*")).alias("pct_securitising"),
        F.round(F.avg("sec_score"), 2).alias("mean_score"),
        F.percentile("sec_score", F.lit(0.5)).alias("median_score"),
        F.max("sec_score").alias("max_score"),
    )


def top_terms_by_juncture(claims: DataFrame, n: int = 10) -> DataFrame:
    counts = (
        claims.where(F.col("juncture").isNotNull())
        .groupBy("juncture", "matched_term")
        .agg(F.count("*").alias("freq"))
    )
    return top_per_group(counts, "juncture", "freq", "matched_term", n)


def yearly_trend(claims: DataFrame) -> DataFrame:
    """Claims, documents and dimensions per year, without undated claims."""
    return (
        claims.where(F.col("year").isNotNull())
        .groupBy("year")
        .agg(
            F.count("*").alias("n_claims"),
            F.count_distinct("doc_id").alias("n_documents"),
            F.count_distinct("category").alias("n_categories"),
        )
    )


def category_summary(claims: DataFrame) -> DataFrame:
    return claims.groupBy("category").agg(
        F.count("*").alias("n_claims"),
        F.count_distinct("doc_id").alias("n_documents"),
        F.count_distinct("matched_term").alias("n_unique_terms"),
    )


def material_vs_ontological(claims: DataFrame) -> DataFrame:
    pair = ["material_security", "ontological_security"]
    return (
        claims.where(F.col("category").isin(*pair) & F.col("year").isNotNull())
        .groupBy("year")
        .agg(*[F.count_if(F.col("category") == c).alias(c) for c in pair])
    )


def build_tables(scored: DataFrame) -> dict[str, DataFrame]:
    """The seven report tables, each lazy."""
    period = _juncture_rank("juncture")
    return {
        "claims_by_juncture": claims_by_juncture(scored).orderBy(period),
        "intensity_by_juncture": intensity_by_juncture(scored).orderBy(period),
        "top_terms_by_juncture": top_terms_by_juncture(scored).orderBy(
            "juncture", F.desc("freq"), "matched_term"
        ),
        "yearly_trend": yearly_trend(scored).orderBy("year"),
        "cooccurrence": cooccurrence_matrix(scored),
        "category_summary": category_summary(scored).orderBy(F.desc("n_claims"), "category"),
        "material_vs_ontological": material_vs_ontological(scored).orderBy("year"),
    }


def _juncture_rank(column: str, junctures: Junctures = fixed.JUNCTURES) -> Column:
    names = list(junctures)
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))


EXPORT_COLUMNS = (
    "claim_id", "doc_id", "doc_title", "doc_date", "doc_url", "year", "juncture",
    "category", "matched_term", "term_lang", "surface_form", "sentence",
    "context_before", "context_after", "sec_score", "is_securitising",
    "has_church", "has_material", "has_ontological", "has_decolonise", "has_urgency",
)
DOCUMENT_COLUMNS = (
    "doc_id", "doc_title", "doc_date", "doc_url", "year", "juncture", "n_claims",
    "n_categories", "sec_score", "is_securitising", "has_church", "has_material",
    "has_ontological", "has_decolonise", "has_urgency",
)


def document_summary(scored: DataFrame) -> DataFrame:
    """One row per document: the fields of its first claim and its score."""
    return first_per_key(scored, ["doc_id"], [F.asc("claim_id")]).select(*DOCUMENT_COLUMNS)


def category_listing(claims: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Claim counts with the label of each dimension."""
    return (
        claims_by_category(claims)
        .join(F.broadcast(descriptions), "category", "left")
        .select("category", F.coalesce("description", "category").alias("description"), "n")
    )
