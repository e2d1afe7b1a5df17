"""Agreement between two coders: confusion counts, precision, kappa."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.labels import kappa_band
from claimloom.operators.reports import count_where
from claimloom.settings import fixed


def binary_agreement(
    coded: DataFrame,
    machine: str = "is_securitising",
    human: str = "human_is_securitising",
) -> DataFrame:
    """Confusion counts, precision, recall, F1 and kappa in one pass.

    Rows without a human code are left out; rows without a machine code stay in
    the denominators and agree with nothing.
    """
    rows = coded.where(F.col(human).isNotNull())
    m, h = F.col(machine), F.col(human)
    counts = rows.agg(
        F.count("*").alias("n"),
        count_where(m & h).alias("tp"),
        count_where(m & ~h).alias("fp"),
        count_where(~m & h).alias("fn"),
        count_where(~m & ~h).alias("tn"),
    )
    tp, fp, fn, tn, n = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn", "n"))
    precision = F.when(tp + fp > 0, tp / (tp + fp))
    recall = F.when(tp + fn > 0, tp / (tp + fn))
    expected = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return (
        counts.withColumn("agreement", F.when(n > 0, (tp + tn) / n))
        .withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1",
            F.when(
                F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
            ),
        )
        .withColumn(
            "kappa",
            F.when(
                n > 0,
                F.when(expected < 1, ((tp + tn) / n - expected) / (1 - expected)).otherwise(1.0),
            ),
        )
    )


def category_agreement(coded: DataFrame) -> DataFrame:
    """Agreement on the dimension and, where both say yes, on the type."""
    rows = coded.where(F.col("human_is_securitising").isNotNull())
    both = F.col("is_securitising") & F.col("human_is_securitising")
    return rows.agg(
        F.count("*").alias("n"),
        count_where(F.col("category_correct") == F.col("human_category_correct")).alias(
            "category_agree"
        ),
        count_where(both).alias("both_securitising"),
        count_where(
            both & (F.col("securitisation_type") == F.col("human_securitisation_type"))
        ).alias("type_agree"),
    )


def confidence_calibration(coded: DataFrame) -> DataFrame:
    """Share of agreement at each confidence level from 1 to 3."""
    rows = coded.where(
        F.col("human_is_securitising").isNotNull() & F.col("confidence").between(1, 3)
    )
    agree = count_where(F.col("is_securitising") == F.col("human_is_securitising"))
    return rows.groupBy("confidence").agg(
        F.count("*").alias("n"),
        F.round(100.0 * agree / F.count("*"), 1).alias("pct_agreement"),
    )


def disagreements(coded: DataFrame) -> DataFrame:
    return coded.where(F.col("is_securitising") != F.col("human_is_securitising"))


def joined_codes(manual: DataFrame, key: DataFrame) -> DataFrame:
    """Coding sheet and answer key side by side; clashing names get ``.llm``."""
    clashing = [c for c in key.columns if c in manual.columns and c != "sample_id"]
    renamed = key.withColumnsRenamed({c: f"{c}.llm" for c in clashing})
    return manual.join(renamed, "sample_id")


def normalised(value: Column) -> Column:
    return F.lower(F.btrim(value.cast("string"), F.lit(" \t\r\n")))


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cross-tabulation in long form."""
    return pairs.groupBy(a, b).agg(F.count("*").alias("n"))


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Unweighted kappa of two coders with its z and two-sided p value.

    Rows that lack either code are left out.  The statistics come from the
    table of code pairs, which is as small as the code list squared.
    """
    cells = confusion(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    coded = cells.select(
        F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), "n"
    )
    same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
    by_code = (
        coded.select(
            F.col("a").alias("code"), F.col("n").alias("n_a"), F.lit(0).alias("n_b"), same.alias("same")
        )
        .unionAll(coded.select("b", F.lit(0), "n", F.lit(0)))
        .groupBy("code")
        .agg(*[F.sum(c).cast("double").alias(c) for c in ("n_a", "n_b", "same")])
    )
    margins = by_code.agg(
        F.sum("n_a").alias("total"),
        F.sum("same").alias("same"),
        F.sum(F.col("n_a") * F.col("n_b")).alias("s1"),
        F.sum(F.col("n_a") * F.col("n_b") * (F.col("n_a") + F.col("n_b"))).alias("s2"),
        F.count("*").alias("n_codes"),
    )
    t = F.col("total")
    po = F.col("same") / t
    pe = F.col("s1") / (t * t)
    variance = (pe + pe * pe - F.col("s2") / (t * t * t)) / (t * (1 - pe) * (1 - pe))
    stats = margins.select(
        t.cast("bigint").alias("n"),
        F.col("n_codes"),
        po.alias("agreement"),
        F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"),
        F.when(pe < 1, variance).alias("_var"),
    )
    z = F.when(F.col("_var") > 0, F.col("kappa") / F.sqrt("_var"))
    return (
        stats.withColumn("z", z)
        .withColumn("p_value", two_sided_p(F.col("z")))
        .withColumn("band", F.when(F.col("kappa").isNotNull(), kappa_band(F.col("kappa"))))
        .drop("_var")
    )


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p value, erfc(|z| / sqrt 2).

    Rational approximation 7.1.26 of Abramowitz and Stegun; absolute error
    below 1.5e-7, under the four digits that are reported.
    """
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (
        0.254829592
        + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))
    )
    return poly * F.exp(-x * x)


def reliability(
    manual: DataFrame, key: DataFrame, variables: Sequence[str] = fixed.CODE_COLUMNS[:3]
) -> DataFrame:
    """Kappa per variable: the binary code over all rows, the others where both
    coders say securitising, provided there are at least five such rows."""
    merged = joined_codes(manual, key)
    merged = merged.withColumns(
        {
            "manual_sec": normalised(F.col("manual_is_securitising")) == "true",
            "llm_sec": normalised(F.col("llm_is_securitising")) == "true",
        }
    )
    report = cohen_kappa(merged, "manual_sec", "llm_sec").withColumn(
        "variable", F.lit("is_securitising")
    )
    both = merged.where(F.col("manual_sec") & F.col("llm_sec"))
    for variable in variables:
        pairs = both.select(
            normalised(F.col(f"manual_{variable}")).alias("manual"),
            normalised(F.col(f"llm_{variable}")).alias("machine"),
        )
        one = cohen_kappa(pairs, "manual", "machine").withColumn("variable", F.lit(variable))
        report = report.unionByName(one.where((F.col("n") >= 5) & (F.col("n_codes") > 1)))
    return report.select("variable", "n", "kappa", "z", "p_value", "agreement", "band")
