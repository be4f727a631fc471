"""Data-quality reports (A5-A7): missingness per column, the worst-column
rules, and the attrition ledger.  Each is made from one row of counts, which
is an aggregation of the table or was observed while the table was written."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def missingness(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Nulls and percent missing per column, most missing first (A5).
    Columns: column_name, n_missing, pct_missing, n_rows."""
    cols = list(columns)
    return missing_report(df.agg(*missing_counts(cols)), cols)


def missing_counts(cols: list[str]) -> list[Column]:
    """The counts that ``missing_report`` reads: rows (``_n``) and nulls per column."""
    return [F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]]


def missing_report(one: DataFrame, cols: list[str]) -> DataFrame:
    """One row of ``missing_counts`` -> the report's rows."""
    long = one.unpivot("_n", cols, "column_name", "n_missing")
    return long.select(
        "column_name", "n_missing",
        (F.col("n_missing").cast("double") * 100 / F.col("_n")).alias("pct_missing"),
        F.col("_n").alias("n_rows"),
    ).orderBy(F.desc("n_missing"), "column_name")


def worst_column_checks(report: DataFrame) -> DataFrame:
    """The warning rules over a missingness report (A6), on percentages of one
    decimal: one column over 25 % and more than twice the next one (an outcome
    coding bug), one column over 30 % (it drives the attrition alone).  The
    report has one row per column, so this runs on a handful of rows."""
    pct = F.bround("pct_missing", 1)
    ranked = report.select("column_name", pct.alias("pct")).agg(
        F.max_by("column_name", F.struct("pct", F.col("column_name"))).alias("worst_column"),
        F.max("pct").alias("worst_pct"),
        F.collect_list("pct").alias("_all"),
    )
    second = F.coalesce(F.try_element_at(F.sort_array("_all", asc=False), F.lit(2)), F.lit(0.0))
    return ranked.select(
        "worst_column", "worst_pct", second.alias("next_pct"),
        ((F.col("worst_pct") > 25) & (F.col("worst_pct") > second * 2)).alias("outcome_coding_warning"),
        (F.col("worst_pct") > 30).alias("dominant_column_warning"),
    )


def ledger_from_counts(one: DataFrame, steps: list[str]) -> DataFrame:
    """A one-row table of counts (_start, _s0, _s1, ...) -> ledger rows."""
    names = ["_start"] + [f"_s{i}" for i in range(len(steps))]
    rows = []
    for i, step in enumerate(steps):
        rows.append(F.struct(F.lit(i + 1).alias("step_no"), F.lit(step).alias("step"),
                             F.col(names[i]).alias("rows_before"),
                             F.col(names[i + 1]).alias("rows_after")))
    long = one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    pct = F.when(F.col("rows_before") > 0,
                 (F.col("rows_before") - F.col("rows_after")).cast("double") * 100
                 / F.col("rows_before")).otherwise(F.lit(0.0))
    return long.withColumn("pct_lost", pct).withColumn(
        "warn", F.col("pct_lost") > F.lit(15))

