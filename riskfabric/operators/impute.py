"""Tiered median imputation of income.

One grouping-sets aggregation computes the exact medians and counts for
(age, education), (education) and the whole table in a single pass; null
keys are excluded per set through ``grouping_id``.  The medians are written
and joined back; the overall one enters as a literal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from ..sources.sinks import materialised

AGE, EDUCA, INCOME = "age_code", "educa_code", "income_code"


def income_medians(df: DataFrame, min_n: int = fixed.MIN_GROUP_N_FOR_MEDIAN) -> DataFrame:
    """Medians and counts of observed income per tier, one pass (J9 input).
    Columns: tier, age_code, educa_code, median, n, usable."""
    observed = df.filter(F.col(INCOME).isNotNull())
    stats = observed.groupingSets(
        [[F.col(AGE), F.col(EDUCA)], [F.col(EDUCA)], []], AGE, EDUCA
    ).agg(F.median(INCOME).alias("median"), F.count(INCOME).alias("n"),
          F.grouping_id().alias("gid"))
    tier = (F.when(F.col("gid") == 0, F.lit(fixed.TIER_CELL))
            .when(F.col("gid") == 2, F.lit(fixed.TIER_EDUCATION))
            .otherwise(F.lit(fixed.TIER_OVERALL)))
    keys_ok = (F.when(F.col("gid") == 0, F.col(AGE).isNotNull() & F.col(EDUCA).isNotNull())
               .when(F.col("gid") == 2, F.col(EDUCA).isNotNull())
               .otherwise(F.lit(True)))
    return (stats.filter(keys_ok)
            .select(tier.alias("tier"), AGE, EDUCA, "median", "n",
                    ((F.col("n") >= min_n) | (F.col("gid") == 3)).alias("usable")))


def impute_income(df: DataFrame, min_n: int = fixed.MIN_GROUP_N_FOR_MEDIAN,
                  fit_on: DataFrame | None = None) -> DataFrame:
    """Fill missing income with the (age, education) median when that cell
    has at least ``min_n`` observed incomes, else the education median under
    the same rule, else the overall median; round half to even, clip to
    1..8.  Adds ``income_code_imputed`` (always) and ``imputation_tier``.
    ``fit_on`` computes the medians on another frame (e.g. training rows)."""
    # a row per code pair; its written size lets Spark choose the join
    usable = materialised(income_medians(fit_on if fit_on is not None else df, min_n).filter("usable"), "medians")
    cell = usable.filter(F.col("tier") == fixed.TIER_CELL).select(
        AGE, EDUCA, F.col("median").alias("_cell_median"))
    edu = usable.filter(F.col("tier") == fixed.TIER_EDUCATION).select(
        EDUCA, F.col("median").alias("_edu_median"))
    # one value
    overall_row = usable.filter(F.col("tier") == fixed.TIER_OVERALL).select("median").first()
    overall = F.lit(overall_row[0] if overall_row else None).cast("double")
    missing = F.col(INCOME).isNull()
    chosen = F.coalesce(F.col("_cell_median"), F.col("_edu_median"), overall)
    tier = (F.when(F.col("_cell_median").isNotNull(), F.lit(fixed.TIER_CELL))
            .when(F.col("_edu_median").isNotNull(), F.lit(fixed.TIER_EDUCATION))
            .otherwise(F.lit(fixed.TIER_OVERALL)))
    filled = X.clip(X.round_half_even(chosen, 0), fixed.INCOME_MIN, fixed.INCOME_MAX).cast("int")
    out_cols = [c for c in df.columns]
    joined = df.join(cell, [AGE, EDUCA], "left").join(edu, [EDUCA], "left")
    return joined.select(
        *[F.when(missing, filled).otherwise(F.col(INCOME)).alias(INCOME) if c == INCOME
          else F.col(c) for c in out_cols],
        missing.alias("income_code_imputed"),
        F.when(missing, tier).alias("imputation_tier"),
    )


def tier_usage(imputed: DataFrame) -> DataFrame:
    """How many rows each tier filled, and the share of all rows (A4).
    One aggregation; the total comes from the (at most four-row) result."""
    return tier_shares(imputed.groupBy(F.col("imputation_tier").alias("tier")).agg(
        F.count(F.lit(1)).alias("n_imputed")))


def tier_shares(counts: DataFrame) -> DataFrame:
    """``tier, n_imputed`` of every tier (null: rows that had an income) -> those that filled
    rows, with their share of all rows.  Four rows at most."""
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (counts.withColumn("_total", F.sum("n_imputed").over(everything))
            .filter(F.col("tier").isNotNull())
            .select("tier", "n_imputed",
                    (F.col("n_imputed") / F.col("_total")).alias("share_of_rows")))
