"""Survey recodes (P1-P14): sentinel codes to null, answer codes to binary
outcomes, range checks, and listwise deletion on outcomes.

Every rule is one column expression, so the whole cleaning step is a single
projection over the scan (plus one filter), fused into one codegen stage.
Rules whose raw column is absent are skipped with a warning, as in the
modelled system.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed

log = logging.getLogger(__name__)

# raw column -> (output column, rule)
_COVARIATE_RULES = [
    ("income_raw", "income_code", lambda c: X.null_if_in(c, fixed.INCOME_INVALID)),
    ("age_raw", "age_code", lambda c: X.null_if_in(c, fixed.AGE_INVALID)),
    ("race_raw", "race_code", lambda c: X.null_if_in(c, fixed.SINGLE_NINE)),
    ("educa_raw", "educa_code", lambda c: X.null_if_in(c, fixed.SINGLE_NINE)),
    ("sex_raw", "sex_code", lambda c: X.keep_if_in(c, fixed.SEX_VALID)),
    ("metro_raw", "metro_code", lambda c: X.keep_if_in(c, fixed.METRO_VALID)),
    ("smoker_raw", "smoker_code", lambda c: X.null_if_in(c, fixed.SINGLE_NINE)),
    ("activity_raw", "physical_activity_code", lambda c: X.null_if_in(c, fixed.SINGLE_NINE)),
    ("genhlth_raw", "general_health_code", lambda c: X.null_if_in(c, fixed.DK_REFUSED)),
    ("drinking_raw", "heavy_drinking_code", lambda c: X.null_if_in(c, fixed.SINGLE_NINE)),
]

# raw column -> (outcome, rule, the raw codes for which the outcome is set)
_TARGET_RULES = [
    ("diabetes_raw", "target_diabetes", X.four_code_binary, fixed.DIABETES_VALID),
    ("stroke_raw", "target_stroke", X.two_code_binary, [1, 2]),
    ("cancer_raw", "target_cancer", X.two_code_binary, [1, 2]),
    ("michd_raw", "target_cardio", X.two_code_binary, [1, 2]),
]


def state_abbr(state_fips: str | Column = "state_fips") -> Column:
    """FIPS code to state abbreviation, unmapped codes to null (P1).  The
    54-entry table travels as a map literal inside the projection."""
    return X.literal_lookup(F.col(state_fips).cast("int") if isinstance(state_fips, str)
                            else state_fips.cast("int"), fixed.STATE_FIPS_TO_ABBR)


def recode_columns(columns: Iterable[str]) -> list[Column]:
    """All cleaning rules that apply to the given raw columns, as output
    expressions in a fixed order (P1-P9)."""
    cols = set(columns)
    out: list[Column] = []
    if "resp_id" in cols:
        out.append(F.col("resp_id"))
    if "state_fips" in cols:
        out.append(state_abbr("state_fips").alias("stateabbr"))
    else:
        log.warning("no state_fips: rows get no stateabbr")
    for raw, name, rule, _ in _TARGET_RULES:
        if raw in cols:
            out.append(rule(F.col(raw)).cast("int").alias(name))
        else:
            log.warning("without %s there is no %s", raw, name)
    if "asthma_raw" in cols and "copd_raw" in cols:
        out.append(X.either_target("asthma_raw", "copd_raw").cast("int")
                   .alias("target_chronic_respiratory"))
    else:
        log.warning("target_chronic_respiratory needs both asthma_raw and copd_raw")
    for raw, name, rule in _COVARIATE_RULES:
        if raw in cols:
            out.append(rule(F.col(raw)).cast("int").alias(name))
    if "bmi_x100" in cols:
        out.append(X.bmi_from_x100("bmi_x100").alias("bmi"))
    else:
        log.warning("without bmi_x100 there is no bmi")
    return out


def outcomes_present(columns: Iterable[str]) -> Column | None:
    """Predicate on the raw codes that holds exactly when every outcome the
    recodes produce is non-null (P12).  Filtering on the raw codes keeps
    the filter small and lets it reach the Parquet scan."""
    cols = set(columns)
    cond = None
    for raw, _, _, valid in _TARGET_RULES:
        if raw in cols:
            c = F.col(raw).isin(*valid)
            cond = c if cond is None else cond & c
    if "asthma_raw" in cols and "copd_raw" in cols:
        a, b = F.col("asthma_raw"), F.col("copd_raw")
        codes = fixed.DK_REFUSED
        c = (a == 1) | (b == 1) | (~a.isin(*codes) & ~b.isin(*codes))
        cond = c if cond is None else cond & c
    return cond


def clean_survey(raw: DataFrame, drop_missing_targets: bool = True) -> DataFrame:
    """Raw survey rows -> outcomes + covariates, raw columns dropped (P10),
    rows with any missing outcome removed (P12)."""
    if drop_missing_targets:
        cond = outcomes_present(raw.columns)
        if cond is not None:
            raw = raw.filter(cond)
    return raw.select(*recode_columns(raw.columns))


def rename_to_features(df: DataFrame) -> DataFrame:
    """Extract names of cleaned columns -> model feature names (P11); other
    columns keep theirs."""
    return df.withColumnsRenamed({k: v for k, v in fixed.FEATURE_RENAME.items() if k in df.columns})


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required columns that the table lacks, in the order asked for."""
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    """Raise before any job runs when required columns are missing."""
    missing = missing_columns(df, required)
    if missing:
        raise KeyError(f"{what} has no {', '.join(missing)}")
    return df


def rule_violations(raw: DataFrame) -> DataFrame:
    """One-pass counts behind the cleaning warnings (P7, P8, P1): sex outside
    {1, 2} with nulls counted as bad, metro outside 1-5 with nulls not
    counted, implausible BMI, unmapped state codes, and incomes above the
    1-8 scale (left as they are)."""
    aggs = []
    cols = set(raw.columns)
    if "sex_raw" in cols:
        aggs.append(F.count_if(F.coalesce(~F.col("sex_raw").isin(*fixed.SEX_VALID), F.lit(True)))
                    .alias("bad_sex"))
    if "metro_raw" in cols:
        aggs.append(F.count_if(~F.col("metro_raw").isin(*fixed.METRO_VALID)).alias("bad_metro"))
    if "bmi_x100" in cols:
        bmi = F.col("bmi_x100") / F.lit(100.0)
        aggs.append(F.count_if((bmi < fixed.BMI_MIN) | (bmi > fixed.BMI_MAX)).alias("bad_bmi"))
    if "state_fips" in cols:
        aggs.append(F.count_if(state_abbr("state_fips").isNull()).alias("unmapped_state"))
    if "income_raw" in cols:
        # kept as they are (never nulled or clipped), but reported
        inc = X.null_if_in("income_raw", fixed.INCOME_INVALID)
        aggs.append(F.count_if(inc > fixed.INCOME_MAX).alias("income_above_scale"))
    aggs.append(F.count(F.lit(1)).alias("n_rows"))
    return raw.agg(*aggs)
