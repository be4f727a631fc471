"""Composed jobs: the modelling frame (E1 up to training), the state and
ZCTA place tables (E2).  One lazy plan each: scan -> one projection of all
recodes -> broadcast join to the bounded state table -> grouping-sets
medians -> filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import impute, places, quality, recode
from ..sources import standins
from ..sources.sinks import materialised
from .once import once


def state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State aggregate from the county-style pull: a row per state, written once for all jobs
    that join it, so the pull is pivoted once."""
    return once(spark, ("states", sf_dir), lambda: materialised(
        places.state_aggregate(standins.places_county(spark, sf_dir)), "state-table"))


def join_states(cleaned: DataFrame, state_avg: DataFrame) -> DataFrame:
    """Respondents x state means, inner (J1).  The state side is cut to the
    fixed state list, which bounds it at 54 rows, then broadcast."""
    return cleaned.join(F.broadcast(places.known_states(state_avg)), "stateabbr", "inner")


def _observed(df: DataFrame, counts: dict) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen


def _joined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """The joined frame and what was counted while it was written."""
    def make():
        cleaned, a = _observed(recode.clean_survey(standins.respondents(spark, sf_dir)), {"cleaned": F.count(F.lit(1))})
        joined, b = _observed(join_states(cleaned, state_table(spark, sf_dir)), {"joined": F.count(F.lit(1))})
        return materialised(joined, "joined-frame"), a, b
    frame, a, b = once(spark, ("joined", sf_dir), make)
    return frame, a.get | b.get


def joined_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned respondents with their state's means, written once: the medians and the frame
    that they fill both read it."""
    return _joined(spark, sf_dir)[0]


def imputed_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impute.impute_income(joined_frame(spark, sf_dir))


def modelling_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listwise deletion on features and outcomes after imputation."""
    frame = imputed_frame(spark, sf_dir)
    recode.require_columns(frame, fixed.FEATURE_COLUMNS + fixed.TARGET_COLUMNS, "joined frame")
    return frame.dropna(subset=fixed.FEATURE_COLUMNS + fixed.TARGET_COLUMNS)


TIERS = [fixed.TIER_CELL, fixed.TIER_EDUCATION, fixed.TIER_OVERALL]
_REQUIRED = fixed.FEATURE_COLUMNS + fixed.TARGET_COLUMNS


def _modelling(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """The modelling frame and what was counted while it was written: nulls per column and rows
    per imputation tier of the imputed frame, and the rows that stay."""
    def make():
        imputed = imputed_frame(spark, sf_dir)
        recode.require_columns(imputed, _REQUIRED, "joined frame")
        tiers = {f"tier{i}": F.count_if(F.col("imputation_tier") == t) for i, t in enumerate(TIERS)}
        watched, a = _observed(imputed, tiers | {"_n": F.count(F.lit(1))} | {c: F.count_if(F.col(c).isNull()) for c in _REQUIRED})
        kept, b = _observed(watched.dropna(subset=_REQUIRED), {"kept": F.count(F.lit(1))})
        return materialised(kept, "modelling-frame"), a, b
    frame, a, b = once(spark, ("modelling", sf_dir), make)
    return frame, a.get | b.get


def written_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modelling frame, written once: ranks, splits and risk tables read it several times."""
    return _modelling(spark, sf_dir)[0]


def tier_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 from the counts of the frame's write."""
    _, n = _modelling(spark, sf_dir)
    rows = [(t, n[f"tier{i}"]) for i, t in enumerate(TIERS) if n[f"tier{i}"]]
    rows.append((None, n["_n"] - sum(x for _, x in rows)))
    return impute.tier_shares(spark.createDataFrame(rows, "tier string, n_imputed long"))


def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 of the imputed frame from the counts of the frame's write."""
    _, n = _modelling(spark, sf_dir)
    one = spark.createDataFrame([(n["_n"], *[n[c] for c in _REQUIRED])], ", ".join(f"{c} long" for c in ["_n", *_REQUIRED]))
    return quality.missing_report(one, _REQUIRED)


def attrition_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after each deletion step (A7): outcome listwise deletion, the inner state
    join, and feature listwise deletion after imputation.  All but the number of rows that were
    scanned are counted on the way, while the frames are written."""
    _, first = _joined(spark, sf_dir)
    _, last = _modelling(spark, sf_dir)
    start = standins.respondents(spark, sf_dir).count()
    one = spark.createDataFrame([(start, first["cleaned"], first["joined"], last["kept"])], "_start long, _s0 long, _s1 long, _s2 long")
    return quality.ledger_from_counts(one, ["target_listwise", "state_join", "feature_listwise"])
