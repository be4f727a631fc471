"""Evaluation frame: disadvantage quartile over the whole modelling frame
(W1), the repeatable held-out split (M1), and the long score table the
metrics read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import rank
from ..sources.sinks import materialised


def holdout_flag(resp_id: str = "resp_id", modulus: int = fixed.TEST_SHARE_MODULUS) -> Column:
    """Held-out membership from a linear congruential hash of the id: the
    same in any engine and under any partitioning (``randomSplit`` is
    not).  The id is reduced mod 2^31 first, so the product never
    overflows a long.  About 1 row in ``modulus`` is held out."""
    r = F.col(resp_id) % F.lit(2147483648)
    h = (r * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)
    return (h % F.lit(modulus)) == 0


def with_quartile_and_split(written: DataFrame) -> DataFrame:
    """A written modelling frame (it is read several times) with ``quartile``, cut before the
    split as the modelled system does, and ``is_test``."""
    return rank.disadvantage_quartile(written).withColumn("is_test", holdout_flag())


def evaluation_frame(model_df: DataFrame) -> DataFrame:
    """``with_quartile_and_split`` of a frame that isn't written yet."""
    return with_quartile_and_split(materialised(model_df, "modelling-frame"))


def reference_score(target_index: int) -> Column:
    """A deterministic stand-in probability from integer features, with
    many ties, used where the metric values must be checked by SQL
    without a trained model."""
    num = (F.col("age_code") * 3 + F.col("smoker_code") * 2 + F.col("income_code") * 5
           + F.col("educa_code") + F.col("race_code") * 7 + F.lit(5 * target_index)) % 64
    return num / F.lit(64.0)


def long_scores(frame: DataFrame, score_cols: dict[str, Column] | None = None,
                keep: list[str] | None = None) -> DataFrame:
    """Wide frame -> (resp_id, target, y, p, quartile, is_test, ...) with
    one row per respondent and outcome."""
    keep = keep if keep is not None else ["resp_id", "quartile", "is_test"]
    score_cols = score_cols or {t: reference_score(i) for i, t in enumerate(fixed.TARGET_COLUMNS)}
    items = [F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("y"),
                      score_cols[t].cast("double").alias("p"))
             for t in fixed.TARGET_COLUMNS]
    return frame.select(*keep, F.explode(F.array(*items)).alias("_s")).select(*keep, "_s.*")
