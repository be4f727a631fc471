"""Risk tables for the map and the importance chart (A9, A15, A16, A17,
P24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed


def demographic_risk_by_state(pred: DataFrame, traits: list[str] | None = None,
                              targets: list[str] | None = None,
                              min_n: int = fixed.MIN_MAP_SAMPLE_SIZE) -> DataFrame:
    """Mean predicted risk (x100) and n per trait value, state and outcome,
    every trait value at once (A9, P19).  One grouping-sets aggregation
    (state x one trait per set) over the wide prediction table; the outcome
    columns are unpivoted only after aggregation.  Null trait values and
    null states are left out, as a pandas group-by does; ``enough`` marks
    the cells with at least ``min_n`` respondents.
    Columns: trait, trait_value, stateabbr, target, n, mean_risk_pct, enough."""
    traits = traits or fixed.DEMOGRAPHIC_TRAITS
    targets = targets or fixed.TARGET_COLUMNS
    preds = [f"pred_{t}" for t in targets]
    base = pred.filter(F.col("stateabbr").isNotNull())
    sets = [[F.col("stateabbr"), F.col(t)] for t in traits]
    agg = base.groupingSets(sets, "stateabbr", *traits).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(p).alias(p) for p in preds],
        *[F.grouping(t).alias(f"_g_{t}") for t in traits])
    trait = F.lit(None).cast("string")
    value = F.lit(None).cast("int")
    for t in traits:
        trait = F.when(F.col(f"_g_{t}") == 0, F.lit(t)).otherwise(trait)
        value = F.when(F.col(f"_g_{t}") == 0, F.col(t).cast("int")).otherwise(value)
    cells = agg.select(trait.alias("trait"), value.alias("trait_value"), "stateabbr", "n", *preds) \
        .filter(F.col("trait_value").isNotNull())
    items = [F.struct(F.lit(t).alias("target"), F.col(p).alias("_m")) for t, p in zip(targets, preds)]
    long = cells.select("trait", "trait_value", "stateabbr", "n",
                        F.explode(F.array(*items)).alias("_s"))
    return long.select("trait", "trait_value", "stateabbr", "_s.target", "n",
                       (F.col("_s._m") * 100).alias("mean_risk_pct"),
                       (F.col("n") >= min_n).alias("enough"))


def importance_summary(imp: DataFrame, digits: int = 12) -> DataFrame:
    """Mean importance over outcomes per (feature, method), highest first,
    with display names (A15, P24).  The mean is rounded to ``digits``
    decimals so it does not depend on summation order."""
    out = imp.groupBy("feature", "method").agg(
        X.round_half_even(F.avg("importance"), digits).alias("importance"))
    return out.withColumn("feature_display", F.coalesce(
        X.literal_lookup("feature", fixed.FEATURE_DISPLAY_NAMES), F.col("feature"))
    ).orderBy(F.desc("importance"), "feature")


def importance_by_target(imp: DataFrame) -> DataFrame:
    """Feature x outcome table in model feature order (A15).  The pivot
    is given its values."""
    wide = imp.groupBy("feature").pivot("target", fixed.TARGET_COLUMNS).agg(F.avg("importance"))
    order = F.array_position(F.array(*[F.lit(f) for f in fixed.FEATURE_COLUMNS]), F.col("feature"))
    return wide.withColumn("feature_order", order.cast("int")).orderBy("feature_order")


def distinct_states(df: DataFrame) -> DataFrame:
    """Sorted distinct states and their count."""
    states = df.filter(F.col("stateabbr").isNotNull()).select("stateabbr").distinct()
    # the distinct list is bounded by the state code table
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return states.withColumn("n_states", F.count(F.lit(1)).over(everything)).orderBy("stateabbr")


def equal_width_bins(df: DataFrame, value_col: str, bins: int = fixed.MAP_BINS) -> DataFrame:
    """Equal-width bins between the column's min and max, edges as
    ``linspace(min, max, bins + 1)``; the top edge falls in the last bin;
    no bins when min = max or all values are null (A17).  Adds bin,
    bin_lo, bin_hi."""
    mm = df.agg(F.min(value_col).alias("_lo"), F.max(value_col).alias("_hi")).first()
    lo = F.lit(mm["_lo"]).cast("double")
    hi = F.lit(mm["_hi"]).cast("double")
    step = (hi - lo) / F.lit(float(bins))
    v = F.col(value_col)
    edge = [lo + F.lit(i) * step for i in range(bins)] + [hi]
    b = F.lit(1)
    for i in range(1, bins):
        b = b + F.when(v >= edge[i], 1).otherwise(0)
    ok = lo.isNotNull() & hi.isNotNull() & (lo != hi)
    lo_edge = F.lit(None).cast("double")
    hi_edge = F.lit(None).cast("double")
    for i in range(bins):
        lo_edge = F.when(b == i + 1, edge[i]).otherwise(lo_edge)
        hi_edge = F.when(b == i + 1, edge[i + 1]).otherwise(hi_edge)
    return df.select("*", F.when(ok & v.isNotNull(), b).alias("bin"),
                     F.when(ok & v.isNotNull(), lo_edge).alias("bin_lo"),
                     F.when(ok & v.isNotNull(), hi_edge).alias("bin_hi"))
