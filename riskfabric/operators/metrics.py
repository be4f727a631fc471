"""Evaluation metrics over a long score table.

Input columns: ``target`` (string), ``y`` (0/1), ``p`` (probability of 1),
plus ``quartile`` for the equity audit.  All five outcomes are handled in
the same jobs (one long table, one shuffle) rather than one pass each.
The ranking metrics are exact: scores are grouped to (target, p) counts and
running totals come from :func:`rank.running_totals`, which does not put a
whole outcome into one task; A13, A14 and W2 share one such pass.  Reported values are rounded to 4 decimals
half-to-even, as the modelled system's reports are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import fixed
from .rank import quartile_label, running_totals

DIGITS = 4


def _r4(c: Column) -> Column:
    return X.round_half_even(c, DIGITS)


def predicted(p: str | Column = "p", threshold: float = fixed.DECISION_THRESHOLD) -> Column:
    """Class call of a probability at the decision threshold (p > 0.5)."""
    return (X.col(p) > F.lit(threshold)).cast("int")


def confusion(scores: DataFrame, keys: list[str]) -> DataFrame:
    """tn, fp, fn, tp and n per key, in one aggregation."""
    pred, y = predicted(), F.col("y")
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 0) & (pred == 0)).alias("tn"),
        F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 1) & (pred == 0)).alias("fn"),
        F.count_if((y == 1) & (pred == 1)).alias("tp"),
    )


def prevalence(scores: DataFrame) -> DataFrame:
    """Share of positives per outcome."""
    return scores.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), _r4(F.avg("y")).alias("prevalence"))


def macro_f1(scores: DataFrame) -> DataFrame:
    """Mean of the F1 of class 1 and class 0 at p > 0.5, each 0 when
    undefined (A12)."""
    c = confusion(scores, ["target"])
    f1_pos = F.coalesce(X.safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
                        F.lit(0.0))
    f1_neg = F.coalesce(X.safe_ratio(2 * F.col("tn"), 2 * F.col("tn") + F.col("fn") + F.col("fp")),
                        F.lit(0.0))
    return c.select("target", "n", _r4((f1_pos + f1_neg) / 2).alias("macro_f1"))


def score_counts(scores: DataFrame) -> DataFrame:
    """Positives and negatives per (target, distinct score)."""
    return scores.groupBy("target", "p").agg(
        F.sum("y").cast("long").alias("pos"),
        (F.count(F.lit(1)) - F.sum("y")).cast("long").alias("neg"))


def placed_counts(scores: DataFrame) -> DataFrame:
    """``score_counts`` with running totals in the order of the score and the outcome's totals:
    ``target, p, pos, neg, cum_pos, cum_neg`` (up to and including p), ``n_pos, n_neg``.  One
    pass over score ranges serves all ranking metrics; totals from the top down are differences."""
    run = running_totals(score_counts(scores), ["target"], "p", ["pos", "neg"])
    totals = run.groupBy("target").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return run.join(F.broadcast(totals), "target")  # one row per outcome


def roc_auc(scores: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Exact ROC-AUC with ties counted half (A13): the sum over scores of
    positives x (negatives below + half the negatives at the score), over
    P x N.  Null when only one class is present."""
    run = placed if placed is not None else placed_counts(scores)
    below = (F.col("cum_neg") - F.col("neg")).cast("double")
    contrib = F.col("pos").cast("double") * (below + F.col("neg").cast("double") / 2.0)
    agg = run.groupBy("target").agg(F.sum(contrib).alias("_s"),
                                    F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_s") / (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return agg.select("target", "n_pos", "n_neg", _r4(auc).alias("roc_auc"))


def pr_points(scores: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Precision and recall at every distinct score used as threshold
    (p >= t called positive), from the top down.  Recall is 1 when there
    are no positives."""
    run = placed if placed is not None else placed_counts(scores)
    run = run.select("target", "p", "pos", "n_pos", (F.col("n_pos") - F.col("cum_pos") + F.col("pos")).alias("cum_pos"),
                     (F.col("n_neg") - F.col("cum_neg") + F.col("neg")).alias("cum_neg"))
    precision = F.col("cum_pos").cast("double") / (F.col("cum_pos") + F.col("cum_neg")).cast("double")
    recall = F.when(F.col("n_pos") > 0,
                    F.col("cum_pos").cast("double") / F.col("n_pos").cast("double")).otherwise(F.lit(1.0))
    return run.select("target", F.col("p").alias("threshold"), "pos", "cum_pos", "cum_neg", "n_pos",
                      precision.alias("precision"), recall.alias("recall"))


def average_precision(scores: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """PR-AUC as average precision: sum over thresholds of the recall step
    times the precision there (A14).  0 when there are no positives."""
    pts = pr_points(scores, placed)
    term = (F.col("pos") * F.col("cum_pos")).cast("double") / (F.col("cum_pos") + F.col("cum_neg")).cast("double")
    agg = pts.groupBy("target").agg(F.sum(term).alias("_s"), F.max("n_pos").alias("n_pos"))
    ap = F.when(F.col("n_pos") > 0, F.col("_s") / F.col("n_pos").cast("double")).otherwise(F.lit(0.0))
    return agg.select("target", _r4(ap).alias("pr_auc"))


def pr_curve(scores: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """The PR curve per outcome as rows, ascending threshold, plus the end
    point (precision 1, recall 0, no threshold) and the baseline rate (W2).
    Columns: target, threshold, precision, recall, baseline, is_end."""
    placed = placed if placed is not None else placed_counts(scores)
    pts = pr_points(scores, placed)
    base = placed.groupBy("target").agg((F.max("n_pos").cast("double") / (F.max("n_pos") + F.max("n_neg"))).alias("baseline"))
    curve = pts.select("target", "threshold", "precision", "recall", F.lit(False).alias("is_end"))
    ends = base.select("target", F.lit(None).cast("double").alias("threshold"),
                       F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                       F.lit(True).alias("is_end"))
    # one row per outcome
    return curve.unionByName(ends).join(F.broadcast(base), "target")


def operating_point(curve: DataFrame, target: str | None = fixed.PRIMARY_TARGET) -> DataFrame:
    """Threshold with the highest F1 on the PR curve, end point excluded,
    the lowest threshold on ties; 4 decimals (W3, T3)."""
    pts = curve.filter(~F.col("is_end"))
    if target is not None:
        pts = pts.filter(F.col("target") == target)
    s = F.col("precision") + F.col("recall")
    f1 = F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(F.lit(0.0))
    pts = pts.withColumn("f1", f1)
    best = pts.groupBy("target").agg(F.max_by(
        F.struct("threshold", "precision", "recall", "f1"),
        F.struct(F.col("f1"), (-F.col("threshold")).alias("neg_t"))).alias("b"))
    return best.select(
        "target",
        _r4(F.col("b.threshold")).alias("threshold"),
        _r4(F.col("b.precision")).alias("precision"),
        _r4(F.col("b.recall")).alias("recall"),
        _r4(F.col("b.f1")).alias("f1"),
    )


def equity_audit(scores: DataFrame, min_n: int = fixed.MIN_EQUITY_GROUP_N) -> DataFrame:
    """FPR and FNR at p > 0.5 per outcome and disadvantage quartile; groups
    under ``min_n`` rows are skipped; null on a zero denominator (A10)."""
    c = confusion(scores.filter(F.col("quartile").isNotNull()), ["target", "quartile"])
    c = c.filter(F.col("n") >= min_n)
    return c.select(
        X.literal_lookup("target", fixed.TARGET_DISPLAY_NAMES).alias("target"),
        quartile_label("quartile").alias("group"), "n",
        _r4(X.safe_ratio("fp", F.col("fp") + F.col("tn"))).alias("fpr"),
        _r4(X.safe_ratio("fn", F.col("fn") + F.col("tp"))).alias("fnr"),
    )


def lift(ap: DataFrame, prev: DataFrame) -> DataFrame:
    """PR-AUC over prevalence per outcome, null if either is 0."""
    j = ap.join(prev.select("target", "prevalence"), "target")
    ok = (F.col("pr_auc") != 0) & (F.col("prevalence") != 0)
    return j.select("target", "pr_auc", "prevalence",
                    F.when(ok, F.col("pr_auc") / F.col("prevalence")).alias("lift"))


def summary(scores: DataFrame) -> DataFrame:
    """All per-outcome scalars in one table: prevalence, macro F1, ROC-AUC,
    PR-AUC (the body of the metrics document)."""
    placed = placed_counts(scores)
    return (prevalence(scores).join(macro_f1(scores).drop("n"), "target")
            .join(roc_auc(scores, placed).select("target", "roc_auc"), "target")
            .join(average_precision(scores, placed), "target"))
