"""Model jobs (M2-M7, S10): boosted trees for all outcomes, scoring, held-out
evaluation input, permutation importance and Shapley values.

A model is a ``forest.Forest``, the node table of all outcomes' trees; fitting
is in ``boosting``.  Scores of all outcomes come from one pass over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Imputer, ImputerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..sources.sinks import materialised
from . import boosting, forest, rank
from .forest import Forest

FEATURES = fixed.FEATURE_COLUMNS
TARGETS = fixed.TARGET_COLUMNS

score = forest.score


def train_models(train: DataFrame, rounds: int = fixed.GBT_ROUNDS, depth: int = fixed.GBT_DEPTH,
                 targets: list[str] = TARGETS, features: list[str] = FEATURES) -> Forest:
    """Boost all outcomes together (M2): one job per round and tree level."""
    return boosting.train_forest(train, features, targets, rounds, depth)


def long_predictions(scored: DataFrame, keep: list[str]) -> DataFrame:
    """pred_<target> columns -> rows (target, y, p) (M4)."""
    items = [F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("y"),
                      F.col(f"pred_{t}").alias("p")) for t in TARGETS]
    return scored.select(*keep, F.explode(F.array(*items)).alias("_s")).select(*keep, "_s.*")


def save_models(models: Forest, base: str) -> str:
    """Model persistence (S10): the node table as Parquet."""
    return forest.save(models, SparkSession.active(), base)


def load_models(base: str, targets: list[str] = TARGETS, features: list[str] = FEATURES) -> Forest:
    return forest.load(SparkSession.active(), base, features, targets)


def model_summary(spark, models: Forest, n_train: int) -> DataFrame:
    """One row per outcome: size and settings (the first tree, an outcome's log odds, isn't counted)."""
    rows = [(t, int(n_train), models.n_trees - 1, models.depth, int(models.there[i, 1:].sum()), boosting.LEARNING_RATE)
            for i, t in enumerate(models.targets)]
    return spark.createDataFrame(
        rows, "target string, n_train long, num_trees int, max_depth int, total_nodes int, step_size double")


MEASURED = ["bmi", "spatial_lack_insurance", "spatial_poor_mental_health"]


def fit_imputers(train: DataFrame) -> list[ImputerModel]:
    """Training means of the measured inputs and medians of the coded ones, for learners that
    can't take missing values (the forest can)."""
    coded = [c for c in FEATURES if c not in MEASURED]
    data = train.select(*[F.col(c).cast("double").alias(c) for c in FEATURES])
    return [Imputer(inputCols=cols, outputCols=cols, strategy=how).fit(data.select(*cols))
            for cols, how in ((MEASURED, "mean"), (coded, "median"))]


# ---------------------------------------------------------------------------
# permutation importance (M5)
# ---------------------------------------------------------------------------
Scorer = Callable[[DataFrame, list[str]], DataFrame]
#: Rows of a shuffle that a task scores.
PAIR_ROWS = 1 << 16


class ForestScorer:
    """Scores of a forest, and those of rows with one feature at a time taken from another row."""

    def __init__(self, models: Forest):
        self.models = models

    def __call__(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return score(self.models, df, keep)

    def swapped_right(self, pairs: DataFrame, targets: list[str]) -> DataFrame:
        return forest.swapped_right(self.models, pairs, targets, fixed.DECISION_THRESHOLD)


def gbt_scorer(models: Forest) -> Scorer:
    return ForestScorer(models)


def expression_scorer(exprs: dict[str, Column]) -> Scorer:
    """A scorer from column expressions (used where a model-free score
    stands in for the model)."""
    return lambda df, keep: df.select(*keep, *[e.alias(f"pred_{t}") for t, e in exprs.items()])


def shuffle_terms(k: int, n: int) -> tuple[int, int]:
    """(a, b) of shuffle k of n rows: position j receives from (a j + b) mod n, which is a
    permutation as a has no divisor in common with n.  a is the first such number from a start
    below 2^20 on, so that a j stays a long for some 10^12 rows."""
    a = (7919 + 104729 * k) % min(n, 1 << 20)
    while math.gcd(a, n) != 1:
        a += 1
    return a, (12345 + 15485863 * k) % n


def permutation_importance(heldout: DataFrame, scorer: Scorer, repeats: int = fixed.PERMUTATION_REPEATS,
                           features: list[str] = FEATURES, targets: list[str] = TARGETS,
                           id_col: str = "resp_id", method: str = "permutation") -> DataFrame:
    """Mean drop in accuracy (p > 0.5) when one feature's values are
    shuffled among the held-out rows, over ``repeats`` shuffles (M5).

    Rows are numbered once, in id order, and written.  Shuffle k is a bijection of these
    positions (``shuffle_terms``), so nothing is sorted: a repeat joins the rows with themselves on
    a computed position, and of each pair come one variant per feature, all scored in bulk; a forest
    scores them from the pair (``forest.Compiled.swapped``) and counts in the task.
    Columns: feature, target, importance, method (no rows where nothing is held out)."""
    base_cols = [id_col, *features, *targets]
    h = _numbered(heldout, base_cols, id_col)
    base = scorer(h, [id_col, *targets]).agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if((F.col(f"pred_{t}") > fixed.DECISION_THRESHOLD).cast("int") == F.col(t))
        .alias(f"_b_{t}") for t in targets])
    # the baseline is one row of counts: computed once, used as literals
    b = base.first()
    n = int(b["_n"])
    donors = h.select(F.col("_place").alias("_donor"), *[F.col(f).alias(f"_d_{f}") for f in features])
    # a task scores bounded many pairs: by their bytes alone, a join would leave too few tasks for the scoring
    parts, pairs = math.ceil(max(n, 1) / PAIR_ROWS), None
    donors = donors.repartition(parts, "_donor")
    for k in range(repeats):
        mul, add = shuffle_terms(k, max(n, 1))
        part = h.withColumn("_donor", (F.col("_place") * F.lit(mul) + F.lit(add)) % F.lit(max(n, 1))) \
            .repartition(parts, "_donor").join(donors, "_donor")
        pairs = part if pairs is None else pairs.unionByName(part)
    if isinstance(scorer, ForestScorer) and set(features) == set(scorer.models.features):
        perm = scorer.swapped_right(pairs, targets).groupBy("_feature").agg(*[F.sum(f"_c_{t}").alias(f"_c_{t}") for t in targets])
    else:
        variants = [F.struct(F.lit(f).alias("_feature"),
                             *[(F.col(f"_d_{g}") if g == f else F.col(g)).alias(g) for g in features])
                    for f in features]
        long = pairs.select(id_col, *targets, F.explode(F.array(*variants)).alias("_v")).select(id_col, *targets, "_v.*")
        right = [F.count_if((F.col(f"pred_{t}") > fixed.DECISION_THRESHOLD).cast("int") == F.col(t))
                 .alias(f"_c_{t}") for t in targets]
        perm = scorer(long, [id_col, "_feature", *targets]).groupBy("_feature").agg(*right)
    n_rows = F.lit(n)
    items = [F.struct(F.lit(t).alias("target"), F.col(f"_c_{t}").alias("_c"),
                      F.lit(int(b[f"_b_{t}"])).alias("_b"))
             for t in targets]
    out = perm.select(F.col("_feature").alias("feature"), F.explode(F.array(*items)).alias("_s"))
    imp = ((F.lit(repeats) * F.col("_s._b") - F.col("_s._c")).cast("double")
           / (F.lit(repeats) * n_rows).cast("double"))
    return out.select("feature", F.col("_s.target").alias("target"), imp.alias("importance"),
                      F.lit(method).alias("method"))


# ---------------------------------------------------------------------------
# Shapley values (M6): exact ones of a forest's margins, sampled ones of any scorer's scores
# ---------------------------------------------------------------------------
shapley = forest.shapley


def _numbered(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """``columns`` of every row and its 0-based position ``_place`` in id order, written."""
    placed = rank.rank_first(df.select(*columns), [id_col], "_place", "_n")
    return materialised(placed.select(*columns, (F.col("_place") - 1).alias("_place")), "numbered-rows")


def _background_pairs(heldout: DataFrame, features: list[str], orderings: int,
                      id_col: str, salt: int) -> DataFrame:
    """Each held-out row paired with one background row per ordering m, which a
    shuffle of the rows' positions gives (``shuffle_terms``)."""
    h = _numbered(heldout, [id_col, *features], id_col)
    n = max(h.count(), 1)
    donors = h.select(F.col("_place").alias("_donor"), *[F.col(f).alias(f"_z_{f}") for f in features])
    out = None
    for m in range(orderings):
        mul, add = shuffle_terms(salt + m, n)
        part = h.withColumn("_donor", (F.col("_place") * F.lit(mul) + F.lit(add)) % F.lit(n)).join(donors, "_donor") \
            .withColumn("_m", F.lit(m)).drop("_donor", "_place")
        out = part if out is None else out.unionByName(part)
    return out


def order_hash(id_col: str, ordering: str, j: int) -> Column:
    """Where feature ``j`` stands in a row's ordering: squares modulo a prime, the same in any engine."""
    p = F.lit(2147483647)
    x = (F.pmod(F.col(id_col), p) * (F.lit(69621) + 2 * F.col(ordering)) * F.lit(2 * j + 1) + F.lit((j + 1) * 1566083941)) % p
    x = (x * x + F.lit(40692 * (j + 1))) % p
    return (x * x + F.lit(j)) % p


def sampled_shapley(heldout: DataFrame, scorer: Scorer, orderings: int = 10,
                    features: list[str] = FEATURES, targets: list[str] = TARGETS,
                    id_col: str = "resp_id") -> DataFrame:
    """Per-row Shapley values by permutation sampling (Strumbelj and
    Kononenko): for ordering m, features are switched from a background
    row to the row's own values one at a time in a random order; each
    switch's change in score is that feature's contribution.  Every row x
    ordering x (features + 1) coalition state is scored in one bulk job.
    Returns (resp_id, feature, target, phi, n_orderings); for every row the
    phis sum to its score minus the mean background score."""
    nf = len(features)
    pairs = _background_pairs(heldout, features, orderings, id_col, salt=1000)
    # feature order of (row, m): sort the features by a per-(row, m, j) hash
    keyed = F.array(*[F.struct(order_hash(id_col, "_m", j).alias("h"), F.lit(j).alias("j")) for j in range(nf)])
    order = F.transform(F.array_sort(keyed), lambda s: s["j"])
    with_order = pairs.withColumn("_order", order)
    # position of feature j in the order (0-based)
    pos = {f: F.array_position(F.col("_order"), F.lit(j)) - 1 for j, f in enumerate(features)}
    states = with_order.select(id_col, "_m", "_order", *features, *[f"_z_{f}" for f in features],
                               F.explode(F.sequence(F.lit(0), F.lit(nf))).alias("_t"))
    built = states.select(id_col, "_m", "_t", "_order", *[
        F.when(pos[f] < F.col("_t"), F.col(f)).otherwise(F.col(f"_z_{f}")).alias(f) for f in features])
    scored = scorer(built, [id_col, "_m", "_t", "_order"])
    # a state's score counts for the feature that it switched on and against the one switched on
    # next; the sums of both per row combine before the shuffle, and no window over states is needed
    names = F.array(*[F.lit(f) for f in features])

    def switched(t):
        return F.try_element_at(names, F.try_element_at(F.col("_order"), t) + 1)
    here, after = switched(F.greatest(F.col("_t"), F.lit(1))), switched(F.col("_t") + 1)
    signed = F.array(F.struct(F.when(F.col("_t") > 0, here).alias("feature"), F.lit(1.0).alias("sign")),
                     F.struct(after.alias("feature"), F.lit(-1.0).alias("sign")))
    parts = scored.select(id_col, *[f"pred_{t}" for t in targets], F.explode(signed).alias("_s")).where("_s.feature is not null")
    sums = parts.groupBy(id_col, "_s.feature").agg(
        *[F.sum(F.col("_s.sign") * F.col(f"pred_{t}")).alias(f"_d_{t}") for t in targets])
    items = [F.struct(F.lit(t).alias("target"), (F.col(f"_d_{t}") / orderings).alias("phi")) for t in targets]
    return sums.select(id_col, "feature", F.explode(F.array(*items)).alias("_s")).select(
        id_col, "feature", "_s.*", F.lit(orderings).cast("long").alias("n_orderings"))


def shapley_importance(phi: DataFrame) -> DataFrame:
    """Mean absolute contribution per (feature, target) (M6), of exact values or, where they come
    from ``n_orderings`` sampled orderings, of estimates.
    Columns: feature, target, importance, method, and n_orderings of estimates."""
    sampled = [F.min("n_orderings").alias("n_orderings")] if "n_orderings" in phi.columns else []
    return phi.groupBy("feature", "target").agg(F.avg(F.abs("phi")).alias("importance"), *sampled) \
        .withColumn("method", F.lit("shapley_sampling" if sampled else "shapley"))
