"""Training and scoring jobs (E1 from the split on, the respondent
scoring script, and model-based request scoring).

Within one application the evaluation frame is written once, and the models
of an input are fitted once, for the jobs that read them; another application
always fits again.  Saving and loading models is explicit (S10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import lookup, model
from ..operators.forest import Forest
from ..session import shared_path
from ..sources.sinks import materialised
from . import evaluation, modelling
from . import requests as requests_plan
from .once import forget, once  # noqa: F401


def eval_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modelling frame + quartile + held-out flag, written to the shared folder
    because several jobs read it."""
    return once(spark, ("frame", sf_dir), lambda: materialised(
        evaluation.with_quartile_and_split(modelling.written_frame(spark, sf_dir)), "evaluation-frame"))


def fitted(spark: SparkSession, sf_dir: str, rounds: int = fixed.GBT_ROUNDS,
           depth: int = fixed.GBT_DEPTH) -> tuple[Forest, int]:
    """(model, n_train) for this input."""
    def make():
        train = eval_frame(spark, sf_dir).filter(~F.col("is_test"))
        return model.train_models(train, rounds=rounds, depth=depth), train.count()
    return once(spark, ("models", sf_dir, rounds, depth), make)


def saved(spark: SparkSession, sf_dir: str) -> tuple[Forest, str]:
    """(model, the path that it was saved to)."""
    models, _ = fitted(spark, sf_dir)
    return models, once(spark, ("saved", models.key), lambda: model.save_models(models, shared_path(spark, "models")))


def scored_respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for every respondent in the modelling frame, training
    rows included and flagged (M3)."""
    models, _ = fitted(spark, sf_dir)
    ev = eval_frame(spark, sf_dir).withColumn("in_train", ~F.col("is_test"))
    return model.score(models, ev, ["resp_id", *fixed.PREDICTION_COLUMNS, "in_train"])


def heldout_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (resp_id, quartile, target, y, p) on the held-out rows (M4), scored
    once and written: every metric reads the scores again."""
    def make():
        models, _ = fitted(spark, sf_dir)
        test = eval_frame(spark, sf_dir).filter(F.col("is_test"))
        scored = model.score(models, test, ["resp_id", "quartile", *fixed.TARGET_COLUMNS])
        return materialised(model.long_predictions(scored, ["resp_id", "quartile"]), "heldout-scores")
    return once(spark, ("scores", sf_dir), make)


def score_requests(models: Forest, resolved: DataFrame) -> DataFrame:
    """Model scores of resolved requests (M7), a row per request and outcome.  Missing inputs
    stay missing: each split sends them to the side that it has learned.  ``place_imputed`` flags
    missing place values, ``inputs_imputed`` counts all inputs that the model had to do without."""
    rows = lookup.feature_rows(resolved)
    absent = sum((F.col(c).isNull().cast("int") for c in model.FEATURES), F.lit(0))
    rows = rows.withColumn("place_imputed", F.col("spatial_lack_insurance").isNull()
                           | F.col("spatial_poor_mental_health").isNull()).withColumn("inputs_imputed", absent)
    scored = model.score(models, rows, ["request_id", "place_imputed", "inputs_imputed"])
    items = [F.struct(F.lit(t).alias("target"), F.lit(fixed.TARGET_DISPLAY_NAMES[t]).alias("condition"),
                      F.col(f"pred_{t}").alias("score")) for t in fixed.TARGET_COLUMNS]
    return scored.select("request_id", "place_imputed", "inputs_imputed", F.explode(F.array(*items)).alias("_s")).select(
        "request_id", "_s.*", F.lit("model").alias("score_kind"), "place_imputed", "inputs_imputed")


def request_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores of every request: lookup, BMI, feature row, forest."""
    models, _ = fitted(spark, sf_dir)
    return score_requests(models, requests_plan.resolved_requests(spark, sf_dir))


def model_importance(spark: SparkSession, sf_dir: str, method: str = "permutation") -> DataFrame:
    """Per (feature, target) importance of the fitted models on the held-out
    rows (M5 permutation or M6 Shapley values), written once, since the
    summary tables read it again."""
    def make():
        models, _ = fitted(spark, sf_dir)
        test = eval_frame(spark, sf_dir).filter(F.col("is_test"))
        if method == "permutation":
            imp = model.permutation_importance(test, model.gbt_scorer(models))
        else:
            imp = model.shapley_importance(model.shapley(models, test))
        return materialised(imp, "importance")
    return once(spark, ("importance", sf_dir, method), make)
