"""Model jobs on a planted signal (M2-M5)."""

import random

from riskfabric.functions import fixed
from riskfabric.operators import metrics, model


def _planted(spark, n=1200, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        age = rng.randint(1, 13)
        feats = {f: float(rng.randint(1, 6)) for f in fixed.FEATURE_COLUMNS}
        feats["age_code"] = float(age)
        ys = {t: int(rng.random() < (0.9 if age > 7 else 0.1)) for t in fixed.TARGET_COLUMNS}
        rows.append((i, *[feats[f] for f in fixed.FEATURE_COLUMNS], *[ys[t] for t in fixed.TARGET_COLUMNS]))
    schema = ", ".join(["resp_id long"] + [f"{f} double" for f in fixed.FEATURE_COLUMNS]
                       + [f"{t} int" for t in fixed.TARGET_COLUMNS])
    return spark.createDataFrame(rows, schema)


def test_gbt_learns_planted_signal_and_importance(spark, tmp_path):
    df = _planted(spark)
    train, test = df.filter("resp_id % 5 <> 0"), df.filter("resp_id % 5 = 0")
    models = model.train_models(train, rounds=10, depth=3)
    scored = model.score(models, test, ["resp_id", *fixed.TARGET_COLUMNS])
    longp = model.long_predictions(scored, ["resp_id"])
    auc = {r.target: r.roc_auc for r in metrics.roc_auc(longp).collect()}
    assert all(v > 0.75 for v in auc.values()), auc
    imp = model.permutation_importance(test, model.gbt_scorer(models), repeats=3)
    by = {(r.feature, r.target): r.importance for r in imp.collect()}
    for t in fixed.TARGET_COLUMNS:
        assert by[("age_code", t)] == max(v for (f, tt), v in by.items() if tt == t)
    # save / load gives the same scores
    path = model.save_models(models, str(tmp_path / "models"))
    again = model.score(model.load_models(path), test, ["resp_id"]).toPandas().sort_values("resp_id")
    first = scored.toPandas().sort_values("resp_id")
    assert (again["pred_target_stroke"].values == first["pred_target_stroke"].values).all()


def test_sampled_shapley_sums_to_score_minus_background(spark):
    from pyspark.sql import functions as F

    df = _planted(spark, n=120)
    exprs = {t: (F.col("age_code") * 0.05 + F.col("bmi") * 0.01 * (i + 1)) for i, t in enumerate(fixed.TARGET_COLUMNS)}
    scorer = model.expression_scorer(exprs)
    phi = model.sampled_shapley(df, scorer, orderings=3).toPandas()
    sums = phi.groupby(["resp_id", "target"])["phi"].sum()
    own = scorer(df, ["resp_id"]).toPandas().set_index("resp_id")
    # background rows of every ordering are a permutation of all rows, so the
    # mean background score is the mean score
    for t in fixed.TARGET_COLUMNS:
        mean_bg = own[f"pred_{t}"].mean()
        got = sums.xs(t, level="target")
        want = own[f"pred_{t}"] - mean_bg
        # per row the telescoping sum is f(x) - mean over its 3 backgrounds
        assert abs(got.mean() - want.mean()) < 1e-9
    imp = model.shapley_importance(spark.createDataFrame(phi)).toPandas()
    zero = imp[~imp.feature.isin(["age_code", "bmi"])]
    assert (zero.importance.abs() < 1e-12).all()
    assert set(phi.n_orderings) == {3}
