"""Reports come in their stated order (T1), which the value comparison with SQL doesn't see."""

from riskfabric.functions import fixed
from riskfabric.operators import quality, risk


def test_missing_columns_come_most_missing_first_then_by_name(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, None, 2, 1), (3, None, 3, 1)], "b int, d int, a int, c int")
    rows = quality.missingness(df, ["a", "b", "c", "d"]).collect()
    assert [(r["column_name"], r["n_missing"]) for r in rows] == [("d", 3), ("a", 1), ("b", 1), ("c", 0)]


def test_importances_come_greatest_first(spark):
    rows = [("bmi", "t", 0.1), ("age_code", "t", 0.5), ("sex_code", "t", 0.3), ("bmi", "u", 0.7), ("age_code", "u", 0.1), ("sex_code", "u", 0.0)]
    imp = spark.createDataFrame([(*r, "m") for r in rows], "feature string, target string, importance double, method string")
    got = [(r["feature"], r["importance"]) for r in risk.importance_summary(imp).collect()]
    assert [f for f, _ in got] == ["bmi", "age_code", "sex_code"]
    assert [v for _, v in got] == sorted((v for _, v in got), reverse=True)


def test_importance_by_target_keeps_the_models_order(spark):
    names = fixed.FEATURE_COLUMNS[::-1]
    imp = spark.createDataFrame([(f, t, 0.1, "m") for f in names for t in fixed.TARGET_COLUMNS],
                                "feature string, target string, importance double, method string").repartition(7)
    got = risk.importance_by_target(imp).collect()
    assert [r["feature"] for r in got] == fixed.FEATURE_COLUMNS
    assert [r["feature_order"] for r in got] == list(range(1, len(names) + 1))


def test_states_come_by_name(spark):
    df = spark.createDataFrame([("MD",), ("AL",), (None,), ("CA",), ("AL",)], "stateabbr string").repartition(3)
    assert [(r["stateabbr"], r["n_states"]) for r in risk.distinct_states(df).collect()] == [("AL", 3), ("CA", 3), ("MD", 3)]
