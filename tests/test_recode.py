"""Recodes (P1-P13) on literal frames."""

from itertools import product

from riskfabric.operators import recode

CODES = [1, 2, 7, 9, None]


def test_respiratory_either_all_pairs(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(product(CODES, CODES))]
    df = spark.createDataFrame(rows, "resp_id long, asthma_raw int, copd_raw int")
    out = {r.resp_id: r.target_chronic_respiratory for r in recode.clean_survey(df, False).collect()}
    for i, a, b in rows:
        if a == 1 or b == 1:
            want = 1
        elif a is not None and b is not None and a not in (7, 9) and b not in (7, 9):
            want = 0
        else:
            want = None
        assert out[i] == want, (a, b)


def test_four_and_two_code_targets(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 1, 1), (2, 2, 2, 2, 2), (3, 3, 7, 7, 3), (4, 4, 9, 9, None), (5, 7, None, 3, 9)],
        "resp_id long, diabetes_raw int, stroke_raw int, cancer_raw int, michd_raw int")
    got = {r.resp_id: (r.target_diabetes, r.target_stroke, r.target_cancer, r.target_cardio)
           for r in recode.clean_survey(df, False).collect()}
    assert got[1] == (1, 1, 1, 1)
    assert got[2] == (0, 0, 0, 0)
    assert got[3] == (0, None, None, None)
    assert got[4] == (0, None, None, None)
    assert got[5] == (None, None, None, None)


def test_covariates_and_bmi(spark):
    df = spark.createDataFrame(
        [(1, 77, 14, 9, 9, 3, 6, 9, 9, 9, 7, 1199),
         (2, 12, 13, 2, 4, 1, 5, 1, 2, 1, 5, 1200),
         (3, 99, 1, 6, 1, 2, 0, 4, 1, 2, 9, 10000),
         (4, None, None, None, None, None, None, None, None, None, None, 10001)],
        "resp_id long, income_raw int, age_raw int, race_raw int, educa_raw int, sex_raw int, "
        "metro_raw int, smoker_raw int, activity_raw int, drinking_raw int, genhlth_raw int, bmi_x100 int")
    got = {r.resp_id: r for r in recode.clean_survey(df, False).collect()}
    r1, r2, r3, r4 = got[1], got[2], got[3], got[4]
    assert (r1.income_code, r1.age_code, r1.race_code, r1.educa_code) == (None, None, None, None)
    assert r1.sex_code is None and r1.metro_code is None and r1.bmi is None
    assert r1.smoker_code is None and r1.physical_activity_code is None and r1.heavy_drinking_code is None
    assert r1.general_health_code is None
    assert r2.income_code == 12  # incomes above 8 are kept as they are
    assert r2.bmi == 12.0 and r3.bmi == 100.0 and r4.bmi is None
    assert r2.metro_code == 5 and r3.metro_code is None
    assert r3.general_health_code is None and r2.general_health_code == 5


def test_state_fips_lookup(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, 78), (4, None), (5, 57)], "resp_id long, state_fips int")
    got = {r.resp_id: r.stateabbr for r in recode.clean_survey(df, False).collect()}
    assert got == {1: "AL", 2: None, 3: "VI", 4: None, 5: None}


def test_listwise_deletion_on_targets(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, None, 2), (3, 1, 7)],
                               "resp_id long, diabetes_raw int, stroke_raw int")
    assert sorted(r.resp_id for r in recode.clean_survey(df).collect()) == [1]


def test_missing_columns_are_skipped(spark):
    df = spark.createDataFrame([(1, 2)], "resp_id long, sex_raw int")
    out = recode.clean_survey(df, False)
    assert "target_diabetes" not in out.columns and "sex_code" in out.columns


def test_rule_violation_counts(spark):
    df = spark.createDataFrame([(1, 1, 1, 500), (2, 3, 9, 2000), (3, None, None, None)],
                               "resp_id long, sex_raw int, metro_raw int, bmi_x100 int")
    r = recode.rule_violations(df).first()
    assert r.bad_sex == 2  # nulls count as bad for sex
    assert r.bad_metro == 1  # but not for metro
    assert r.bad_bmi == 1


def test_outcome_filter_reaches_parquet_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 2, 1, 2, 1, 2), (2, 9, 2, 1, 2, 2, 2)],
                               "resp_id long, diabetes_raw int, stroke_raw int, cancer_raw int, "
                               "michd_raw int, asthma_raw int, copd_raw int")
    path = str(tmp_path / "survey")
    df.write.parquet(path)
    cleaned = recode.clean_survey(spark.read.parquet(path))
    plan = cleaned._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(diabetes_raw" in plan or "In(diabetes_raw, [1,2,3,4])" in plan
    assert [r.resp_id for r in cleaned.collect()] == [1]


def test_income_above_scale_is_kept_and_counted(spark):
    df = spark.createDataFrame([(1, 9), (2, 77), (3, 5), (4, 12)], "resp_id long, income_raw int")
    assert recode.rule_violations(df).first().income_above_scale == 2
    kept = {r.resp_id: r.income_code for r in recode.clean_survey(df, False).collect()}
    assert kept == {1: 9, 2: None, 3: 5, 4: 12}
