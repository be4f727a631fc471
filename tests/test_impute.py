"""Tiered median imputation."""

from riskfabric.operators import impute


def _frame(spark, rows):
    return spark.createDataFrame(rows, "resp_id long, age_code int, educa_code int, income_code int")


def test_tiers_and_thresholds(spark):
    rows, rid = [], 0

    def add(age, edu, inc, n):
        nonlocal rid
        for _ in range(n):
            rid += 1
            rows.append((rid, age, edu, inc))

    add(1, 1, 2, 30)       # cell (1,1): 30 observed -> usable, median 2
    add(2, 1, 7, 29)       # cell (2,1): 29 observed -> not usable
    add(3, 2, 5, 29)       # education 2: 29 observed -> not usable
    add(1, 1, None, 1)     # -> cell median 2
    add(2, 1, None, 1)     # -> education 1 median over 59 rows
    add(3, 2, None, 1)     # -> overall median
    add(None, 1, None, 1)  # null age -> education median
    add(5, None, None, 1)  # null education -> overall
    out = {r.resp_id: r for r in impute.impute_income(_frame(spark, rows)).collect()}
    assert out[rid - 4].income_code == 2 and out[rid - 4].imputation_tier == "age_x_education_group"
    # education 1 has 30 x 2 and 29 x 7 -> median 2
    assert out[rid - 3].income_code == 2 and out[rid - 3].imputation_tier == "education_group"
    assert out[rid - 2].imputation_tier == "overall_median"
    assert out[rid - 1].imputation_tier == "education_group"
    assert out[rid].imputation_tier == "overall_median"
    assert all(r.income_code_imputed == (r.resp_id > rid - 5) for r in out.values())
    assert all(1 <= r.income_code <= 8 for r in out.values() if r.resp_id > rid - 5)


def test_half_even_rounding(spark):
    # overall medians 2.5 -> 2 and 3.5 -> 4
    for lo, hi, want in ((2, 3, 2), (3, 4, 4)):
        rows = [(1, None, None, lo), (2, None, None, hi), (3, None, None, None)]
        out = {r.resp_id: r.income_code for r in impute.impute_income(_frame(spark, rows)).collect()}
        assert out[3] == want


def test_flag_always_present(spark):
    out = impute.impute_income(_frame(spark, [(1, 1, 1, 3)]))
    assert "income_code_imputed" in out.columns and out.first().income_code_imputed is False


def test_tier_usage(spark):
    rows = [(i, 1, 1, 4) for i in range(30)] + [(100, 1, 1, None), (101, 9, 9, None)]
    u = {r.tier: (r.n_imputed, r.share_of_rows) for r in
         impute.tier_usage(impute.impute_income(_frame(spark, rows))).collect()}
    assert u["age_x_education_group"][0] == 1 and u["overall_median"][0] == 1
    assert abs(u["overall_median"][1] - 1 / 32) < 1e-12


def test_fit_on_other_rows(spark):
    train = _frame(spark, [(i, 1, 1, 2) for i in range(40)])
    frame = _frame(spark, [(100, 1, 1, 7), (101, 1, 1, 7), (102, 1, 1, None)])
    own = {r.resp_id: r.income_code for r in impute.impute_income(frame).collect()}
    fitted = {r.resp_id: r.income_code for r in impute.impute_income(frame, fit_on=train).collect()}
    assert own[102] == 7 and fitted[102] == 2
