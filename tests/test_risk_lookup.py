"""Risk tables, bins and request lookups."""

from riskfabric.operators import lookup, risk


def test_bins(spark):
    df = spark.createDataFrame([("A", 0.0), ("B", 5.0), ("C", 10.0), ("D", None)], "stateabbr string, v double")
    got = {r.stateabbr: r.bin for r in risk.equal_width_bins(df, "v").collect()}
    assert got == {"A": 1, "B": 3, "C": 5, "D": None}  # the max is in the top bin
    flat = spark.createDataFrame([("A", 1.0), ("B", 1.0)], "stateabbr string, v double")
    assert all(r.bin is None for r in risk.equal_width_bins(flat, "v").collect())
    empty = spark.createDataFrame([("A", None)], "stateabbr string, v double")
    assert risk.equal_width_bins(empty, "v").first().bin is None


def test_demographic_risk(spark):
    rows = [(i, "AL" if i < 40 else "AK", 1 + i % 2, 3, 4, 5, 0.2, 0.1, 0.1, 0.1, 0.1) for i in range(50)]
    rows.append((99, None, 1, 3, 4, 5, 0.9, 0.9, 0.9, 0.9, 0.9))
    df = spark.createDataFrame(rows, "resp_id long, stateabbr string, age_code int, income_code int, "
                               "educa_code int, race_code int, pred_target_diabetes double, pred_target_stroke double, "
                               "pred_target_cancer double, pred_target_cardio double, pred_target_chronic_respiratory double")
    out = risk.demographic_risk_by_state(df).filter("target = 'target_diabetes'").collect()
    cells = {(r.trait, r.trait_value, r.stateabbr): r for r in out}
    assert cells[("income_code", 3, "AL")].n == 40 and cells[("income_code", 3, "AL")].enough
    assert not cells[("income_code", 3, "AK")].enough
    assert abs(cells[("age_code", 1, "AL")].mean_risk_pct - 20.0) < 1e-9
    assert all(r.stateabbr is not None for r in out)


def test_request_statuses(spark):
    zips = spark.createDataFrame([("21201", "MD", 7.0, 12.0)],
                                 "ZCTA string, stateabbr string, spatial_lack_insurance double, "
                                 "spatial_poor_mental_health double")
    states = spark.createDataFrame([("MD", 8.0, 13.0)], "stateabbr string, spatial_lack_insurance double, "
                                   "spatial_poor_mental_health double")
    texts = ["21201", " 21201 ", "2120", "2120A", "", None, "99999"]
    rows = [(i, "zip", t, 24) for i, t in enumerate(texts)] + [(10, "state", None, 24), (11, "state", None, 3)]
    req = spark.createDataFrame(rows, "request_id long, lookup_mode string, zip_text string, state_fips int")
    got = {r.request_id: r for r in lookup.resolve_requests(req, zips, states).collect()}
    assert [got[i].status for i in range(7)] == ["ok", "ok", "malformed", "malformed", "malformed",
                                                 "malformed", "not_found"]
    assert got[1].region_label == "ZIP 21201 (MD)" and got[1].spatial_lack_insurance == 7.0
    assert got[10].status == "ok" and got[10].region_label == "MD" and got[10].spatial_lack_insurance == 8.0
    assert got[11].status == "not_found"


def test_fallback_score_clip(spark):
    df = spark.createDataFrame([(1, 13, 1, None, None), (2, 1, 8, 90.0, 300.0)],
                               "request_id long, age_code int, income_code int, spatial_lack_insurance double, "
                               "spatial_poor_mental_health double")
    got = {(r.request_id, r.target): r.score for r in lookup.fallback_scores(df).collect()}
    assert abs(got[(1, "target_diabetes")] - (0.14 + 13 * 0.02 - 1 * 0.015)) < 1e-12
    assert got[(2, "target_chronic_respiratory")] == 0.99
    assert got[(2, "target_diabetes")] == 0.14 + 1 * 0.02 - 8 * 0.015
