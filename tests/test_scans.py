"""Scans of real-looking inputs: headers, text codes, missing row numbers, odd numbers and keys."""

import math

import pytest
from pyspark.sql import functions as F

from riskfabric.functions import exprs as X
from riskfabric.functions import fixed
from riskfabric.operators import impute, lookup, model, places, quality, rank, recode
from riskfabric.plans import evaluation, modelling
from riskfabric.sources import sinks, survey


def _csv(tmp_path, name, text):
    p = tmp_path / name
    p.mkdir()
    (p / "part.csv").write_text(text)
    return str(p)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = _csv(tmp_path, "state", "spatial_poor_mental_health,stateabbr,spatial_lack_insurance\n15.5,MD,7.25\nNaN,AL, 9\n")
    rows = {r["stateabbr"]: r for r in survey.read_state_aggregate(spark, path, "csv").collect()}
    assert (rows["MD"]["spatial_lack_insurance"], rows["MD"]["spatial_poor_mental_health"]) == (7.25, 15.5)
    assert rows["AL"]["spatial_poor_mental_health"] is None and rows["AL"]["spatial_lack_insurance"] == 9.0
    path = _csv(tmp_path, "walk", "stateabbr,zcta\nMD,601\n")
    assert [tuple(r) for r in survey.read_crosswalk(spark, path).collect()] == [("00601", "MD")]


@pytest.mark.parametrize("read,header", [
    (lambda s, p: survey.read_state_aggregate(s, p, "csv"), "stateabbr,spatial_lack_insurance"),
    (lambda s, p: survey.read_zcta_table(s, p, "csv"), "ZCTA,stateabbr,spatial_lack_insurance"),
    (lambda s, p: survey.read_crosswalk(s, p), "zip,stateabbr")])
def test_csv_without_a_column_is_refused(spark, tmp_path, read, header):
    path = _csv(tmp_path, "t", header + "\n" + ",".join("1" for _ in header.split(",")) + "\n")
    with pytest.raises(KeyError):
        read(spark, path)


def test_survey_of_text_codes_without_row_numbers(spark):
    raw = spark.createDataFrame([("1", "24.0", "x", "2500"), (" 3\t", "1", None, "NaN"), ("9", "", "2", "1e3")],
                                "DIABETE4 string, _STATE string, mscode string, _BMI5 string").coalesce(1)
    rows = survey.scan_survey(raw).orderBy("resp_id").collect()
    assert [r["diabetes_raw"] for r in rows] == [1, 3, 9] and [r["state_fips"] for r in rows] == [24, 1, None]
    assert [r["metro_raw"] for r in rows] == [None, None, 2] and [r["bmi_x100"] for r in rows] == [2500, None, 1000]
    assert len({r["resp_id"] for r in rows}) == 3


def test_places_pull_without_seq_keeps_first_rows_and_all_rows(spark):
    raw = spark.createDataFrame([("21201", "MD", "ACCESS2", "n/a"), ("21201", "PA", "ACCESS2", "7"), ("21201", "PA", "ACCESS2", "8"),
                                 ("21201", "MD", "MHLTH", "3"), (None, "MD", "MHLTH", "4")],
                                "LocationID string, StateAbbr string, MeasureID string, Data_Value string").coalesce(1)
    scanned = survey.scan_places(raw, ["locationid", "stateabbr", "measureid", "data_value", "seq"])
    assert scanned.count() == 5
    (r,) = places.pivot_places(scanned).collect()
    assert (r["ZCTA"], r["spatial_lack_insurance"], r["spatial_poor_mental_health"], r["stateabbr"]) == ("21201", 7.0, 3.0, "MD")
    with pytest.raises(ValueError):
        survey.scan_places(raw.where("false"), ["locationid"])


def test_readme_path_from_raw_tables_to_quartiles(spark):
    """Tables without row numbers of ours go all the way."""
    n = 80
    county = spark.createDataFrame([(f"{24000 + i}", ["MD", "AL", "AK"][i % 3], m, str(5.0 + i % 7 + k))
                                    for i in range(12) for k, m in enumerate(["ACCESS2", "MHLTH"])],
                                   "locationid string, stateabbr string, measureid string, data_value string")
    extract = spark.createDataFrame(
        [([24, 1, 2][i % 3], 1 + i % 4, 1 + i % 2, 2, 2, 1, 2, 1 + i % 13, 1 + i % 8 if i % 5 else 77, 1 + i % 5, 1 + i % 6, 1 + i % 2,
          2000 + i, 1 + i % 4, 1, 1) for i in range(n)],
        "_STATE int, DIABETE4 int, CVDSTRK3 int, CHCOCNC1 int, _MICHD int, ASTHMA3 int, CHCCOPD3 int, _AGEG5YR int, INCOME3 int, "
        "_RACEGR3 int, EDUCA int, SEXVAR int, _BMI5 int, _SMOKER3 int, _TOTINDA int, _RFDRHV9 int")
    states = places.state_aggregate(survey.scan_places(county, ["locationid", "stateabbr", "measureid", "data_value", "seq"]))
    clean = recode.clean_survey(survey.scan_survey(extract))
    frame = impute.impute_income(modelling.join_states(clean, states)).dropna(subset=model.FEATURES + model.TARGETS)
    ev = evaluation.evaluation_frame(frame)
    assert ev.count() == n and {r["quartile"] for r in ev.collect()} == {1, 2, 3, 4}


def test_numbers_and_keys_with_white_space_and_nan(spark):
    df = spark.createDataFrame([(" 1.5\t",), ("NaN",), ("1.5d",), ("7f",), ("",), (None,), ("-2e1",), (".5",), ("inf",)], "x string")
    assert [r[0] for r in df.select(X.numeric_text("x")).collect()] == [1.5, None, None, None, None, None, -20.0, 0.5, None]
    z = spark.createDataFrame([("21201\t",), ("\n21201 ",), ("2120",), (None,)], "z string")
    assert [r[0] for r in z.select(X.is_zip5("z")).collect()] == [True, True, False, False]
    raw = spark.createDataFrame([("21201", "AL", "ACCESS2", "NaN", 1), ("21202", "AL", "ACCESS2", "4", 2), ("21202", "AL", "MHLTH", "2", 3),
                                 ("21201", "AL", "MHLTH", "6", 4)], "locationid string, stateabbr string, measureid string, data_value string, seq long")
    (r,) = places.state_aggregate(raw).collect()
    assert r["spatial_lack_insurance"] == 4.0 and not math.isnan(r["spatial_poor_mental_health"])


def test_repeated_zip_rows_answer_a_request_once(spark):
    zips = spark.createDataFrame([("21201", "PA", 3.0, 4.0), ("21201", "MD", 9.0, 1.0), ("21201", None, 1.0, 1.0)],
                                 f"ZCTA string, stateabbr string, {places.INSURANCE} double, {places.MENTAL} double")
    states = zips.where("false").select("stateabbr", places.INSURANCE, places.MENTAL)
    req = spark.createDataFrame([(1, "zip", " 21201\t", 24)], "request_id long, lookup_mode string, zip_text string, state_fips int")
    (r,) = lookup.resolve_requests(req, zips, states).collect()
    assert (r["status"], r["region_label"], r[places.INSURANCE]) == ("ok", "ZIP 21201 (MD)", 9.0)


def test_repeated_crosswalk_keys_do_not_multiply_places(spark):
    wide = spark.createDataFrame([("00601", 1.0)], "ZCTA string, v double")
    walk = spark.createDataFrame([("601", "PR"), ("601 ", "AL"), ("601", None)], "zcta string, stateabbr string")
    assert [r["stateabbr"] for r in places.resolve_state(wide, walk).collect()] == ["AL"]


def test_missing_inputs_are_filled_before_scoring(spark):
    cols = ", ".join(f"{c} double" for c in model.FEATURES)
    train = spark.createDataFrame([tuple(float(k + i) for i in range(len(model.FEATURES))) for k in range(5)], cols)
    rows = spark.createDataFrame([tuple(None for _ in model.FEATURES)], cols)
    for imputer in model.fit_imputers(train):
        rows = imputer.transform(rows)
    assert list(rows.first()) == [2.0 + i for i in range(len(model.FEATURES))]


@pytest.mark.parametrize("worst,next_pct,coding,dominant", [
    (25.04, 1.0, False, False), (25.06, 1.0, True, False), (30.04, 20.0, False, False), (30.06, 20.0, False, True), (40.0, 19.9, True, True)])
def test_warning_rules_use_one_decimal(spark, worst, next_pct, coding, dominant):
    report = spark.createDataFrame([("a", worst), ("b", next_pct), ("c", 0.0)], "column_name string, pct_missing double")
    (r,) = quality.worst_column_checks(report).collect()
    assert (r["worst_column"], r["outcome_coding_warning"], r["dominant_column_warning"]) == ("a", coding, dominant)


def test_rename_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_AGEG5YR int, BMI int, other int")
    assert recode.rename_to_features(df).columns == ["age_code", "bmi", "other"]
    assert recode.missing_columns(df, ["other", "income_code", "BMI", "zip"]) == ["income_code", "zip"]
    with pytest.raises(KeyError):
        recode.require_columns(df, ["zip"])


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 7, 8, 97])
def test_quartiles_by_value_counts_equal_ranks(spark, n):
    rows = [(i, float((i * 7) % 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "resp_id long, spatial_lack_insurance double").withColumn("x", F.lit(1))
    got = {r["resp_id"]: r["quartile"] for r in rank.disadvantage_quartile(df).collect()}
    order = [i for _, i in sorted((v, i) for i, v in rows)]
    want = {i: 1 if n <= 1 else max(1, -(-4 * r // (n - 1))) for r, i in enumerate(order)}
    assert got == want


def test_written_tables_keep_schema_and_rows(spark):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    back = sinks.materialised(df, "t")
    assert back.schema == df.schema and back.collect() == df.collect()


def test_fixed_tables_hold_these_entries():
    """Literal entries, so that a wrong table can't pass on both engines."""
    assert {k: fixed.STATE_FIPS_TO_ABBR[k] for k in (1, 2, 11, 24, 36, 56, 72)} == \
        {1: "AL", 2: "AK", 11: "DC", 24: "MD", 36: "NY", 56: "WY", 72: "PR"} and len(fixed.STATE_FIPS_TO_ABBR) == 54
    assert {k: fixed.ZIP2_TO_STATE[k] for k in ("10", "21", "60", "90")} == {"10": "NY", "21": "MD", "60": "IL", "90": "CA"}
    assert len(fixed.ZIP2_TO_STATE) == 100
    assert sorted(fixed.NATIONAL_PREVALENCE.values()) == [0.034, 0.07, 0.087, 0.12, 0.173]
    assert fixed.FEATURE_RENAME["_AGEG5YR"] == "age_code" and fixed.FEATURE_RENAME["_RFDRHV9"] == "heavy_drinking_code"
    assert (fixed.MIN_GROUP_N_FOR_MEDIAN, fixed.MIN_EQUITY_GROUP_N, fixed.MIN_MAP_SAMPLE_SIZE, fixed.GBT_ROUNDS, fixed.GBT_DEPTH) == (30, 10, 30, 200, 6)


def test_row_numbers_do_not_follow_the_splits(spark, tmp_path):
    path = str(tmp_path / "survey")
    spark.range(30_000).selectExpr("CAST(id % 5 AS INT) AS DIABETE4", "repeat('x', 60) AS pad", "CAST(id AS INT) AS _BMI5").repartition(3).write.parquet(path)
    found, parts = [], set()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            raw = spark.read.parquet(path)
            parts.add(raw.rdd.getNumPartitions())
            found.append({r["resp_id"]: r["bmi_x100"] for r in survey.scan_survey(raw).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(parts) == 2 and found[0] == found[1] and sorted(found[0]) == list(range(30_000))


def test_predictions_are_clustered_before_they_are_written(spark, tmp_path):
    df = spark.range(4_000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'CA' ELSE 'S' || CAST(id % 30 AS STRING) END AS stateabbr").repartition(16)
    path = sinks.write_table(df, str(tmp_path / "p"), partition_by=["stateabbr"])
    files = [p for p in (tmp_path / "p").rglob("*.parquet")]
    states = {p.parent.name for p in files}
    assert len(states) == 11 and len(files) <= 2 * len(states)  # not a file per task and state
    assert spark.read.parquet(path).count() == 4_000


def test_state_choice_asks_the_written_pivot(spark, monkeypatch):
    pivots = []
    make = places.materialised
    monkeypatch.setattr(places, "materialised", lambda df, name: pivots.append(name) or make(df, name))
    raw = spark.createDataFrame([("21201", "MD", "ACCESS2", "7", 1), ("21201", "MD", "MHLTH", "3", 2)],
                                "locationid string, stateabbr string, measureid string, data_value string, seq int")
    resolved = places.resolve_state(places.pivot_places(raw))
    assert pivots == ["pivoted-places"] and "Aggregate" not in resolved._jdf.queryExecution().optimizedPlan().toString()
    assert resolved.first()["state_source"] == "response"
