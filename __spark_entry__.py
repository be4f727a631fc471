"""

``entry(spark)`` runs the flagship query on sf0.001; ``queries()`` maps each
-> DataFrame; ``oracle_sql()`` gives the DuckDB twin for every query whose
values plain SQL can state.  Column names match between the two.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_queries as OQ  # noqa: E402
from riskfabric.functions import exprs as X  # noqa: E402
from riskfabric.functions import fixed  # noqa: E402
from riskfabric.operators import forest, impute, lookup, metrics, model, places, quality, rank, recode, risk  # noqa: E402
from riskfabric.plans import evaluation, modelling  # noqa: E402
from riskfabric.plans import requests as requests_plan  # noqa: E402
from riskfabric.plans import training  # noqa: E402
from riskfabric.session import ensure_checkpoint_dir, shared_path  # noqa: E402
from riskfabric.sources import standins, survey  # noqa: E402
from riskfabric.sources import sinks  # noqa: E402

SF0001 = "/root/testdata/sf0.001"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str, select: str | None = None):
    """Register a Spark query and, when given, its DuckDB twin."""
    def deco(fn):
        QUERIES[name] = fn
        if select is not None:
            OQ.q(name, select)
        return fn
    return deco


# ---------------------------------------------------------------------------
# Flagship: survey -> recodes -> place pivot -> state means -> join ->
# diabetes prevalence and n per state, with the n >= 30 trust flag.
# ---------------------------------------------------------------------------
@register("flagship_state_prevalence", f"""
SELECT stateabbr, count(*) AS n, avg(target_diabetes) AS diabetes_prevalence,
       min(spatial_lack_insurance) AS spatial_lack_insurance,
       count(*) >= {fixed.MIN_MAP_SAMPLE_SIZE} AS enough
FROM joined GROUP BY stateabbr""")
def flagship_state_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = modelling.joined_frame(spark, sf_dir)
    return joined.groupBy("stateabbr").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("target_diabetes").alias("diabetes_prevalence"),
        F.min("spatial_lack_insurance").alias("spatial_lack_insurance"),
        (F.count(F.lit(1)) >= fixed.MIN_MAP_SAMPLE_SIZE).alias("enough"),
    )


# ---------------------------------------------------------------------------
# 2.1 scans and sinks
# ---------------------------------------------------------------------------
_EXTRACT_NAMES = {ours: extract for extract, ours in fixed.SURVEY_COLUMNS.items()}


@register("s1_survey_scan", "SELECT resp_id, " + ", ".join(
    f"CAST({c} AS INTEGER) AS {c}" for c in [
        "state_fips", "diabetes_raw", "stroke_raw", "asthma_raw", "copd_raw", "cancer_raw", "michd_raw",
        "age_raw", "sex_raw", "income_raw", "race_raw", "educa_raw", "bmi_x100", "smoker_raw",
        "activity_raw", "drinking_raw", "metro_raw", "genhlth_raw"]) + " FROM respondents")
def s1_survey_scan(spark, sf_dir):
    # the extract carries its own column names; the scan maps them to ours
    raw = standins.respondents(spark, sf_dir)
    extract = raw.withColumnsRenamed({c: _EXTRACT_NAMES[c] for c in raw.columns if c in _EXTRACT_NAMES})
    return survey.scan_survey(extract)


@register("s2_places_scan", "SELECT locationid, stateabbr, measureid, data_value, seq FROM places_county")
def s2_places_scan(spark, sf_dir):
    raw = standins.places_county(spark, sf_dir)
    upper = raw.toDF(*[c.upper() for c in raw.columns])
    return survey.scan_places(upper, ["locationid", "stateabbr", "measureid", "data_value", "seq"])


# ---------------------------------------------------------------------------
# 2.2 projections, recodes, filters
# ---------------------------------------------------------------------------
@register("p1_state_abbr", "SELECT resp_id, state_fips, stateabbr FROM clean_all JOIN respondents USING (resp_id)")
def p1_state_abbr(spark, sf_dir):
    raw = standins.respondents(spark, sf_dir)
    return raw.select("resp_id", "state_fips", recode.state_abbr("state_fips").alias("stateabbr"))


@register("p2_sentinel_codes", "SELECT resp_id, income_code, age_code, race_code, educa_code FROM clean_all")
def p2_sentinel_codes(spark, sf_dir):
    raw = standins.respondents(spark, sf_dir)
    return raw.select(
        "resp_id",
        X.null_if_in("income_raw", fixed.INCOME_INVALID).cast("int").alias("income_code"),
        X.null_if_in("age_raw", fixed.AGE_INVALID).cast("int").alias("age_code"),
        X.null_if_in("race_raw", fixed.SINGLE_NINE).cast("int").alias("race_code"),
        X.null_if_in("educa_raw", fixed.SINGLE_NINE).cast("int").alias("educa_code"),
    )


def _clean_all(spark, sf_dir):
    return recode.clean_survey(standins.respondents(spark, sf_dir), drop_missing_targets=False)


@register("p3_diabetes_binary", "SELECT resp_id, target_diabetes FROM clean_all")
def p3_diabetes_binary(spark, sf_dir):
    return _clean_all(spark, sf_dir).select("resp_id", "target_diabetes")


@register("p4_two_code_binary", "SELECT resp_id, target_stroke, target_cancer FROM clean_all")
def p4_two_code_binary(spark, sf_dir):
    return _clean_all(spark, sf_dir).select("resp_id", "target_stroke", "target_cancer")


@register("p5_cardio_binary", "SELECT resp_id, target_cardio FROM clean_all")
def p5_cardio_binary(spark, sf_dir):
    return _clean_all(spark, sf_dir).select("resp_id", "target_cardio")


@register("p6_respiratory_either", """
SELECT r.resp_id, r.asthma_raw, r.copd_raw, c.target_chronic_respiratory
FROM respondents r JOIN clean_all c USING (resp_id)""")
def p6_respiratory_either(spark, sf_dir):
    raw = standins.respondents(spark, sf_dir)
    return raw.select("resp_id", "asthma_raw", "copd_raw",
                      X.either_target("asthma_raw", "copd_raw").cast("int")
                      .alias("target_chronic_respiratory"))


@register("p7_rule_violations", f"""
SELECT CAST(count_if(sex_raw IS NULL OR sex_raw NOT IN (1, 2)) AS BIGINT) AS bad_sex,
       CAST(count_if(CAST(bmi_x100 AS DOUBLE) / 100.0::DOUBLE < 12 OR CAST(bmi_x100 AS DOUBLE) / 100.0::DOUBLE > 100) AS BIGINT) AS bad_bmi,
       CAST(count_if(({OQ.STATE_ABBR}) IS NULL) AS BIGINT) AS unmapped_state,
       CAST(count_if(income_raw NOT IN (77, 99) AND income_raw > {fixed.INCOME_MAX}) AS BIGINT) AS income_above_scale,
       CAST(count_if(metro_raw NOT BETWEEN 1 AND 5) AS BIGINT) AS bad_metro,
       count(*) AS n_rows
FROM respondents""")
def p7_rule_violations(spark, sf_dir):
    return recode.rule_violations(standins.respondents(spark, sf_dir))


@register("p8_bmi_range", "SELECT r.resp_id, r.bmi_x100, c.bmi FROM respondents r JOIN clean_all c USING (resp_id)")
def p8_bmi_range(spark, sf_dir):
    raw = standins.respondents(spark, sf_dir)
    return raw.select("resp_id", "bmi_x100", X.bmi_from_x100("bmi_x100").alias("bmi"))


@register("p9_covariate_codes", """
SELECT resp_id, income_code, age_code, race_code, educa_code, sex_code, smoker_code,
       physical_activity_code, heavy_drinking_code, general_health_code, metro_code, bmi FROM clean_all""")
def p9_covariate_codes(spark, sf_dir):
    return _clean_all(spark, sf_dir).select(
        "resp_id", "income_code", "age_code", "race_code", "educa_code", "sex_code",
        "smoker_code", "physical_activity_code", "heavy_drinking_code", "general_health_code", "metro_code", "bmi")


@register("p10_drop_raw_columns", "SELECT * FROM clean_all")
def p10_drop_raw_columns(spark, sf_dir):
    return _clean_all(spark, sf_dir)


@register("p11_feature_names", "SELECT * FROM clean")
def p11_feature_names(spark, sf_dir):
    # a cleaned table under the extract's names -> the model's names
    back = {ours: extract for extract, ours in fixed.FEATURE_RENAME.items()}
    cleaned = recode.clean_survey(standins.respondents(spark, sf_dir)).withColumnsRenamed(back)
    return recode.rename_to_features(cleaned)


_ASKED = fixed.FEATURE_COLUMNS + fixed.TARGET_COLUMNS


@register("p14_required_columns", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, FALSE AS present, CAST(NULL AS BIGINT) AS n_filled" if c.startswith("spatial")
    else f"SELECT '{c}', TRUE, count({c}) FROM clean_all"
    for c in sorted(_ASKED, key=lambda c: not c.startswith("spatial"))))
def p14_required_columns(spark, sf_dir):
    # what the modelling frame needs, before the place join: which columns the cleaned survey lacks
    df = _clean_all(spark, sf_dir)
    missing = recode.missing_columns(df, _ASKED)
    there = [c for c in _ASKED if c not in missing]
    found = df.agg(*[F.count(c).alias(c) for c in there]).withColumn("_k", F.lit(True)) \
        .unpivot("_k", there, "column_name", "n_filled")
    absent = spark.createDataFrame([(c,) for c in missing], "column_name string") \
        .select("column_name", F.lit(False).alias("present"), F.lit(None).cast("long").alias("n_filled"))
    return found.select("column_name", F.col("_k").alias("present"), "n_filled").unionByName(absent)


@register("p12_listwise_targets", "SELECT * FROM clean")
def p12_listwise_targets(spark, sf_dir):
    return recode.clean_survey(standins.respondents(spark, sf_dir))


@register("p13_modelling_frame", "SELECT * FROM model_frame")
def p13_modelling_frame(spark, sf_dir):
    return modelling.written_frame(spark, sf_dir)


@register("p15_drop_rollup", "SELECT * FROM pc_wide WHERE stateabbr IS NOT NULL AND stateabbr <> 'US'")
def p15_drop_rollup(spark, sf_dir):
    return places.drop_rollup(places.pivot_places(standins.places_county(spark, sf_dir), standins.MEASURES))


@register("p16_lowercase_names", "SELECT locationid, stateabbr, measureid, data_value, seq FROM places_county")
def p16_lowercase_names(spark, sf_dir):
    raw = standins.places_county(spark, sf_dir)
    return places.lowercase_columns(raw.toDF(*[c.upper() for c in raw.columns]))


@register("p17_first_state", "SELECT ZCTA, stateabbr FROM pc_state")
def p17_first_state(spark, sf_dir):
    wide = places.pivot_places(standins.places_county(spark, sf_dir), standins.MEASURES).select("ZCTA", "stateabbr")
    return wide.unionByName(_states_of_all_null(spark, sf_dir))


def _states_of_all_null(spark, sf_dir):
    # locations whose measures are all null are dropped by the pivot but
    # still have a first row; report them too
    vals = places.measure_values(standins.places_county(spark, sf_dir))
    return (vals.groupBy("ZCTA")
            .agg(F.min_by("stateabbr", F.struct("seq", "measureid")).alias("stateabbr"),
                 F.count("value").alias("_n"))
            .filter(F.col("_n") == 0).drop("_n"))


@register("p18_numeric_coercion", "SELECT ZCTA, measureid, data_value, value, seq FROM pc_values")
def p18_numeric_coercion(spark, sf_dir):
    vals = places.measure_values(standins.places_county(spark, sf_dir))
    return vals.select("ZCTA", "measureid", "data_value", "value", "seq")


# ---------------------------------------------------------------------------
# 2.4 place aggregations and 2.3 joins
# ---------------------------------------------------------------------------
@register("a2_pivot_places", "SELECT * FROM pc_wide")
def a2_pivot_places(spark, sf_dir):
    return places.pivot_places(standins.places_county(spark, sf_dir), standins.MEASURES)


@register("a1_state_means", "SELECT * FROM state_avg")
def a1_state_means(spark, sf_dir):
    return modelling.state_table(spark, sf_dir)


@register("j1_join_states", "SELECT * FROM joined")
def j1_join_states(spark, sf_dir):
    return modelling.joined_frame(spark, sf_dir)


@register("j2_pivot_with_state", "SELECT ZCTA, stateabbr, spatial_lack_insurance, spatial_poor_mental_health FROM pc_wide")
def j2_pivot_with_state(spark, sf_dir):
    return places.pivot_places(standins.places_county(spark, sf_dir), standins.MEASURES).select(
        "ZCTA", "stateabbr", places.INSURANCE, places.MENTAL)


@register("a3_impute_income", "SELECT resp_id, income_code, income_code_imputed, imputation_tier FROM imputed")
def a3_impute_income(spark, sf_dir):
    return modelling.imputed_frame(spark, sf_dir).select(
        "resp_id", "income_code", "income_code_imputed", "imputation_tier")


@register("j9_income_medians", f"""
SELECT '{fixed.TIER_CELL}' AS tier, age_code, educa_code, m AS median, n, n >= {fixed.MIN_GROUP_N_FOR_MEDIAN} AS usable FROM med_cell
UNION ALL SELECT '{fixed.TIER_EDUCATION}', NULL, educa_code, m, n, n >= {fixed.MIN_GROUP_N_FOR_MEDIAN} FROM med_edu
UNION ALL SELECT '{fixed.TIER_OVERALL}', NULL, NULL, m, n, TRUE FROM med_all""")
def j9_income_medians(spark, sf_dir):
    return impute.income_medians(modelling.joined_frame(spark, sf_dir))


@register("a4_tier_usage", """
SELECT imputation_tier AS tier, count(*) AS n_imputed,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM imputed) AS share_of_rows
FROM imputed WHERE income_code_imputed GROUP BY imputation_tier""")
def a4_tier_usage(spark, sf_dir):
    return modelling.tier_usage(spark, sf_dir)


# ---------------------------------------------------------------------------
# 2.5 windows, 2.11 split, 2.4 metrics on the held-out rows (reference score)
# ---------------------------------------------------------------------------
def _heldout_scores(spark, sf_dir):
    # the evaluation frame (quartiles cut on all rows, then the split) is
    # built once per session and input, as one training run builds it once
    test = training.eval_frame(spark, sf_dir).filter(F.col("is_test"))
    return evaluation.long_scores(test)


@register("w1_disadvantage_quartile", """
SELECT resp_id, spatial_lack_insurance, quartile, (""" + OQ.QUARTILE_LABEL + """) AS quartile_label FROM ev""")
def w1_disadvantage_quartile(spark, sf_dir):
    ev = rank.disadvantage_quartile(modelling.written_frame(spark, sf_dir))
    return ev.select("resp_id", "spatial_lack_insurance", "quartile", "quartile_label")


@register("m1_holdout_split", "SELECT resp_id, is_test FROM ev")
def m1_holdout_split(spark, sf_dir):
    return modelling.written_frame(spark, sf_dir).select(
        "resp_id", evaluation.holdout_flag().alias("is_test"))


@register("a11_prevalence", "SELECT * FROM prev")
def a11_prevalence(spark, sf_dir):
    return metrics.prevalence(_heldout_scores(spark, sf_dir))


@register("a12_macro_f1", """
SELECT target, n, round_even((
  COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0.0), 0.0)
  + COALESCE(CAST(2 * tn AS DOUBLE) / NULLIF(CAST(2 * tn + fn + fp AS DOUBLE), 0.0), 0.0)) / 2, 4) AS macro_f1
FROM conf WHERE quartile IS NULL""")
def a12_macro_f1(spark, sf_dir):
    return metrics.macro_f1(_heldout_scores(spark, sf_dir))


@register("a13_roc_auc", """
SELECT target, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  round_even(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
    sum(CAST(pos AS DOUBLE) * (CAST(neg_below AS DOUBLE) + CAST(neg AS DOUBLE) / 2.0::DOUBLE))
    / CAST(sum(pos) * sum(neg) AS DOUBLE) END, 4) AS roc_auc
FROM (SELECT *, sum(neg) OVER (PARTITION BY target ORDER BY p ROWS UNBOUNDED PRECEDING) - neg AS neg_below FROM sc) t
GROUP BY target""")
def a13_roc_auc(spark, sf_dir):
    return metrics.roc_auc(_heldout_scores(spark, sf_dir))


@register("a14_average_precision", "SELECT * FROM ap")
def a14_average_precision(spark, sf_dir):
    return metrics.average_precision(_heldout_scores(spark, sf_dir))


@register("w2_pr_curve", """
SELECT c.*, b.baseline FROM (
  SELECT target, threshold, precision, recall, FALSE AS is_end FROM pr_pts
  UNION ALL SELECT DISTINCT target, NULL, 1.0::DOUBLE, 0.0::DOUBLE, TRUE FROM heldout) c
JOIN (SELECT target, avg(y) AS baseline FROM heldout GROUP BY target) b USING (target)""")
def w2_pr_curve(spark, sf_dir):
    return metrics.pr_curve(_heldout_scores(spark, sf_dir))


@register("w3_operating_point", f"""
SELECT target, round_even(threshold, 4) AS threshold, round_even(precision, 4) AS precision,
       round_even(recall, 4) AS recall, round_even(f1, 4) AS f1
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY f1 DESC, threshold ASC) AS rn
      FROM (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                      ELSE 0.0 END AS f1 FROM pr_pts) a
      WHERE target = '{fixed.PRIMARY_TARGET}') b WHERE rn = 1""")
def w3_operating_point(spark, sf_dir):
    return metrics.operating_point(metrics.pr_curve(_heldout_scores(spark, sf_dir)))


@register("a10_equity_audit", f"""
SELECT {OQ.TARGET_DISPLAY} AS target, {OQ.QUARTILE_LABEL} AS "group", n,
  round_even(CAST(fp AS DOUBLE) / NULLIF(CAST(fp + tn AS DOUBLE), 0.0), 4) AS fpr,
  round_even(CAST(fn AS DOUBLE) / NULLIF(CAST(fn + tp AS DOUBLE), 0.0), 4) AS fnr
FROM conf WHERE quartile IS NOT NULL AND n >= {fixed.MIN_EQUITY_GROUP_N}""")
def a10_equity_audit(spark, sf_dir):
    return metrics.equity_audit(_heldout_scores(spark, sf_dir))


@register("a18_lift", """
SELECT target, pr_auc, prevalence,
  CASE WHEN pr_auc <> 0 AND prevalence <> 0 THEN pr_auc / prevalence END AS lift
FROM ap JOIN prev USING (target)""")
def a18_lift(spark, sf_dir):
    scores = _heldout_scores(spark, sf_dir)
    return metrics.lift(metrics.average_precision(scores), metrics.prevalence(scores))


# ---------------------------------------------------------------------------
# 2.4 quality reports
# ---------------------------------------------------------------------------
_REQUIRED = fixed.FEATURE_COLUMNS + fixed.TARGET_COLUMNS


@register("a5_missingness", OQ.missing_rows("imputed", _REQUIRED))
def a5_missingness(spark, sf_dir):
    return modelling.missingness(spark, sf_dir)


@register("a6_target_missingness_check", OQ.worst_check("clean_all", fixed.TARGET_COLUMNS))
def a6_target_missingness_check(spark, sf_dir):
    rep = quality.missingness(_clean_all(spark, sf_dir), fixed.TARGET_COLUMNS)
    return quality.worst_column_checks(rep)


@register("a6_feature_missingness_check", OQ.worst_check("imputed", _REQUIRED))
def a6_feature_missingness_check(spark, sf_dir):
    return quality.worst_column_checks(modelling.missingness(spark, sf_dir))


@register("a7_attrition_ledger", """
SELECT step_no, step, rows_before, rows_after,
  CASE WHEN rows_before > 0 THEN CAST(rows_before - rows_after AS DOUBLE) * 100 / rows_before ELSE 0.0 END AS pct_lost,
  CASE WHEN rows_before > 0 THEN CAST(rows_before - rows_after AS DOUBLE) * 100 / rows_before ELSE 0.0 END > 15 AS warn
FROM (
  SELECT 1 AS step_no, 'target_listwise' AS step, (SELECT count(*) FROM clean_all) AS rows_before, (SELECT count(*) FROM clean) AS rows_after
  UNION ALL SELECT 2, 'state_join', (SELECT count(*) FROM clean), (SELECT count(*) FROM joined)
  UNION ALL SELECT 3, 'feature_listwise', (SELECT count(*) FROM imputed), (SELECT count(*) FROM model_frame)) t""")
def a7_attrition_ledger(spark, sf_dir):
    return modelling.attrition_ledger(spark, sf_dir)


# ---------------------------------------------------------------------------
# 2.3 state resolution for the ZCTA pull (J3, J4), key shape
# ---------------------------------------------------------------------------
@register("j4_zip_prefix_state", "SELECT * FROM zcta_prefix")
def j4_zip_prefix_state(spark, sf_dir):
    return places.resolve_state(places.pivot_places(standins.places_zcta(spark, sf_dir), standins.MEASURES))


@register("j3_crosswalk_state", f"""
SELECT w.*, x.stateabbr, CASE WHEN x.stateabbr IS NOT NULL THEN 'crosswalk' END AS state_source
FROM pz_wide w LEFT JOIN crosswalk_one x USING (ZCTA)""")
def j3_crosswalk_state(spark, sf_dir):
    return places.resolve_state(places.pivot_places(standins.places_zcta(spark, sf_dir), standins.MEASURES),
                                standins.crosswalk(spark, sf_dir))


_ZIP_LIKE = f"coalesce(regexp_matches({OQ._strip('locationid')}, '^[0-9]{{5}}$'), false)"


@register("a8_zip_key_shape", f"""
SELECT count(*) AS n_rows, CAST(count_if({_ZIP_LIKE}) AS BIGINT) AS n_zip_like,
  avg(CAST({_ZIP_LIKE} AS DOUBLE)) AS zip_like_share,
  avg(CAST({_ZIP_LIKE} AS DOUBLE)) < 0.9 AS warn_low_share
FROM places_zcta""")
def a8_zip_key_shape(spark, sf_dir):
    return places.zip_shape_report(standins.places_zcta(spark, sf_dir))


@register("a8_unresolved_states", """
SELECT count(*) AS n_zcta, CAST(count_if(stateabbr IS NULL) AS BIGINT) AS n_unresolved FROM zcta_prefix""")
def a8_unresolved_states(spark, sf_dir):
    t = places.resolve_state(places.pivot_places(standins.places_zcta(spark, sf_dir), standins.MEASURES))
    return t.agg(F.count(F.lit(1)).alias("n_zcta"),
                 F.count_if(F.col("stateabbr").isNull()).alias("n_unresolved"))


@register("a8_crosswalk_unmatched", f"""
SELECT count(*) AS n_zcta, CAST(count_if(x.stateabbr IS NULL) AS BIGINT) AS n_unmatched
FROM pz_wide w LEFT JOIN crosswalk_one x USING (ZCTA)""")
def a8_crosswalk_unmatched(spark, sf_dir):
    t = places.resolve_state(places.pivot_places(standins.places_zcta(spark, sf_dir), standins.MEASURES),
                             standins.crosswalk(spark, sf_dir))
    return t.agg(F.count(F.lit(1)).alias("n_zcta"),
                 F.count_if(F.col("stateabbr").isNull()).alias("n_unmatched"))


# ---------------------------------------------------------------------------
# 2.1 scans and sinks through the shared folder
# ---------------------------------------------------------------------------
@register("s3_crosswalk_scan", f"SELECT {OQ._zfill5(OQ._strip('zcta'))} AS ZCTA, stateabbr FROM crosswalk")
def s3_crosswalk_scan(spark, sf_dir):
    path = shared_path(spark, "crosswalk_csv")
    # columns in another order than the schema's: the header decides
    standins.crosswalk(spark, sf_dir).select("stateabbr", "zcta").write.mode("overwrite").option("header", "true").csv(path)
    return survey.read_crosswalk(spark, path)


@register("s4_state_aggregate_scan", "SELECT * FROM state_avg")
def s4_state_aggregate_scan(spark, sf_dir):
    path = shared_path(spark, "state_aggregate_csv")
    modelling.state_table(spark, sf_dir).select(places.MENTAL, "stateabbr", places.INSURANCE) \
        .write.mode("overwrite").option("header", "true").csv(path)
    return survey.read_state_aggregate(spark, path, fmt="csv")


@register("s5_zcta_table_scan", "SELECT * FROM zcta_tbl")
def s5_zcta_table_scan(spark, sf_dir):
    path = sinks.write_table(requests_plan.zcta_table(spark, sf_dir), shared_path(spark, "zcta_table"))
    return survey.read_zcta_table(spark, path)


@register("s8_predictions_sink", "SELECT * FROM preds")
def s8_predictions_sink(spark, sf_dir):
    preds = _reference_predictions(spark, sf_dir)
    path = sinks.write_table(preds, shared_path(spark, "predictions"), partition_by=["stateabbr"])
    return survey.read_predictions(spark, path).select(*preds.columns)


# ---------------------------------------------------------------------------
# requests: lookups, BMI, feature rows, placeholder score, comparison
# ---------------------------------------------------------------------------
_RES_COLS = ["request_id", "lookup_mode", "zip_text", "zip_valid", "status", "region_label",
             "spatial_lack_insurance", "spatial_poor_mental_health"]


@register("j5_request_lookup", "SELECT " + ", ".join(_RES_COLS) + " FROM res")
def j5_request_lookup(spark, sf_dir):
    return requests_plan.resolved_requests(spark, sf_dir).select(*_RES_COLS)


@register("j6_state_lookup", "SELECT " + ", ".join(_RES_COLS) + " FROM res WHERE lookup_mode = 'state'")
def j6_state_lookup(spark, sf_dir):
    return requests_plan.resolved_requests(spark, sf_dir).filter(
        F.col("lookup_mode") == "state").select(*_RES_COLS)


@register("p20_zip_validity", "SELECT request_id, zip_text, zip_valid FROM res")
def p20_zip_validity(spark, sf_dir):
    return standins.requests(spark, sf_dir).select(
        "request_id", "zip_text", X.is_zip5("zip_text").alias("zip_valid"))


@register("p21_request_bmi", """
SELECT request_id, height_ft, height_in, weight_lbs,
  CASE WHEN height_ft * 12 + height_in > 0 THEN 703 * weight_lbs / ((height_ft * 12 + height_in) * (height_ft * 12 + height_in)) END AS bmi
FROM req""")
def p21_request_bmi(spark, sf_dir):
    r = standins.requests(spark, sf_dir)
    return r.select("request_id", "height_ft", "height_in", "weight_lbs", lookup.request_bmi(r).alias("bmi"))


@register("p22_feature_rows", "SELECT request_id, " + ", ".join(
    ("CASE WHEN height_ft * 12 + height_in > 0 THEN 703 * weight_lbs / ((height_ft * 12 + height_in) * (height_ft * 12 + height_in)) END AS bmi"
     if c == "bmi" else f"CAST({c} AS DOUBLE) AS {c}") for c in fixed.FEATURE_COLUMNS) + " FROM res")
def p22_feature_rows(spark, sf_dir):
    return lookup.feature_rows(requests_plan.resolved_requests(spark, sf_dir))


@register("p23_fallback_scores", "SELECT * FROM fallback")
def p23_fallback_scores(spark, sf_dir):
    return lookup.fallback_scores(requests_plan.resolved_requests(spark, sf_dir))


@register("j7_prevalence_comparison", """
SELECT f.condition, f.request_id, f.target, f.score, f.score_kind, p.prevalence AS sample_prevalence,
  n.national_prevalence, f.score - n.national_prevalence AS delta_vs_national
FROM fallback f LEFT JOIN prev p USING (target) LEFT JOIN national n USING (condition)""")
def j7_prevalence_comparison(spark, sf_dir):
    scores = lookup.fallback_scores(requests_plan.resolved_requests(spark, sf_dir))
    return lookup.compare_to_prevalence(scores, metrics.prevalence(_heldout_scores(spark, sf_dir)))


# ---------------------------------------------------------------------------
# map and chart tables
# ---------------------------------------------------------------------------
def _reference_predictions(spark, sf_dir):
    mf = modelling.written_frame(spark, sf_dir)
    return mf.select("resp_id", *fixed.PREDICTION_COLUMNS, *[
        evaluation.reference_score(i).alias(f"pred_{t}") for i, t in enumerate(fixed.TARGET_COLUMNS)])


@register("a9_demographic_risk", "\nUNION ALL\n".join(
    f"SELECT '{tr}' AS trait, CAST({tr} AS INTEGER) AS trait_value, stateabbr, '{t}' AS target, count(*) AS n, "
    f"avg(pred_{t}) * 100 AS mean_risk_pct, count(*) >= {fixed.MIN_MAP_SAMPLE_SIZE} AS enough "
    f"FROM preds WHERE stateabbr IS NOT NULL AND {tr} IS NOT NULL GROUP BY {tr}, stateabbr"
    for tr in fixed.DEMOGRAPHIC_TRAITS for t in fixed.TARGET_COLUMNS))
def a9_demographic_risk(spark, sf_dir):
    return risk.demographic_risk_by_state(_reference_predictions(spark, sf_dir))


@register("a16_distinct_states", """
SELECT stateabbr, (SELECT count(DISTINCT stateabbr) FROM state_avg WHERE stateabbr IS NOT NULL) AS n_states
FROM (SELECT DISTINCT stateabbr FROM state_avg WHERE stateabbr IS NOT NULL) t""")
def a16_distinct_states(spark, sf_dir):
    return risk.distinct_states(modelling.state_table(spark, sf_dir))


def _bins_sql(table: str, col: str, bins: int = fixed.MAP_BINS) -> str:
    step = "((m.hi - m.lo) / 5.0::DOUBLE)"
    edges = [f"(m.lo + {i} * {step})" for i in range(bins)] + ["m.hi"]
    b = "1 + " + " + ".join(f"CAST(s.{col} >= {edges[i]} AS INTEGER)" for i in range(1, bins))
    ok = f"(m.lo IS NOT NULL AND m.hi IS NOT NULL AND m.lo <> m.hi AND s.{col} IS NOT NULL)"
    lo_e = "CASE " + " ".join(f"WHEN ({b}) = {i + 1} THEN {edges[i]}" for i in range(bins)) + " END"
    hi_e = "CASE " + " ".join(f"WHEN ({b}) = {i + 1} THEN {edges[i + 1]}" for i in range(bins)) + " END"
    return (f"SELECT s.*, CASE WHEN {ok} THEN {b} END AS bin, CASE WHEN {ok} THEN {lo_e} END AS bin_lo, "
            f"CASE WHEN {ok} THEN {hi_e} END AS bin_hi FROM {table} s, "
            f"(SELECT min({col}) AS lo, max({col}) AS hi FROM {table}) m")


@register("a17_equal_width_bins", _bins_sql("state_avg", "spatial_lack_insurance"))
def a17_equal_width_bins(spark, sf_dir):
    return risk.equal_width_bins(modelling.state_table(spark, sf_dir), "spatial_lack_insurance")


def _reference_document(spark, sf_dir):
    scores = _heldout_scores(spark, sf_dir)
    ev = training.eval_frame(spark, sf_dir)
    n = ev.agg(F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train")).first()
    op = metrics.operating_point(metrics.pr_curve(scores)).first()
    return sinks.eval_document(metrics.summary(scores), op, n["train"], n["test"], "reference_score",
                               fixed.TARGET_DISPLAY_NAMES[fixed.PRIMARY_TARGET])


_MAPS = ("macro_f1", "roc_auc", "pr_auc", "prevalence")


@register("s9_reference_document", f"""
SELECT {OQ.TARGET_DISPLAY} AS condition, f.macro_f1, r.roc_auc, a.pr_auc, p.prevalence,
  (SELECT count(*) FROM ev WHERE NOT is_test) AS n_train, (SELECT count(*) FROM ev WHERE is_test) AS n_test, 'reference_score' AS model_backend
FROM ({OQ.SELECTS["a12_macro_f1"]}) f JOIN ({OQ.SELECTS["a13_roc_auc"]}) r USING (target) JOIN ap a USING (target) JOIN prev p USING (target)""")
def s9_reference_document(spark, sf_dir):
    # the document's text, read again: a row per condition
    maps = ", ".join(f"{m}_by_target map<string,double>" for m in _MAPS)
    doc = _reference_document(spark, sf_dir).select(F.from_json("document", f"model_backend string, n_train long, n_test long, {maps}").alias("d"))
    first = doc.select("d.*", F.explode(f"d.{_MAPS[0]}_by_target").alias("condition", _MAPS[0]))
    return first.select("condition", _MAPS[0], *[F.try_element_at(F.col(f"{m}_by_target"), F.col("condition")).alias(m) for m in _MAPS[1:]],
                        "n_train", "n_test", "model_backend")


@register("s7_reference_artifacts", f"""
SELECT 'eval_metrics' AS artifact, CAST(1 AS BIGINT) AS n_rows
UNION ALL SELECT 'equity', (SELECT count(*) FROM ({OQ.SELECTS["a10_equity_audit"]}) e)
UNION ALL SELECT 'importance', (SELECT count(*) FROM perm_imp)
UNION ALL SELECT 'precision_recall', (SELECT count(*) + 1 FROM pr_pts WHERE target = '{fixed.PRIMARY_TARGET}')""")
def s7_reference_artifacts(spark, sf_dir):
    # all four artefacts written and scanned again
    found = _scanned_artifacts(spark, sf_dir)
    out = None
    for name, table in sorted(found.items()):
        part = table.agg(F.lit(name).alias("artifact"), F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionByName(part)
    return out


@register("s7_reference_contents", f"""
SELECT 'equity' AS artifact, target AS name, "group" AS item, CAST(n AS DOUBLE) AS a, fpr AS b, fnr AS c FROM ({OQ.SELECTS["a10_equity_audit"]}) e
UNION ALL SELECT 'importance', feature, target, importance, NULL, NULL FROM perm_imp
UNION ALL SELECT 'precision_recall', target, CASE WHEN is_end THEN 'end' ELSE 'point' END, threshold, precision, recall
FROM ({OQ.SELECTS["w2_pr_curve"]}) p WHERE target = '{fixed.PRIMARY_TARGET}'""")
def s7_reference_contents(spark, sf_dir):
    # the rows of the three tables as they are scanned again (the document's are in s9_reference_document)
    found = _scanned_artifacts(spark, sf_dir)
    null = F.lit(None).cast("double")
    equity = found["equity"].select(F.lit("equity").alias("artifact"), F.col("target").alias("name"), F.col("group").alias("item"),
                                    F.col("n").cast("double").alias("a"), F.col("fpr").alias("b"), F.col("fnr").alias("c"))
    importance = found["importance"].select(F.lit("importance").alias("artifact"), F.col("feature").alias("name"), F.col("target").alias("item"),
                                            F.col("importance").alias("a"), null.alias("b"), null.alias("c"))
    curve = found["precision_recall"].select(
        F.lit("precision_recall").alias("artifact"), F.col("target").alias("name"),
        F.when(F.col("is_end"), F.lit("end")).otherwise(F.lit("point")).alias("item"),
        F.col("threshold").alias("a"), F.col("precision").alias("b"), F.col("recall").alias("c"))
    return equity.unionByName(importance).unionByName(curve)


def _scanned_artifacts(spark, sf_dir):
    base = shared_path(spark, "eval")
    _reference_document(spark, sf_dir).write.mode("overwrite").text(f"{base}/eval_metrics")
    scores = _heldout_scores(spark, sf_dir)
    sinks.write_table(metrics.equity_audit(scores), f"{base}/equity")
    sinks.write_table(metrics.pr_curve(scores).filter(F.col("target") == fixed.PRIMARY_TARGET), f"{base}/precision_recall")
    sinks.write_table(_reference_importance(spark, sf_dir), f"{base}/importance")
    return survey.read_eval_artifacts(spark, base)


@register("m6_reference_shapley_values", "SELECT * FROM sh_phi")
def m6_reference_shapley_values(spark, sf_dir):
    test = training.eval_frame(spark, sf_dir).filter(F.col("is_test"))
    scorer = model.expression_scorer({t: evaluation.reference_score(i)
                                      for i, t in enumerate(fixed.TARGET_COLUMNS)})
    return model.sampled_shapley(test, scorer)


# permutation importance with the SQL-checkable reference score as the
# scorer, and the importance tables built on it
def _reference_importance(spark, sf_dir):
    test = training.eval_frame(spark, sf_dir).filter(F.col("is_test"))
    scorer = model.expression_scorer({t: evaluation.reference_score(i)
                                      for i, t in enumerate(fixed.TARGET_COLUMNS)})
    return model.permutation_importance(test, scorer, method="permutation_reference_score")


@register("m5_reference_permutation_importance", OQ.permutation_sql())
def m5_reference_permutation_importance(spark, sf_dir):
    return _reference_importance(spark, sf_dir)


@register("a15_importance_summary", """
SELECT feature, method, round_even(avg(importance), 12) AS importance,
  COALESCE(""" + OQ.FEATURE_DISPLAY + """, feature) AS feature_display
FROM perm_imp GROUP BY feature, method""")
def a15_importance_summary(spark, sf_dir):
    return risk.importance_summary(_reference_importance(spark, sf_dir))


@register("a15_importance_by_target", "SELECT feature, " + ", ".join(
    f"avg(CASE WHEN target = '{t}' THEN importance END) AS {t}" for t in fixed.TARGET_COLUMNS)
    + ", " + OQ.FEATURE_ORDER + " AS feature_order FROM perm_imp GROUP BY feature")
def a15_importance_by_target(spark, sf_dir):
    return risk.importance_by_target(_reference_importance(spark, sf_dir))


# ---------------------------------------------------------------------------
# 2.11 model jobs on a stand-in node table (M3, M4, M6, M7, S6, S10): values checked without a fit
# ---------------------------------------------------------------------------
def _standin_forest() -> forest.Forest:
    names = [c.split()[0] for c in forest.SCHEMA.split(", ")]
    return forest.Forest.of_rows((dict(zip(names, r)) for r in standins.forest_rows()), fixed.FEATURE_COLUMNS, fixed.TARGET_COLUMNS)


def _nine(column):
    return X.round_half_even(F.col(column), 9).alias(column)


def _per_target(value: str, prefix: str) -> str:
    return ", ".join(f"max({value}) FILTER (s.target = '{t}') AS {prefix}_{t}" for t in fixed.TARGET_COLUMNS)


@register("m3_node_table_scores", f"""
SELECT e.resp_id, NOT any_value(e.is_test) AS in_train, {_per_target("s.margin", "margin")}, {_per_target("s.p", "pred")}
FROM ev e JOIN ev_margins s USING (resp_id) GROUP BY e.resp_id""")
def m3_node_table_scores(spark, sf_dir):
    ev = training.eval_frame(spark, sf_dir).withColumn("in_train", ~F.col("is_test"))
    got = model.score(_standin_forest(), ev, ["resp_id", "in_train"], margins=True)
    return got.select("resp_id", "in_train", *[f"margin_{t}" for t in fixed.TARGET_COLUMNS], *[_nine(f"pred_{t}") for t in fixed.TARGET_COLUMNS])


@register("m4_node_table_scores", "SELECT h.resp_id, h.quartile, h.target, h.y, s.p FROM heldout h JOIN ev_margins s USING (resp_id, target)")
def m4_node_table_scores(spark, sf_dir):
    test = training.eval_frame(spark, sf_dir).filter(F.col("is_test"))
    scored = model.score(_standin_forest(), test, ["resp_id", "quartile", *fixed.TARGET_COLUMNS])
    return model.long_predictions(scored, ["resp_id", "quartile"]).select("resp_id", "quartile", "target", "y", _nine("p"))


@register("m6_node_table_shapley", "SELECT * FROM fs_phi")
def m6_node_table_shapley(spark, sf_dir):
    test = training.eval_frame(spark, sf_dir).filter(F.col("is_test"))
    # many values are sums of powers of two, which nine digits would halve: rounded a little beside them
    # (rint is half to even, as bround is, which makes a decimal of every value)
    phi = F.rint((F.col("phi") + F.lit(3e-10)) * F.lit(1e9)) / F.lit(1e9) + F.lit(0.0)
    return model.shapley(_standin_forest(), test).select("resp_id", "feature", "target", phi.alias("phi"))


@register("m7_node_table_scores", f"""
SELECT r.request_id, s.target, {OQ.TARGET_DISPLAY.replace("target", "s.target", 1)} AS condition, s.p AS score, 'model' AS score_kind,
  r.spatial_lack_insurance IS NULL OR r.spatial_poor_mental_health IS NULL AS place_imputed,
  CAST(r.spatial_lack_insurance IS NULL AS INTEGER) + CAST(r.spatial_poor_mental_health IS NULL AS INTEGER)
  + CAST(r.bmi IS NULL AS INTEGER) AS inputs_imputed
FROM req_rows r JOIN req_margins s USING (request_id)""")
def m7_node_table_scores(spark, sf_dir):
    scored = training.score_requests(_standin_forest(), requests_plan.resolved_requests(spark, sf_dir))
    return scored.withColumn("score", X.round_half_even(F.col("score"), 9))


@register("s6_node_table_predictions", f"""
SELECT e.resp_id, any_value(e.stateabbr) AS stateabbr, {", ".join(f"any_value(e.{c}) AS {c}" for c in fixed.PREDICTION_COLUMNS[1:])}, {_per_target("s.p", "pred")}
FROM ev e JOIN ev_margins s USING (resp_id) GROUP BY e.resp_id""")
def s6_node_table_predictions(spark, sf_dir):
    preds = model.score(_standin_forest(), training.eval_frame(spark, sf_dir), ["resp_id", *fixed.PREDICTION_COLUMNS])
    path = sinks.write_table(preds, shared_path(spark, "predictions"), partition_by=["stateabbr"])
    back = survey.read_predictions(spark, path)
    return back.select("resp_id", *fixed.PREDICTION_COLUMNS, *[_nine(f"pred_{t}") for t in fixed.TARGET_COLUMNS])


@register("s10_node_table_reload", f"""
SELECT e.resp_id, {_per_target("s.margin", "margin")} FROM ev e JOIN ev_margins s USING (resp_id) WHERE e.is_test GROUP BY e.resp_id""")
def s10_node_table_reload(spark, sf_dir):
    # saved as a table, loaded again, and held against the table's own scores
    path = model.save_models(_standin_forest(), shared_path(spark, "nodes"))
    test = training.eval_frame(spark, sf_dir).filter(F.col("is_test"))
    got = model.score(model.load_models(path), test, ["resp_id"], margins=True)
    return got.select("resp_id", *[f"margin_{t}" for t in fixed.TARGET_COLUMNS])


# ---------------------------------------------------------------------------
# 2.11 model jobs on a fit (a learner's numbers are not SQL); last, since each application fits once
# ---------------------------------------------------------------------------
@register("m2_train_models")
def m2_train_models(spark, sf_dir):
    models, n_train = training.fitted(spark, sf_dir)
    return model.model_summary(spark, models, n_train)


@register("m3_score_respondents")
def m3_score_respondents(spark, sf_dir):
    return training.scored_respondents(spark, sf_dir)


@register("m4_heldout_scores")
def m4_heldout_scores(spark, sf_dir):
    return training.heldout_model_scores(spark, sf_dir)


@register("m4_model_metrics")
def m4_model_metrics(spark, sf_dir):
    return metrics.summary(training.heldout_model_scores(spark, sf_dir))


@register("a10_model_equity_audit")
def a10_model_equity_audit(spark, sf_dir):
    return metrics.equity_audit(training.heldout_model_scores(spark, sf_dir))


@register("w2_model_pr_curve")
def w2_model_pr_curve(spark, sf_dir):
    return metrics.pr_curve(training.heldout_model_scores(spark, sf_dir))


@register("w3_model_operating_point")
def w3_model_operating_point(spark, sf_dir):
    return metrics.operating_point(metrics.pr_curve(training.heldout_model_scores(spark, sf_dir)))


@register("a18_model_lift")
def a18_model_lift(spark, sf_dir):
    scores = training.heldout_model_scores(spark, sf_dir)
    return metrics.lift(metrics.average_precision(scores), metrics.prevalence(scores))


@register("a9_model_demographic_risk")
def a9_model_demographic_risk(spark, sf_dir):
    return risk.demographic_risk_by_state(training.scored_respondents(spark, sf_dir))


@register("m5_permutation_importance")
def m5_permutation_importance(spark, sf_dir):
    return training.model_importance(spark, sf_dir, "permutation")


@register("a15_model_importance_summary")
def a15_model_importance_summary(spark, sf_dir):
    return risk.importance_summary(m5_permutation_importance(spark, sf_dir))


@register("m7_request_model_scores")
def m7_request_model_scores(spark, sf_dir):
    return training.request_model_scores(spark, sf_dir)


@register("j7_model_prevalence_comparison")
def j7_model_prevalence_comparison(spark, sf_dir):
    scores = training.request_model_scores(spark, sf_dir)
    sample = metrics.prevalence(training.heldout_model_scores(spark, sf_dir))
    return lookup.compare_to_prevalence(scores, sample)


@register("s6_predictions_scan")
def s6_predictions_scan(spark, sf_dir):
    preds = training.scored_respondents(spark, sf_dir)
    path = sinks.write_table(preds, shared_path(spark, "model_predictions"), partition_by=["stateabbr"])
    return survey.read_predictions(spark, path).select(*preds.columns)


@register("s9_metrics_document")
def s9_metrics_document(spark, sf_dir):
    _, n_train = training.fitted(spark, sf_dir)
    scores = training.heldout_model_scores(spark, sf_dir)
    n_test = training.eval_frame(spark, sf_dir).filter(F.col("is_test")).count()
    op = metrics.operating_point(metrics.pr_curve(scores)).first()
    return sinks.eval_document(metrics.summary(scores), op, n_train, n_test,
                               "joint histogram boosting", fixed.TARGET_DISPLAY_NAMES[fixed.PRIMARY_TARGET])


@register("s7_eval_artifacts")
def s7_eval_artifacts(spark, sf_dir):
    base = shared_path(spark, "eval")
    s9_metrics_document(spark, sf_dir).write.mode("overwrite").text(f"{base}/eval_metrics")
    scores = training.heldout_model_scores(spark, sf_dir)
    sinks.write_table(metrics.equity_audit(scores), f"{base}/equity")
    curve = metrics.pr_curve(scores).filter(F.col("target") == fixed.PRIMARY_TARGET)
    sinks.write_table(curve, f"{base}/precision_recall")
    sinks.write_table(m5_permutation_importance(spark, sf_dir), f"{base}/importance")
    return survey.read_eval_artifacts(spark, base)["eval_metrics"]


@register("s10_model_roundtrip")
def s10_model_roundtrip(spark, sf_dir):
    _, path = training.saved(spark, sf_dir)
    loaded = model.load_models(path)
    test = training.eval_frame(spark, sf_dir).filter(F.col("is_test"))
    return model.score(loaded, test, ["resp_id"])


# What can be checked about a learner's outputs without its numbers: settings, keys, labels, flags, ranges.
@register("m2_fit_settings", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS target, count(*) AS n_train, {fixed.GBT_ROUNDS} AS num_trees, {fixed.GBT_DEPTH} AS max_depth FROM ev WHERE NOT is_test"
    for t in fixed.TARGET_COLUMNS))
def m2_fit_settings(spark, sf_dir):
    return m2_train_models(spark, sf_dir).select("target", "n_train", "num_trees", "max_depth")


def _in_range(column):
    return F.col(column).between(0, 1) & ~F.isnan(column)


@register("m3_score_checks", "SELECT resp_id, stateabbr, age_code, income_code, educa_code, race_code, NOT is_test AS in_train, TRUE AS in_range FROM ev")
def m3_score_checks(spark, sf_dir):
    ok = F.lit(True)
    for t in fixed.TARGET_COLUMNS:
        ok = ok & _in_range(f"pred_{t}")
    return training.scored_respondents(spark, sf_dir).select("resp_id", *fixed.PREDICTION_COLUMNS, "in_train", ok.alias("in_range"))


@register("m4_score_checks", "SELECT resp_id, quartile, target, y, TRUE AS in_range FROM heldout")
def m4_score_checks(spark, sf_dir):
    return training.heldout_model_scores(spark, sf_dir).select("resp_id", "quartile", "target", "y", _in_range("p").alias("in_range"))


@register("m7_score_checks", "\nUNION ALL\n".join(
    f"SELECT request_id, '{t}' AS target, '{fixed.TARGET_DISPLAY_NAMES[t]}' AS condition, 'model' AS score_kind, "
    "spatial_lack_insurance IS NULL OR spatial_poor_mental_health IS NULL AS place_imputed, "
    "CAST(spatial_lack_insurance IS NULL AS INTEGER) + CAST(spatial_poor_mental_health IS NULL AS INTEGER) "
    "+ CAST(height_ft * 12 + height_in = 0 AS INTEGER) AS inputs_imputed, TRUE AS in_range FROM res"
    for t in fixed.TARGET_COLUMNS))
def m7_score_checks(spark, sf_dir):
    return training.request_model_scores(spark, sf_dir).select(
        "request_id", "target", "condition", "score_kind", "place_imputed", "inputs_imputed", _in_range("score").alias("in_range"))


@register("s10_reload_differences", "SELECT target, CAST(0 AS BIGINT) AS n_different, count(*) AS n_rows FROM heldout GROUP BY target")
def s10_reload_differences(spark, sf_dir):
    # rows whose score changes when the models are saved and loaded again
    models, path = training.saved(spark, sf_dir)
    test = training.eval_frame(spark, sf_dir).filter(F.col("is_test"))
    both = model.score(models, test, ["resp_id"]).join(
        model.score(model.load_models(path), test, ["resp_id"]).withColumnsRenamed({f"pred_{t}": f"again_{t}" for t in fixed.TARGET_COLUMNS}),
        "resp_id")
    rows = [F.struct(F.lit(t).alias("target"), (F.col(f"pred_{t}") != F.col(f"again_{t}")).alias("d")) for t in fixed.TARGET_COLUMNS]
    return both.select(F.inline(F.array(*rows))).groupBy("target").agg(F.count_if("d").alias("n_different"), F.count(F.lit(1)).alias("n_rows"))


@register("m6_shapley_importance")
def m6_shapley_importance(spark, sf_dir):
    return training.model_importance(spark, sf_dir, "shapley")


@register("a15_shapley_importance_summary")
def a15_shapley_importance_summary(spark, sf_dir):
    return risk.importance_summary(m6_shapley_importance(spark, sf_dir))


# Operators for training text: only where their subpackage is there.
EXTRA_SQL: dict[str, str] = {}
try:
    from riskfabric.llm import queries as text_queries
except ModuleNotFoundError as e:
    if not (e.name or "").startswith("riskfabric.llm"):
        raise
else:
    QUERIES.update(text_queries.QUERIES)
    EXTRA_SQL.update(text_queries.ORACLE_SQL)
try:
    import corpus_pipeline
except ModuleNotFoundError as e:
    if e.name != "corpus_pipeline" and not (e.name or "").startswith("riskfabric.llm"):
        raise
else:
    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        EXTRA_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return flagship_state_prevalence(spark, SF0001)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return OQ.all_queries() | EXTRA_SQL
