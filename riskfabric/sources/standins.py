"""Stand-in inputs derived from the driver's tables.

The modelled system reads a survey extract and place-measure pulls that are
not available here.  These views derive inputs of the same shape from the
driver's ``orders`` and ``lineitem`` tables with integer arithmetic only, so
the text runs unchanged in Spark SQL and DuckDB and the work grows with the
tables.  ``{orders}`` / ``{lineitem}`` are filled with DataFrames on the
Spark side and with the registered view names on the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed
from .tables import read_table

# One row per order: a survey respondent with raw codes, sentinel codes and
# nulls.  FIPS 3, 7, 14, 43, 52 and 57 are unmapped on purpose.
RESPONDENTS_SQL = """
SELECT o_orderkey AS resp_id, CAST(1 + o_custkey % 57 AS INT) AS state_fips,
CASE WHEN ((o_orderkey * 104729 + o_custkey * 7919) % 1000003) % 100 < 12 THEN 1 WHEN ((o_orderkey * 104729 + o_custkey * 7919) % 1000003) % 100 < 14 THEN 2 WHEN ((o_orderkey * 104729 + o_custkey * 7919) % 1000003) % 100 < 92 THEN 3 WHEN ((o_orderkey * 104729 + o_custkey * 7919) % 1000003) % 100 < 96 THEN 4 WHEN ((o_orderkey * 104729 + o_custkey * 7919) % 1000003) % 100 < 97 THEN 7 WHEN ((o_orderkey * 104729 + o_custkey * 7919) % 1000003) % 100 < 98 THEN 9 END AS diabetes_raw,
CASE WHEN ((o_orderkey * 224737 + o_custkey * 7919) % 1000003) % 100 < 5 THEN 1 WHEN ((o_orderkey * 224737 + o_custkey * 7919) % 1000003) % 100 < 97 THEN 2 WHEN ((o_orderkey * 224737 + o_custkey * 7919) % 1000003) % 100 < 98 THEN 7 WHEN ((o_orderkey * 224737 + o_custkey * 7919) % 1000003) % 100 < 99 THEN 9 END AS stroke_raw,
CASE WHEN ((o_orderkey * 350377 + o_custkey * 7919) % 1000003) % 100 < 10 THEN 1 WHEN ((o_orderkey * 350377 + o_custkey * 7919) % 1000003) % 100 < 98 THEN 2 WHEN ((o_orderkey * 350377 + o_custkey * 7919) % 1000003) % 100 < 99 THEN 7 END AS cancer_raw,
CASE WHEN ((o_orderkey * 479909 + o_custkey * 7919) % 1000003) % 100 < 9 THEN 1 WHEN ((o_orderkey * 479909 + o_custkey * 7919) % 1000003) % 100 < 98 THEN 2 END AS michd_raw,
CASE WHEN ((o_orderkey * 611953 + o_custkey * 7919) % 1000003) % 100 < 15 THEN 1 WHEN ((o_orderkey * 611953 + o_custkey * 7919) % 1000003) % 100 < 97 THEN 2 WHEN ((o_orderkey * 611953 + o_custkey * 7919) % 1000003) % 100 < 98 THEN 7 END AS asthma_raw,
CASE WHEN ((o_orderkey * 746773 + o_custkey * 7919) % 1000003) % 100 < 8 THEN 1 WHEN ((o_orderkey * 746773 + o_custkey * 7919) % 1000003) % 100 < 97 THEN 2 WHEN ((o_orderkey * 746773 + o_custkey * 7919) % 1000003) % 100 < 99 THEN 9 END AS copd_raw,
CAST(1 + ((o_orderkey * 882377 + o_custkey * 7919) % 1000003) % 14 AS INT) AS age_raw, CASE WHEN ((o_orderkey * 17389 + o_custkey * 7919) % 1000003) % 100 < 80 THEN 1 + ((o_orderkey * 27449 + o_custkey * 7919) % 1000003) % 8 WHEN ((o_orderkey * 17389 + o_custkey * 7919) % 1000003) % 100 < 88 THEN 77 WHEN ((o_orderkey * 17389 + o_custkey * 7919) % 1000003) % 100 < 96 THEN 99 END AS income_raw,
CASE WHEN ((o_orderkey * 37813 + o_custkey * 7919) % 1000003) % 50 = 0 THEN 9 ELSE 1 + ((o_orderkey * 48611 + o_custkey * 7919) % 1000003) % 6 END AS educa_raw,
CASE WHEN ((o_orderkey * 59359 + o_custkey * 7919) % 1000003) % 40 = 0 THEN 9 ELSE 1 + ((o_orderkey * 70657 + o_custkey * 7919) % 1000003) % 7 END AS race_raw,
CASE WHEN ((o_orderkey * 81799 + o_custkey * 7919) % 1000003) % 200 = 0 THEN 3 ELSE 1 + ((o_orderkey * 93179 + o_custkey * 7919) % 1000003) % 2 END AS sex_raw,
CASE WHEN ((o_orderkey * 15485863 + o_custkey * 7919) % 1000003) % 100 < 4 THEN NULL WHEN ((o_orderkey * 15485863 + o_custkey * 7919) % 1000003) % 100 < 5 THEN 900 ELSE 1500 + ((o_orderkey * 32452843 + o_custkey * 7919) % 1000003) % 3500 END AS bmi_x100,
CASE WHEN ((o_orderkey * 49979687 + o_custkey * 7919) % 1000003) % 30 = 0 THEN 9 ELSE 1 + ((o_orderkey * 67867967 + o_custkey * 7919) % 1000003) % 4 END AS smoker_raw,
CASE WHEN ((o_orderkey * 86028121 + o_custkey * 7919) % 1000003) % 30 = 0 THEN 9 ELSE 1 + ((o_orderkey * 104395301 + o_custkey * 7919) % 1000003) % 2 END AS activity_raw,
CASE WHEN ((o_orderkey * 122949823 + o_custkey * 7919) % 1000003) % 30 = 0 THEN 9 WHEN ((o_orderkey * 141650939 + o_custkey * 7919) % 1000003) % 15 = 0 THEN 2 ELSE 1 END AS drinking_raw,
CASE WHEN (o_orderkey * 15401) % 4 < 3 THEN NULL WHEN (o_orderkey * 7907) % 11 = 0 THEN 8 ELSE 1 + (o_orderkey * 13) % 5 END AS metro_raw,
CASE WHEN (o_orderkey * 5) % 23 = 0 THEN 9 WHEN (o_orderkey * 3) % 29 = 0 THEN 7 ELSE 1 + (o_orderkey * 3) % 5 END AS genhlth_raw
FROM {orders}
"""

# One row per lineitem: a long-form place measure with text values: 'n/a',
# 'NaN', a number with a suffix and white space included; some keys are missing,
# short, no digits, or have white space.  ``seq`` stands for file order; it ties, so order by
# (seq, value).
PLACES_LONG_SQL = """
SELECT CASE WHEN l_orderkey % 997 = 0 THEN NULL WHEN l_partkey % 211 = 0 THEN 'X' || lpad(CAST(l_partkey % 10000 AS VARCHAR(10)), 4, '0')
WHEN l_partkey % 31 = 0 THEN CAST((l_partkey * 7919) % 100000 AS VARCHAR(10))
WHEN l_partkey % 37 = 0 THEN lpad(CAST((l_partkey * 7919) % 100000 AS VARCHAR(10)), 5, '0') || chr(9)
ELSE lpad(CAST((l_partkey * 7919) % 100000 AS VARCHAR(10)), 5, '0') END AS zcta, CASE l_linenumber WHEN 1 THEN 'ACCESS2' WHEN 2 THEN 'MHLTH' WHEN 3 THEN 'OBESITY' ELSE 'OTHER' || CAST(l_linenumber AS VARCHAR(3)) END AS measureid,
CASE WHEN l_quantity = 50 THEN 'n/a' WHEN l_quantity = 49 THEN 'NaN' WHEN l_quantity = 48 THEN '48.5f'
WHEN l_quantity = 47 THEN ' 47.25' || chr(9) ELSE CAST(l_quantity AS VARCHAR(12)) END AS data_value, CAST(1 + l_partkey % 57 AS INT) AS state_fips, l_orderkey AS seq FROM {lineitem}
"""

# One row per order: a scoring request as the dashboard would send it.  The
# ZIP text covers every status (padded, short, letters, empty, null, absent).
REQUESTS_SQL = """
SELECT o_orderkey AS request_id,
CASE WHEN o_orderkey % 3 = 0 THEN 'state' ELSE 'zip' END AS lookup_mode,
CASE o_orderkey % 20 WHEN 0 THEN ' ' || lpad(CAST((o_custkey * 7919) % 100000 AS VARCHAR(10)), 5, '0') || ' '
WHEN 1 THEN substr(lpad(CAST((o_custkey * 7919) % 100000 AS VARCHAR(10)), 5, '0'), 1, 4)
WHEN 2 THEN substr(lpad(CAST((o_custkey * 7919) % 100000 AS VARCHAR(10)), 5, '0'), 1, 4) || 'A'
WHEN 3 THEN ''
WHEN 6 THEN lpad(CAST((o_custkey * 7919) % 100000 AS VARCHAR(10)), 5, '0') || chr(9)
WHEN 4 THEN NULL
WHEN 5 THEN lpad(CAST((o_custkey * 7919 + 1) % 100000 AS VARCHAR(10)), 5, '0')
ELSE lpad(CAST((o_custkey * 7919) % 100000 AS VARCHAR(10)), 5, '0') END AS zip_text,
CAST(1 + o_custkey % 57 AS INT) AS state_fips,
CAST(1 + (o_orderkey * 31) % 13 AS INT) AS age_code,
CAST(1 + (o_orderkey * 17) % 8 AS INT) AS income_code,
CAST(1 + (o_orderkey * 7) % 6 AS INT) AS educa_code,
CAST(1 + (o_orderkey * 11) % 7 AS INT) AS race_code,
CAST(1 + o_orderkey % 2 AS INT) AS sex_code,
CAST(CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE 4 + (o_orderkey * 3) % 3 END AS INT) AS height_ft,
CAST(CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE (o_orderkey * 5) % 12 END AS INT) AS height_in,
CAST(100 + (o_orderkey * 13) % 200 AS INT) AS weight_lbs,
CAST(1 + o_orderkey % 4 AS INT) AS smoker_code,
CAST(1 + (o_orderkey * 3) % 2 AS INT) AS physical_activity_code,
CASE WHEN (o_orderkey * 7) % 5 = 4 THEN 2 ELSE 1 END AS heavy_drinking_code
FROM {orders}
"""


def _fips_case(col: str, extra: dict[int, str] | None = None) -> str:
    items = dict(fixed.STATE_FIPS_TO_ABBR)
    items.update(extra or {})
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in items.items())
    return f"CASE {col} {whens} END"


def places_county_sql(source: str = "{lineitem}") -> str:
    """County-style pull: carries ``stateabbr``; FIPS 57 is the national
    rollup row ``'US'``."""
    body = PLACES_LONG_SQL.replace("{lineitem}", source)
    return (f"SELECT zcta AS locationid, {_fips_case('state_fips', {57: 'US'})} AS stateabbr, "
            f"measureid, data_value, seq FROM ({body}) p")


def places_zcta_sql(source: str = "{lineitem}") -> str:
    """ZCTA-style pull: no state field."""
    body = PLACES_LONG_SQL.replace("{lineitem}", source)
    return f"SELECT zcta AS locationid, measureid, data_value, seq FROM ({body}) p"


#: FIXED VALUES: the measure codes of the stand-in pulls.
MEASURES = ["ACCESS2", "MHLTH", "OBESITY", "OTHER4", "OTHER5", "OTHER6", "OTHER7"]


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return spark.sql(RESPONDENTS_SQL, orders=orders)


def places_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_table(spark, sf_dir, "lineitem",
                          ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])
    return spark.sql(places_county_sql(), lineitem=lineitem)


def places_zcta(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_table(spark, sf_dir, "lineitem",
                          ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"])
    return spark.sql(places_zcta_sql(), lineitem=lineitem)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return spark.sql(REQUESTS_SQL, orders=orders)


def crosswalk_sql(source: str = "{part}") -> str:
    """A ZCTA -> state crosswalk with unpadded keys (one row per part, and a
    second one with another state for each tenth); unmapped FIPS codes give
    rows without a state."""
    one = "SELECT CAST((p_partkey * 7919) % 100000 AS VARCHAR(10)) AS zcta, "
    return (f"{one}{_fips_case('CAST(1 + (p_partkey * 3) % 57 AS INT)')} AS stateabbr FROM {source} "
            f"UNION ALL {one}{_fips_case('CAST(1 + (p_partkey * 5) % 57 AS INT)')} FROM {source} WHERE p_partkey % 10 = 0")


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part", ["p_partkey"])
    return spark.sql(crosswalk_sql(), part=part)


# ---------------------------------------------------------------------------
# a stand-in model: a node table that a rule gives, so that scores can be checked without a fit
# ---------------------------------------------------------------------------
FOREST_TREES = 4
#: A feature's split points: the middle one, and how far the others are from it.
_SPLIT_AT = {"age_code": (7, 3), "income_code": (4, 2), "educa_code": (3, 1), "race_code": (4, 2), "sex_code": (1, 0),
             "spatial_lack_insurance": (24, 2), "spatial_poor_mental_health": (23, 2), "bmi": (32, 8), "smoker_code": (2, 1),
             "physical_activity_code": (1, 0), "heavy_drinking_code": (1, 0)}


def forest_rows() -> list[tuple]:
    """Nodes of four trees of three levels per outcome: (target, tree, node, feature, threshold,
    default_left, left, right, value, cover).  Values and covers are sums of powers of two, so sums
    of them are exact in any order."""
    out = []
    for t, target in enumerate(fixed.TARGET_COLUMNS):
        for k in range(1, FOREST_TREES + 1):
            cover = {0: 64.0}
            for i in range(15):
                if i not in cover:
                    continue
                value = ((7 * t + 3 * k + 5 * i) % 21 - 10) / 16
                if i >= 7 or (i == 2 and (t + k) % 3 == 0):
                    out.append((target, k, i, None, None, None, None, None, value, cover[i]))
                    continue
                feature = fixed.FEATURE_COLUMNS[(3 * t + 5 * k + 2 * i) % len(fixed.FEATURE_COLUMNS)]
                middle, step = _SPLIT_AT[feature]
                share = (1 + (t + k + i) % 3) / 4
                cover[2 * i + 1], cover[2 * i + 2] = cover[i] * share, cover[i] * (1 - share)
                out.append((target, k, i, feature, float(middle + ((t + i) % 3 - 1) * step), (t + k + i) % 2 == 0,
                            2 * i + 1, 2 * i + 2, value, cover[i]))
    return out
