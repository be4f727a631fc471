"""DuckDB twins of the registered queries.

Plain SQL over the driver's views; code books, labels and the stand-in inputs
are the same fixed values as on the Spark side (tests compare these with
literal entries).  Shared building blocks are CTEs; each query is ``WITH <all CTEs>
SELECT ...``.  Doubles are produced by the same single IEEE operations as on
the Spark side, so values agree exactly.
"""

from __future__ import annotations

from riskfabric.functions import fixed
from riskfabric.sources import standins

TARGETS = fixed.TARGET_COLUMNS
FEATURES = fixed.FEATURE_COLUMNS


def _case_map(col: str, mapping: dict, quote_keys: bool = False) -> str:
    def k(x):
        return f"'{x}'" if quote_keys else str(x)
    return "CASE " + col + " " + " ".join(f"WHEN {k(a)} THEN '{b}'" for a, b in mapping.items()) + " END"


def _zfill5(x: str) -> str:
    return f"(CASE WHEN length({x}) < 5 THEN lpad({x}, 5, '0') ELSE {x} END)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$', '', 'g')"


def _number(x: str) -> str:
    return (f"CASE WHEN regexp_matches({_strip(x)}, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') "
            f"THEN CAST({_strip(x)} AS DOUBLE) END")


def _not_null(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


STATE_ABBR = _case_map("state_fips", fixed.STATE_FIPS_TO_ABBR)
KNOWN_STATES = ", ".join(f"'{s}'" for s in sorted(set(fixed.STATE_FIPS_TO_ABBR.values())))

CTES = {
    "respondents": standins.RESPONDENTS_SQL.replace("{orders}", "orders"),
    "clean_all": f"""
SELECT resp_id, {STATE_ABBR} AS stateabbr,
  CAST(CASE WHEN diabetes_raw = 1 THEN 1 WHEN diabetes_raw IN (2, 3, 4) THEN 0 END AS INTEGER) AS target_diabetes,
  CAST(CASE WHEN stroke_raw = 1 THEN 1 WHEN stroke_raw = 2 THEN 0 END AS INTEGER) AS target_stroke,
  CAST(CASE WHEN cancer_raw = 1 THEN 1 WHEN cancer_raw = 2 THEN 0 END AS INTEGER) AS target_cancer,
  CAST(CASE WHEN michd_raw = 1 THEN 1 WHEN michd_raw = 2 THEN 0 END AS INTEGER) AS target_cardio,
  CAST(CASE WHEN asthma_raw = 1 OR copd_raw = 1 THEN 1
            WHEN asthma_raw NOT IN (7, 9) AND copd_raw NOT IN (7, 9) THEN 0 END AS INTEGER) AS target_chronic_respiratory,
  CAST(CASE WHEN income_raw NOT IN (77, 99) THEN income_raw END AS INTEGER) AS income_code,
  CAST(CASE WHEN age_raw <> 14 THEN age_raw END AS INTEGER) AS age_code,
  CAST(CASE WHEN race_raw <> 9 THEN race_raw END AS INTEGER) AS race_code,
  CAST(CASE WHEN educa_raw <> 9 THEN educa_raw END AS INTEGER) AS educa_code,
  CAST(CASE WHEN sex_raw IN (1, 2) THEN sex_raw END AS INTEGER) AS sex_code,
  CAST(CASE WHEN smoker_raw <> 9 THEN smoker_raw END AS INTEGER) AS smoker_code,
  CAST(CASE WHEN activity_raw <> 9 THEN activity_raw END AS INTEGER) AS physical_activity_code,
  CAST(CASE WHEN drinking_raw <> 9 THEN drinking_raw END AS INTEGER) AS heavy_drinking_code,
  CAST(CASE WHEN metro_raw BETWEEN 1 AND 5 THEN metro_raw END AS INTEGER) AS metro_code,
  CAST(CASE WHEN genhlth_raw NOT IN (7, 9) THEN genhlth_raw END AS INTEGER) AS general_health_code,
  CASE WHEN CAST(bmi_x100 AS DOUBLE) / 100.0::DOUBLE BETWEEN 12 AND 100
       THEN CAST(bmi_x100 AS DOUBLE) / 100.0::DOUBLE END AS bmi
FROM respondents""",
    "clean": f"SELECT * FROM clean_all WHERE {_not_null(TARGETS)}",
    "places_county": standins.places_county_sql("lineitem"),
    "places_zcta": standins.places_zcta_sql("lineitem"),
    "pc_values": f"""
SELECT {_zfill5(_strip('locationid'))} AS ZCTA, measureid,
       {_number('data_value')} AS value, data_value, stateabbr, seq
FROM places_county WHERE locationid IS NOT NULL""",
    "pc_first": """
SELECT ZCTA, measureid, value FROM (
  SELECT ZCTA, measureid, value,
         row_number() OVER (PARTITION BY ZCTA, measureid ORDER BY seq, value) AS rn
  FROM pc_values WHERE value IS NOT NULL AND measureid IS NOT NULL) t WHERE rn = 1""",
    "pc_state": """
SELECT ZCTA, stateabbr FROM (
  SELECT ZCTA, stateabbr, row_number() OVER (PARTITION BY ZCTA ORDER BY seq, measureid) AS rn
  FROM pc_values) t WHERE rn = 1""",
    "pc_wide": """
SELECT w.*, s.stateabbr FROM (
  SELECT ZCTA,
    max(CASE WHEN measureid = 'ACCESS2' THEN value END) AS spatial_lack_insurance,
    max(CASE WHEN measureid = 'MHLTH' THEN value END) AS spatial_poor_mental_health,
    max(CASE WHEN measureid = 'OBESITY' THEN value END) AS OBESITY,
    max(CASE WHEN measureid = 'OTHER4' THEN value END) AS OTHER4,
    max(CASE WHEN measureid = 'OTHER5' THEN value END) AS OTHER5,
    max(CASE WHEN measureid = 'OTHER6' THEN value END) AS OTHER6,
    max(CASE WHEN measureid = 'OTHER7' THEN value END) AS OTHER7
  FROM pc_first GROUP BY ZCTA) w JOIN pc_state s USING (ZCTA)""",
    "state_avg": """
SELECT stateabbr, avg(spatial_lack_insurance) AS spatial_lack_insurance,
       avg(spatial_poor_mental_health) AS spatial_poor_mental_health
FROM pc_wide WHERE stateabbr IS NOT NULL AND stateabbr <> 'US' GROUP BY stateabbr""",
    "joined": """
SELECT c.*, s.spatial_lack_insurance, s.spatial_poor_mental_health
FROM clean c JOIN state_avg s ON c.stateabbr = s.stateabbr""",
    "med_cell": """
SELECT age_code, educa_code, median(income_code) AS m, count(income_code) AS n FROM joined
WHERE income_code IS NOT NULL AND age_code IS NOT NULL AND educa_code IS NOT NULL
GROUP BY age_code, educa_code""",
    "med_edu": """
SELECT educa_code, median(income_code) AS m, count(income_code) AS n FROM joined
WHERE income_code IS NOT NULL AND educa_code IS NOT NULL GROUP BY educa_code""",
    "med_all": "SELECT median(income_code) AS m, count(income_code) AS n FROM joined WHERE income_code IS NOT NULL",
    "imputed": f"""
SELECT j.* REPLACE (
    CASE WHEN j.income_code IS NULL
         THEN CAST(least(greatest(round_even(coalesce(c.m, e.m, (SELECT m FROM med_all)), 0), {fixed.INCOME_MIN}), {fixed.INCOME_MAX}) AS INTEGER)
         ELSE j.income_code END AS income_code),
  j.income_code IS NULL AS income_code_imputed,
  CASE WHEN j.income_code IS NULL THEN
    CASE WHEN c.m IS NOT NULL THEN '{fixed.TIER_CELL}' WHEN e.m IS NOT NULL THEN '{fixed.TIER_EDUCATION}'
         ELSE '{fixed.TIER_OVERALL}' END END AS imputation_tier
FROM joined j
LEFT JOIN (SELECT * FROM med_cell WHERE n >= {fixed.MIN_GROUP_N_FOR_MEDIAN}) c
  ON j.age_code = c.age_code AND j.educa_code = c.educa_code
LEFT JOIN (SELECT * FROM med_edu WHERE n >= {fixed.MIN_GROUP_N_FOR_MEDIAN}) e
  ON j.educa_code = e.educa_code""",
    "model_frame": f"SELECT * FROM imputed WHERE {_not_null(FEATURES + TARGETS)}",
}


TARGET_DISPLAY = _case_map("target", fixed.TARGET_DISPLAY_NAMES, quote_keys=True)
QUARTILE_LABEL = _case_map("quartile", dict(enumerate(fixed.QUARTILE_LABELS, start=1)))


def _ref_score(i: int) -> str:
    return (f"CAST((age_code * 3 + smoker_code * 2 + income_code * 5 + educa_code + race_code * 7 + {5 * i}) % 64 AS DOUBLE)"
            " / 64.0::DOUBLE")


CTES.update({
    "ev": """
SELECT m.* EXCLUDE (r, n_total),
  CASE WHEN n_total <= 1 THEN 1 ELSE CAST(greatest(1, (4 * (r - 1) + n_total - 2) // (n_total - 1)) AS INTEGER) END AS quartile,
  ((resp_id % 2147483648) * 1103515245 + 12345) % 2147483648 % 5 = 0 AS is_test
FROM (SELECT *, row_number() OVER (ORDER BY spatial_lack_insurance, resp_id) AS r,
             count(*) OVER () AS n_total FROM model_frame) m""",
    "scores": "\nUNION ALL\n".join(
        f"SELECT resp_id, quartile, is_test, '{t}' AS target, CAST({t} AS INTEGER) AS y, {_ref_score(i)} AS p FROM ev"
        for i, t in enumerate(TARGETS)),
    "heldout": "SELECT * FROM scores WHERE is_test",
    "sc": """
SELECT target, p, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg
FROM heldout GROUP BY target, p""",
    "pr": """
SELECT target, p AS threshold, pos, CAST(sum(pos) OVER w AS BIGINT) AS cum_pos,
       CAST(sum(neg) OVER w AS BIGINT) AS cum_neg, CAST(sum(pos) OVER (PARTITION BY target) AS BIGINT) AS n_pos
FROM sc WINDOW w AS (PARTITION BY target ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""",
    "pr_pts": """
SELECT target, threshold, pos, cum_pos, cum_neg, n_pos,
  CAST(cum_pos AS DOUBLE) / CAST(cum_pos + cum_neg AS DOUBLE) AS precision,
  CASE WHEN n_pos > 0 THEN CAST(cum_pos AS DOUBLE) / CAST(n_pos AS DOUBLE) ELSE 1.0::DOUBLE END AS recall
FROM pr""",
    "conf": """
SELECT target, quartile, count(*) AS n,
  count_if(y = 0 AND p <= 0.5) AS tn, count_if(y = 0 AND p > 0.5) AS fp,
  count_if(y = 1 AND p <= 0.5) AS fn, count_if(y = 1 AND p > 0.5) AS tp
FROM heldout GROUP BY GROUPING SETS ((target), (target, quartile))""",
    "prev": "SELECT target, count(*) AS n, round_even(avg(y), 4) AS prevalence FROM heldout GROUP BY target",
    "ap": """
SELECT target, round_even(CASE WHEN max(n_pos) > 0
  THEN sum(CAST(pos * cum_pos AS DOUBLE) / CAST(cum_pos + cum_neg AS DOUBLE)) / CAST(max(n_pos) AS DOUBLE)
  ELSE 0.0 END, 4) AS pr_auc FROM pr GROUP BY target""",
})


ZIP2_STATE = _case_map("substr(" + _zfill5("ZCTA") + ", 1, 2)", fixed.ZIP2_TO_STATE, quote_keys=True)


def _values_cte(src: str, with_state: bool) -> str:
    st = ", stateabbr" if with_state else ""
    return (f"SELECT {_zfill5(_strip('locationid'))} AS ZCTA, measureid, "
            f"{_number('data_value')} AS value, data_value{st}, seq FROM {src} WHERE locationid IS NOT NULL")


def _first_cte(values: str) -> str:
    return f"""
SELECT ZCTA, measureid, value FROM (
  SELECT ZCTA, measureid, value,
         row_number() OVER (PARTITION BY ZCTA, measureid ORDER BY seq, value) AS rn
  FROM {values} WHERE value IS NOT NULL AND measureid IS NOT NULL) t WHERE rn = 1"""


def _wide_cte(first: str) -> str:
    return f"""
SELECT ZCTA,
    max(CASE WHEN measureid = 'ACCESS2' THEN value END) AS spatial_lack_insurance,
    max(CASE WHEN measureid = 'MHLTH' THEN value END) AS spatial_poor_mental_health,
    max(CASE WHEN measureid = 'OBESITY' THEN value END) AS OBESITY,
    max(CASE WHEN measureid = 'OTHER4' THEN value END) AS OTHER4,
    max(CASE WHEN measureid = 'OTHER5' THEN value END) AS OTHER5,
    max(CASE WHEN measureid = 'OTHER6' THEN value END) AS OTHER6,
    max(CASE WHEN measureid = 'OTHER7' THEN value END) AS OTHER7
FROM {first} GROUP BY ZCTA"""


CTES.update({
    "pz_values": _values_cte("places_zcta", False),
    "pz_first": _first_cte("pz_values"),
    "pz_wide": _wide_cte("pz_first"),
    "zcta_prefix": f"""
SELECT *, {ZIP2_STATE} AS stateabbr,
  CASE WHEN ({ZIP2_STATE}) IS NOT NULL THEN 'zip_prefix' END AS state_source FROM pz_wide""",
    "zcta_tbl": "SELECT ZCTA, stateabbr, spatial_lack_insurance, spatial_poor_mental_health FROM zcta_prefix",
    "crosswalk": standins.crosswalk_sql("part"),
    "crosswalk_one": f"SELECT {_zfill5(_strip('zcta'))} AS ZCTA, min(stateabbr) AS stateabbr FROM crosswalk GROUP BY 1",
    "req": standins.REQUESTS_SQL.replace("{orders}", "orders"),
    "res": f"""
SELECT r.* EXCLUDE (v, req_state), r.v AS zip_valid,
  CASE WHEN r.lookup_mode = 'zip' AND NOT r.v THEN 'malformed'
       WHEN r.lookup_mode = 'zip' AND z.ZCTA IS NULL THEN 'not_found'
       WHEN r.lookup_mode <> 'zip' AND s.stateabbr IS NULL THEN 'not_found' ELSE 'ok' END AS status,
  CASE WHEN r.lookup_mode = 'zip' AND z.ZCTA IS NOT NULL
         THEN 'ZIP ' || {_strip('r.zip_text')} || CASE WHEN z.stateabbr IS NOT NULL THEN ' (' || z.stateabbr || ')' ELSE '' END
       WHEN r.lookup_mode <> 'zip' AND s.stateabbr IS NOT NULL THEN s.stateabbr ELSE 'N/A' END AS region_label,
  CASE WHEN r.lookup_mode = 'zip' THEN z.spatial_lack_insurance ELSE s.spatial_lack_insurance END AS spatial_lack_insurance,
  CASE WHEN r.lookup_mode = 'zip' THEN z.spatial_poor_mental_health ELSE s.spatial_poor_mental_health END AS spatial_poor_mental_health
FROM (SELECT *, coalesce(regexp_matches({_strip('zip_text')}, '^[0-9]{{5}}$'), false) AS v,
             {STATE_ABBR} AS req_state FROM req) r
LEFT JOIN (SELECT * FROM zcta_tbl WHERE regexp_matches(ZCTA, '^[0-9]{{5}}$')) z
  ON r.lookup_mode = 'zip' AND r.v AND {_strip('r.zip_text')} = z.ZCTA
LEFT JOIN (SELECT * FROM state_avg WHERE stateabbr IN ({KNOWN_STATES})) s
  ON r.lookup_mode = 'state' AND r.req_state = s.stateabbr""",
    "fallback": "\nUNION ALL\n".join(
        "SELECT request_id, '" + t + "' AS target, '" + fixed.TARGET_DISPLAY_NAMES[t] + "' AS condition, "
        + "least(greatest(" + "".join([
            f"{a!r}::DOUBLE"] + [
            (" + " if c > 0 else " - ") + f"CAST({col} AS DOUBLE) * {abs(c)!r}::DOUBLE"
            for c, col in ((b1, "age_code"), (b2, "income_code"),
                           (b3, "coalesce(spatial_lack_insurance, 0.0::DOUBLE)"),
                           (b4, "coalesce(spatial_poor_mental_health, 0.0::DOUBLE)")) if c != 0])
        + f", {fixed.FALLBACK_CLIP[0]!r}::DOUBLE), {fixed.FALLBACK_CLIP[1]!r}::DOUBLE) AS score, "
        + "'placeholder_not_model' AS score_kind FROM res"
        for t, (a, b1, b2, b3, b4) in fixed.FALLBACK_SCORE.items()),
    "national": "SELECT * FROM (VALUES " + ", ".join(
        f"('{k}', {v!r}::DOUBLE)" for k, v in fixed.NATIONAL_PREVALENCE.items())
        + ") t(condition, national_prevalence)",
    "preds": "SELECT resp_id, stateabbr, age_code, income_code, educa_code, race_code, " + ", ".join(
        f"{_ref_score(i)} AS pred_{t}" for i, t in enumerate(TARGETS)) + " FROM model_frame",
})


def missing_rows(table: str, cols) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing, "
        f"CAST(count_if({c} IS NULL) AS DOUBLE) * 100 / count(*) AS pct_missing, count(*) AS n_rows FROM {table}"
        for c in cols)


def worst_check(table: str, cols) -> str:
    m = f"SELECT column_name, round_even(pct_missing, 1) AS pct FROM ({missing_rows(table, cols)}) r"
    return f"""
SELECT *, worst_pct > 25 AND worst_pct > next_pct * 2 AS outcome_coding_warning, worst_pct > 30 AS dominant_column_warning FROM (
SELECT (SELECT column_name FROM ({m}) a ORDER BY pct DESC, column_name DESC LIMIT 1) AS worst_column,
  (SELECT max(pct) FROM ({m}) b) AS worst_pct,
  COALESCE((SELECT pct FROM ({m}) c ORDER BY pct DESC LIMIT 1 OFFSET 1), 0.0) AS next_pct) w"""


FEATURE_DISPLAY = _case_map("feature", fixed.FEATURE_DISPLAY_NAMES, quote_keys=True)
FEATURE_ORDER = "CASE feature " + " ".join(
    f"WHEN '{f}' THEN {i}" for i, f in enumerate(FEATURES, start=1)) + " END"
REPEATS = fixed.PERMUTATION_REPEATS


def _ref_score_cols(i: int, cols: dict) -> str:
    c = {k: cols.get(k, k) for k in ("age_code", "smoker_code", "income_code", "educa_code", "race_code")}
    return (f"CAST(({c['age_code']} * 3 + {c['smoker_code']} * 2 + {c['income_code']} * 5 + {c['educa_code']}"
            f" + {c['race_code']} * 7 + {5 * i}) % 64 AS DOUBLE) / 64.0::DOUBLE")


def permutation_sql() -> str:
    return "SELECT * FROM perm_imp"


def _shuffle_terms(first: int, many: int) -> str:
    """k, n, a, b of shuffles first..first + many - 1: position j receives from (a j + b) mod n."""
    return f"""
SELECT k, n, min(start + i) FILTER (gcd(start + i, n) = 1) AS a, (12345 + 15485863 * (k + {first})) % n AS b FROM (
  SELECT range AS k, n, (7919 + 104729 * (range + {first})) % least(n, 1048576) AS start
  FROM range({many}), (SELECT greatest(count(*), 1) AS n FROM perm_h) c) s, (SELECT range AS i FROM range(1000)) r
GROUP BY k, n"""


def _perm_ctes() -> dict:
    feats = ", ".join(FEATURES)
    tg = ", ".join(TARGETS)
    donor_feats = ", ".join(f"{f} AS d_{f}" for f in FEATURES)
    variant_sel = []
    for f in FEATURES:
        correct = ", ".join(
            f"count_if(CAST({_ref_score_cols(i, {f: 'd_' + f})} > 0.5 AS INTEGER) = {t}) AS c_{t}"
            for i, t in enumerate(TARGETS))
        variant_sel.append(f"SELECT '{f}' AS feature, {correct} FROM perm_paired")
    base = ", ".join(f"count_if(CAST({_ref_score_cols(i, {})} > 0.5 AS INTEGER) = {t}) AS b_{t}"
                     for i, t in enumerate(TARGETS))
    unp = "\nUNION ALL\n".join(
        f"SELECT v.feature, '{t}' AS target, CAST({REPEATS} * b.b_{t} - v.c_{t} AS DOUBLE) / "
        f"CAST({REPEATS} * b.n AS DOUBLE) AS importance, 'permutation_reference_score' AS method "
        f"FROM perm_variants v, perm_base b" for t in TARGETS)
    return {
        "perm_h": f"SELECT resp_id, {feats}, {tg} FROM ev WHERE is_test",
        "perm_recv": "SELECT *, row_number() OVER (ORDER BY resp_id) - 1 AS place FROM perm_h",
        "perm_terms": _shuffle_terms(0, REPEATS),
        "perm_donor": f"SELECT place AS donor, {donor_feats} FROM perm_recv",
        "perm_paired": """
SELECT r.*, d.* EXCLUDE (donor), t.k FROM perm_recv r CROSS JOIN perm_terms t
JOIN perm_donor d ON d.donor = (r.place * t.a + t.b) % t.n""",
        "perm_variants": "\nUNION ALL\n".join(variant_sel),
        "perm_base": f"SELECT count(*) AS n, {base} FROM perm_h",
        "perm_imp": unp,
    }


CTES.update(_perm_ctes())


ORDERINGS = 10


def _shapley_ctes() -> dict:
    """Sampled Shapley values of the reference score: of each ordering, the score with the features up
    to one switched to the row's own, less the score with those before it."""
    own = ", ".join(FEATURES)
    prime = 2147483647
    hashes = []
    for j in range(len(FEATURES)):
        x = f"((resp_id % {prime}) * (69621 + 2 * m) * {2 * j + 1} + {(j + 1) * 1566083941}) % {prime}"
        x = f"(({x}) * ({x}) + {40692 * (j + 1)}) % {prime}"
        hashes.append(f"(({x}) * ({x}) + {j}) % {prime} AS h{j}")
    places = [" + ".join(f"CAST(h{i} < h{j} OR (h{i} = h{j} AND {i} < {j}) AS INTEGER)" for i in range(len(FEATURES))) + f" AS p{j}"
              for j in range(len(FEATURES))]
    used = ("age_code", "smoker_code", "income_code", "educa_code", "race_code")
    parts = []
    for j, f in enumerate(FEATURES):
        def state(op, j=j):
            return {g: f"(CASE WHEN p{FEATURES.index(g)} {op} p{j} THEN {g} ELSE z_{g} END)" for g in used}
        for i, t in enumerate(TARGETS):
            gain = f"{_ref_score_cols(i, state('<='))} - {_ref_score_cols(i, state('<'))}"
            parts.append(f"SELECT resp_id, '{f}' AS feature, '{t}' AS target, sum({gain}) / {ORDERINGS} AS phi, "
                         f"CAST({ORDERINGS} AS BIGINT) AS n_orderings FROM sh_places GROUP BY resp_id")
    return {
        "sh_terms": _shuffle_terms(1000, ORDERINGS),
        "sh_pairs": f"SELECT r.resp_id, t.k AS m, {', '.join('r.' + f for f in FEATURES)}, {', '.join(f'd.{f} AS z_{f}' for f in FEATURES)} "
                    "FROM perm_recv r CROSS JOIN sh_terms t JOIN perm_recv d ON d.place = (r.place * t.a + t.b) % t.n",
        "sh_hashes": f"SELECT *, {', '.join(hashes)} FROM sh_pairs",
        "sh_places": f"SELECT * , {', '.join(places)} FROM sh_hashes",
        "sh_phi": "\nUNION ALL\n".join(parts),
    }


CTES.update(_shapley_ctes())


# a stand-in model's node table, scored by a recursive walk
def _value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else \
        f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)


_X = "CASE n.feature " + " ".join(f"WHEN '{f}' THEN w.{f}" for f in FEATURES) + " END"
_GOES_LEFT = f"(CASE WHEN ({_X}) IS NULL THEN n.default_left ELSE ({_X}) <= n.threshold END)"


def _walk(source: str, key: str, more: str = "") -> str:
    """Margins of ``source``'s rows: each goes down every tree from its root."""
    cols = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
    kept = ", ".join(f"w.{f}" for f in FEATURES)
    return f"""
WITH RECURSIVE w AS (
  SELECT {key}, {cols}, t.target, t.tree, 0 AS node FROM {source} CROSS JOIN (SELECT DISTINCT target, tree FROM nodes) t
  UNION ALL
  SELECT w.{key}, {kept}, w.target, w.tree, CASE WHEN {_GOES_LEFT} THEN n.lft ELSE n.rgt END
  FROM w JOIN nodes n ON n.target = w.target AND n.tree = w.tree AND n.node = w.node WHERE n.feature IS NOT NULL)
SELECT w.{key}, w.target, sum(n.value) AS margin, round_even(1.0::DOUBLE / (1.0::DOUBLE + exp(-sum(n.value))), 9) AS p
FROM w JOIN nodes n ON n.target = w.target AND n.tree = w.tree AND n.node = w.node WHERE n.feature IS NULL GROUP BY ALL"""


REQUEST_FEATURES = ", ".join(
    ("CASE WHEN height_ft * 12 + height_in > 0 THEN 703 * weight_lbs / ((height_ft * 12 + height_in) * (height_ft * 12 + height_in)) END AS bmi"
     if c == "bmi" else f"CAST({c} AS DOUBLE) AS {c}") for c in FEATURES)

CTES.update({
    "nodes": "SELECT * FROM (VALUES " + ",\n".join("(" + ", ".join(map(_value, r)) + ")" for r in standins.forest_rows())
             + ") t(target, tree, node, feature, threshold, default_left, lft, rgt, value, cover)",
    "ev_margins": _walk("ev", "resp_id"),
    "req_rows": f"SELECT request_id, {REQUEST_FEATURES} FROM res",
    "req_margins": _walk("req_rows", "request_id"),
    # Shapley values: each leaf's path features with the share of rows that their splits let through (z) and
    # whether the row meets them (o); what a feature adds, by the number of features on the path
    "leaf_steps": """
WITH RECURSIVE p AS (
  SELECT target, tree, 0 AS node, CAST([] AS STRUCT(feature VARCHAR, threshold DOUBLE, default_left BOOLEAN, goes_left BOOLEAN, part DOUBLE)[]) AS steps
  FROM (SELECT DISTINCT target, tree FROM nodes)
  UNION ALL
  SELECT p.target, p.tree, c.node, list_append(p.steps, {'feature': n.feature, 'threshold': n.threshold, 'default_left': n.default_left,
    'goes_left': c.node = n.lft, 'part': c.cover / n.cover})
  FROM p JOIN nodes n ON n.target = p.target AND n.tree = p.tree AND n.node = p.node
  JOIN nodes c ON c.target = p.target AND c.tree = p.tree AND c.node IN (n.lft, n.rgt))
SELECT p.target, p.tree, p.node AS leaf, n.value, unnest(p.steps, max_depth := 2)
FROM p JOIN nodes n ON n.target = p.target AND n.tree = p.tree AND n.node = p.node WHERE n.feature IS NULL""",
    "fs_rows": f"SELECT resp_id, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)} FROM ev WHERE is_test",
    "fs_players": f"""
SELECT w.resp_id, n.target, n.tree, n.leaf, any_value(n.value) AS value, n.feature,
  CAST(bool_and({_GOES_LEFT} = n.goes_left) AS DOUBLE) AS o, product(n.part) AS z
FROM fs_rows w CROSS JOIN leaf_steps n GROUP BY w.resp_id, n.target, n.tree, n.leaf, n.feature""",
    "fs_paths": """
SELECT resp_id, target, tree, leaf, any_value(value) AS value, list({'feature': feature, 'o': o, 'z': z}) AS l
FROM fs_players GROUP BY resp_id, target, tree, leaf""",
    "fs_gains": """
SELECT resp_id, target, i.feature, value * (i.o - i.z) * CASE len(others)
    WHEN 0 THEN 1.0::DOUBLE
    WHEN 1 THEN (others[1].o + others[1].z) / 2
    ELSE others[1].z * others[2].z / 3 + (others[1].o * others[2].z + others[1].z * others[2].o) / 6 + others[1].o * others[2].o / 3 END AS gain
FROM (SELECT resp_id, target, value, i, list_filter(l, lambda x: x.feature <> i.feature) AS others
      FROM (SELECT *, unnest(l) AS i FROM fs_paths) a) b""",
    "fs_phi": f"""
SELECT r.resp_id, f.feature, t.target, round_even(coalesce(g.phi, 0.0) + 3e-10::DOUBLE, 9) + 0.0 AS phi
FROM fs_rows r CROSS JOIN (SELECT unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature) f
CROSS JOIN (SELECT DISTINCT target FROM nodes) t
LEFT JOIN (SELECT resp_id, target, feature, sum(gain) AS phi FROM fs_gains GROUP BY ALL) g
  ON g.resp_id = r.resp_id AND g.feature = f.feature AND g.target = t.target""",
})


def with_ctes(select: str) -> str:
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items())
    return f"WITH {body}\n{select}"


SELECTS: dict[str, str] = {}


def q(name: str, select: str) -> None:
    SELECTS[name] = select


def all_queries() -> dict[str, str]:
    return {name: with_ctes(sel) for name, sel in SELECTS.items()}
