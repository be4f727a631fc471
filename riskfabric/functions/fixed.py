"""Fixed values.

Everything in this module is a value that must equal the modelled system's
for results to agree: code books, lookup tables, labels and constants.  They
are stated plainly, in natural order, and used as data by the operators.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: survey state FIPS code -> state abbreviation (54 entries).
# Codes not listed map to null.
# ---------------------------------------------------------------------------
STATE_FIPS_TO_ABBR = {
    1: "AL", 2: "AK", 4: "AZ", 5: "AR", 6: "CA", 8: "CO", 9: "CT",
    10: "DE", 11: "DC", 12: "FL", 13: "GA", 15: "HI", 16: "ID",
    17: "IL", 18: "IN", 19: "IA", 20: "KS", 21: "KY", 22: "LA",
    23: "ME", 24: "MD", 25: "MA", 26: "MI", 27: "MN", 28: "MS",
    29: "MO", 30: "MT", 31: "NE", 32: "NV", 33: "NH", 34: "NJ",
    35: "NM", 36: "NY", 37: "NC", 38: "ND", 39: "OH", 40: "OK",
    41: "OR", 42: "PA", 44: "RI", 45: "SC", 46: "SD", 47: "TN",
    48: "TX", 49: "UT", 50: "VT", 51: "VA", 53: "WA", 54: "WV",
    55: "WI", 56: "WY", 66: "GU", 72: "PR", 78: "VI",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: approximate two-digit ZIP prefix -> state fallback
# (100 entries, every prefix 00-99).
# ---------------------------------------------------------------------------
ZIP2_TO_STATE = {
    "00": "PR",
    "01": "MA", "02": "MA", "03": "NH", "04": "ME", "05": "VT", "06": "CT", "07": "NJ", "08": "NJ", "09": "NJ",
    "10": "NY", "11": "NY", "12": "NY", "13": "NY", "14": "NY", "15": "PA", "16": "PA", "17": "PA", "18": "PA", "19": "PA",
    "20": "MD", "21": "MD", "22": "VA", "23": "VA", "24": "WV", "25": "WV", "26": "WV", "27": "NC", "28": "NC", "29": "NC",
    "30": "GA", "31": "GA", "32": "FL", "33": "FL", "34": "FL", "35": "AL", "36": "AL", "37": "TN", "38": "TN", "39": "MS",
    "40": "KY", "41": "KY", "42": "KY", "43": "OH", "44": "OH", "45": "OH", "46": "IN", "47": "IN", "48": "MI", "49": "MI",
    "50": "IA", "51": "IA", "52": "IA", "53": "WI", "54": "WI", "55": "MN", "56": "MN", "57": "SD", "58": "ND", "59": "MT",
    "60": "IL", "61": "IL", "62": "IL", "63": "MO", "64": "MO", "65": "MO", "66": "KS", "67": "KS", "68": "NE", "69": "NE",
    "70": "LA", "71": "LA", "72": "AR", "73": "OK", "74": "OK", "75": "TX", "76": "TX", "77": "TX", "78": "TX", "79": "TX",
    "80": "CO", "81": "CO", "82": "WY", "83": "ID", "84": "UT", "85": "AZ", "86": "AZ", "87": "NM", "88": "NM", "89": "NV",
    "90": "CA", "91": "CA", "92": "CA", "93": "CA", "94": "CA", "95": "CA", "96": "HI", "97": "OR", "98": "WA", "99": "AK",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: survey extract column names -> our raw column names (the 18
# expected columns of the survey scan).
# ---------------------------------------------------------------------------
SURVEY_COLUMNS = {
    "DIABETE4": "diabetes_raw",
    "CVDSTRK3": "stroke_raw",
    "ASTHMA3": "asthma_raw",
    "CHCCOPD3": "copd_raw",
    "CHCOCNC1": "cancer_raw",
    "_MICHD": "michd_raw",
    "_AGEG5YR": "age_raw",
    "SEXVAR": "sex_raw",
    "INCOME3": "income_raw",
    "_RACEGR3": "race_raw",
    "EDUCA": "educa_raw",
    "_STATE": "state_fips",
    "MSCODE": "metro_raw",
    "_BMI5": "bmi_x100",
    "_SMOKER3": "smoker_raw",
    "_TOTINDA": "activity_raw",
    "GENHLTH": "genhlth_raw",
    "_RFDRHV9": "drinking_raw",
}

# FIXED VALUES: cleaned covariate names -> model feature names.
FEATURE_RENAME = {
    "_AGEG5YR": "age_code",
    "INCOME3": "income_code",
    "EDUCA": "educa_code",
    "_RACEGR3": "race_code",
    "SEXVAR": "sex_code",
    "BMI": "bmi",
    "_SMOKER3": "smoker_code",
    "_TOTINDA": "physical_activity_code",
    "_RFDRHV9": "heavy_drinking_code",
}

# FIXED VALUES: model features, in model order.
FEATURE_COLUMNS = [
    "age_code", "income_code", "educa_code", "race_code", "sex_code",
    "spatial_lack_insurance", "spatial_poor_mental_health",
    "bmi", "smoker_code", "physical_activity_code",
    "heavy_drinking_code",
]

# FIXED VALUES: binary outcomes, in model order.
TARGET_COLUMNS = [
    "target_diabetes", "target_stroke", "target_cancer",
    "target_cardio", "target_chronic_respiratory",
]

# FIXED VALUES: outcome display names.
TARGET_DISPLAY_NAMES = {
    "target_diabetes": "Diabetes Risk",
    "target_stroke": "Stroke Risk",
    "target_cancer": "Cancer Prevalence",
    "target_cardio": "Cardiovascular Event",
    "target_chronic_respiratory": "Chronic Respiratory Disease",
}

# FIXED VALUES: feature display names.
FEATURE_DISPLAY_NAMES = {
    "age_code": "Age",
    "income_code": "Income",
    "educa_code": "Education",
    "race_code": "Race/Ethnicity",
    "sex_code": "Sex",
    "bmi": "BMI",
    "smoker_code": "Smoking Status",
    "physical_activity_code": "Physical Activity",
    "heavy_drinking_code": "Heavy Drinking",
    "spatial_lack_insurance": "Neighborhood: Lack of Insurance",
    "spatial_poor_mental_health": "Neighborhood: Poor Mental Health",
}

# FIXED VALUES: official national prevalence per outcome display name.
NATIONAL_PREVALENCE = {
    "Diabetes Risk": 0.120,
    "Stroke Risk": 0.034,
    "Cancer Prevalence": 0.087,
    "Cardiovascular Event": 0.070,
    "Chronic Respiratory Disease": 0.173,
}

# FIXED VALUES: disadvantage quartile labels, lowest first.
QUARTILE_LABELS = ["Q1 (Least Disadvantaged)", "Q2", "Q3", "Q4 (Most Disadvantaged)"]

# FIXED VALUES: imputation tier labels.
TIER_CELL = "age_x_education_group"
TIER_EDUCATION = "education_group"
TIER_OVERALL = "overall_median"

# FIXED VALUES: code rules of the survey cleaning.
DK_REFUSED = [7, 9]
DIABETES_VALID = [1, 2, 3, 4]
SEX_VALID = [1, 2]
METRO_VALID = [1, 2, 3, 4, 5]
INCOME_INVALID = [77, 99]
AGE_INVALID = [14]
SINGLE_NINE = [9]
BMI_MIN, BMI_MAX = 12, 100

# FIXED VALUES: thresholds of the checks and reports.
MIN_GROUP_N_FOR_MEDIAN = 30
MIN_EQUITY_GROUP_N = 10
MIN_MAP_SAMPLE_SIZE = 30
ZIP_SHARE_WARN = 0.9
INCOME_MIN, INCOME_MAX = 1, 8
DECISION_THRESHOLD = 0.5
PRIMARY_TARGET = "target_stroke"
MAP_BINS = 5
DEMOGRAPHIC_TRAITS = ["age_code", "income_code", "educa_code", "race_code"]
PREDICTION_COLUMNS = ["stateabbr", "age_code", "income_code", "educa_code", "race_code"]

# FIXED VALUES: placeholder linear score used when no model is loaded.
# (intercept, age, income, lack-of-insurance, poor-mental-health) per outcome,
# clipped to [0.01, 0.99].
FALLBACK_SCORE = {
    "target_diabetes": (0.14, 0.02, -0.015, 0.0, 0.0),
    "target_stroke": (0.04, 0.01, 0.0, 0.003, 0.0),
    "target_cancer": (0.08, 0.015, 0.0, 0.0, 0.0),
    "target_cardio": (0.09, 0.02, 0.0, 0.002, 0.0),
    "target_chronic_respiratory": (0.11, 0.0, 0.0, 0.0, 0.004),
}
FALLBACK_CLIP = (0.01, 0.99)

# FIXED VALUES: model settings.
GBT_ROUNDS = 200
GBT_DEPTH = 6
SEED = 42
TEST_SHARE_MODULUS = 5
PERMUTATION_REPEATS = 10
