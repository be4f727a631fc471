"""Column expressions shared by the operators.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


WHITE_ENDS = r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """pandas NaN is 'missing'; in Spark it is a value.  Turn it into null."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def null_if_in(c: str | Column, codes: Iterable[int]) -> Column:
    """Sentinel codes to null, every other value (null included) kept."""
    c = col(c)
    return F.when(~c.isin(*codes), c)


def keep_if_in(c: str | Column, valid: Iterable[int]) -> Column:
    """Whitelist: values outside ``valid`` become null."""
    c = col(c)
    return F.when(c.isin(*valid), c)


def four_code_binary(c: str | Column) -> Column:
    """1 -> 1; 2, 3, 4 -> 0; anything else -> null."""
    c = col(c)
    return F.when(c == 1, F.lit(1)).when(c.isin(2, 3, 4), F.lit(0))


def two_code_binary(c: str | Column) -> Column:
    """1 -> 1; 2 -> 0; 7, 9 and anything else -> null."""
    c = col(c)
    return F.when(c == 1, F.lit(1)).when(c == 2, F.lit(0))


def either_target(a: str | Column, b: str | Column,
                  unusable: Iterable[int] = fixed.DK_REFUSED) -> Column:
    """1 if either answer is 1; 0 if both are usable; else null.
    SQL three-valued logic makes a null answer neither 'yes' nor 'usable'."""
    a, b = col(a), col(b)
    codes = list(unusable)
    return F.when((a == 1) | (b == 1), F.lit(1)).when(~a.isin(*codes) & ~b.isin(*codes), F.lit(0))


def bmi_from_x100(c: str | Column) -> Column:
    """BMI = x / 100, null outside [12, 100]."""
    bmi = col(c) / F.lit(100.0)
    return F.when(bmi.between(fixed.BMI_MIN, fixed.BMI_MAX), bmi)


def literal_lookup(key: str | Column, mapping: Mapping) -> Column:
    """Look a key up in a fixed table carried as a map literal; missing keys
    give null.  The table is part of the plan, so no join or exchange."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), col(key))


def zfill5(c: str | Column) -> Column:
    """Left-pad to 5 with zeros, never shortening a longer value."""
    c = col(c)
    return F.when(F.length(c) < 5, F.lpad(c, 5, "0")).otherwise(c)


def strip(c: str | Column) -> Column:
    """Text without white space (blank, tab, line ends) at both ends."""
    return F.regexp_replace(col(c), WHITE_ENDS, "")


def numeric_text(c: str | Column) -> Column:
    """Text that is a plain decimal number, white space at its ends allowed, as
    a double; anything else, ``NaN`` and suffixed numbers included, is null."""
    text = strip(col(c).cast("string"))
    return F.when(text.rlike(NUMBER), text.cast("double"))


def is_zip5(c: str | Column) -> Column:
    """Trimmed text is exactly five digits; null is not a ZIP (P20)."""
    return F.coalesce(strip(c).rlike("^[0-9]{5}$"), F.lit(False))


def bmi_from_height_weight(height_in: str | Column, weight_lb: str | Column) -> Column:
    """703 x lb / in^2, null when height is 0."""
    h, w = col(height_in), col(weight_lb)
    return F.when(h > 0, F.lit(703) * w / (h * h))


def clip(c: str | Column, lo, hi) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double, null when den is 0 or null."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def round_half_even(c: str | Column, digits: int) -> Column:
    """Half-to-even rounding, as numpy and Python's round do."""
    return F.bround(col(c), digits)
