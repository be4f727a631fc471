"""What several jobs of one application read is made once."""

from __future__ import annotations

from pyspark.sql import SparkSession

_MEMO: dict = {}


def once(spark: SparkSession, key: tuple, make):
    """What ``make`` gives, made once per application; an earlier application's results go."""
    app = spark.sparkContext.applicationId
    if _MEMO.get("app") != app:
        _MEMO.clear()
        _MEMO["app"] = app
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def forget() -> None:
    """Make everything anew from here on (cold measurements, changed inputs)."""
    _MEMO.clear()
