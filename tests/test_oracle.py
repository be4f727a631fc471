"""Registered queries vs their DuckDB twins on the smallest input."""

import math

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
SQL_QUERIES = None


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["orders", "lineitem", "part", "customer", "documents", "pages", "benchmark", "labels", "conversations"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


#: These fit the learner with all its rounds; here they run on a few (see test_learner_checks).
LEARNER = {"m2_fit_settings", "m3_score_checks", "m4_score_checks", "m7_score_checks", "s10_reload_differences"}


def _names():
    import __spark_entry__ as E
    return sorted(set(E.oracle_sql()) - LEARNER)


def test_learner_checks(spark, con, monkeypatch):
    import __spark_entry__ as E
    from riskfabric.plans import training

    fitted = training.fitted
    monkeypatch.setattr(training, "fitted", lambda s, d: fitted(s, d, rounds=2, depth=3))
    for name in sorted(LEARNER):
        sc, sr = _rows(E.queries()[name](spark, SF).toPandas())
        dc, dr = _rows(con.execute(E.oracle_sql()[name]).df())
        assert sc == dc
        if name == "m2_fit_settings":
            trees, depth = sc.index("num_trees"), sc.index("max_depth")
            assert {(r[trees], r[depth]) for r in sr} == {(2.0, 3.0)} and {(r[trees], r[depth]) for r in dr} == {(200.0, 6.0)}
            keep = [k for k in range(len(sc)) if k not in (trees, depth)]
            sr, dr = ([tuple(r[k] for k in keep) for r in x] for x in (sr, dr))
        assert sr == dr
    training.forget()


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF).toPandas()
    ddf = con.execute(E.oracle_sql()[name]).df()
    sc, sr = _rows(sdf)
    dc, dr = _rows(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"stateabbr", "n", "diabetes_prevalence", "spatial_lack_insurance", "enough"}


def test_every_query_has_a_callable():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


TYPE_MAP = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", _names())
def test_query_types_match_oracle(spark, con, name):
    import __spark_entry__ as E
    s = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString())
         for f in E.queries()[name](spark, SF).schema}
    d = {r[0]: r[1] for r in con.execute(f"DESCRIBE {E.oracle_sql()[name]}").fetchall()}
    assert s == d
