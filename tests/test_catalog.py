"""Every query with SQL against DuckDB on the smallest tables; the others must run and keep their schema."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from posemill.plans import catalog

SLOW = {"leave_one_protein_out", "leave_one_out_average", "perm_importance", "lasso_stability", "cross_validated_lr"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    ran = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(x[names.index(c)]) for c in cols) for x in ran.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_others_run(spark, data, name):
    df = catalog.queries()[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_no_cross_joins(spark, data):
    for name in ("top_pose_global", "fluctuations", "standardize_global", "shifted_log", "scalar_beside"):
        plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_pushdown(spark, data):
    plan = catalog.queries()["semi_join"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "plec_ump1" not in plan
