from collections import Counter
from pathlib import Path

import duckdb
import pytest

from posemill.llm import queries as Q

FOUND = {
    "p2_found": ["record_set", "protein", "record_key"], "p3_found": ["feature_id", "group_name"], "p5_found": ["feature_id_a", "feature_id_b"],
    "p6_found": ["group_level", "group_key", "structvar", "pose", "frame"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, data, duck, name):
    df = Q.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    ran = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols and got == Counter(tuple(x[names.index(c)] for c in cols) for x in ran.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_others_run(spark, data, name):
    assert Q.queries()[name](spark, data).count() >= 0


def test_columns(spark, data):
    for name, cols in FOUND.items():
        assert Q.queries()[name](spark, data).columns == cols
