import os

import pytest

from rollcall.llm.queries import QUERIES, SQL
from tools.oracle_check import canon, duck

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_key_matches_sql(spark, key):
    df = QUERIES[key](spark, SF)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(SF).execute(SQL[key])
    assert got == canon([c[0] for c in cur.description], cur.fetchall())


def test_native_operators_plan_without_python(spark):
    from rollcall.llm.cws import fingerprint_neighbours
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    plan = fingerprint_neighbours(docs, 4)._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("Python", "Pandas", "InArrow"))
