"""Every registered key against its DuckDB SQL at sf0.01 (the driver's gate)."""

import os

import pytest

from __spark_entry__ import entry
from rollcall.oracle import SQL
from rollcall.queries import QUERIES
from tools.oracle_check import DUCK_TYPE, canon, duck

SF = os.environ.get("ROLLCALL_ORACLE_SF", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_key_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_key_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF)
    s_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    s_cols, s_rows, s_hash = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(SQL[key])
    d_types = {c[0]: str(c[1]) for c in cur.description}
    d_cols, d_rows, d_hash = canon([c[0] for c in cur.description], cur.fetchall())
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert {c: DUCK_TYPE.get(t, t).upper() for c, t in s_types.items()} == \
        {c: t.upper() for c, t in d_types.items()}
    assert s_hash == d_hash, (set(s_rows) ^ set(d_rows))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF",
                                       "FlatMapGroupsInPandas", "MapInPandas")), plan


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["l_orderkey", "l_linenumber", "c_loc", "s_loc"]
    assert df.count() > 0
