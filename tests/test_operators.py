import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rollcall.operators import (
    SchemaClash, bind_by_name, date_spine, distinct_keys, fits_broadcast, has_rows, keep_first,
    latest_date, left_join_null_safe, lookup_keys, next_load_date, role_join,
)


@pytest.fixture
def fact(spark):
    return spark.createDataFrame(
        [(1, "d1", "d2"), (2, "d1", ""), (3, None, "d2"), (4, "zz", None), (5, "dup", "dup")],
        "r int, i string, o string")


@pytest.fixture
def dim(spark):
    return spark.createDataFrame(
        [("d1", "Gate 1"), ("d2", "Gate 2"), (None, "Nowhere"), ("dup", "A"), ("dup", "B")],
        "device_id string, loc string")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_left_join_null_safe_keeps_all_and_matches_null(spark, fact, dim):
    out = left_join_null_safe(fact, dim, "i", "device_id")
    assert "device_id" not in out.columns
    got = rows(out, "r", "loc")
    assert got == sorted([(1, "Gate 1"), (2, "Gate 1"), (3, "Nowhere"), (4, None),
                          (5, "A"), (5, "B")], key=repr)


def test_left_join_without_broadcast_same_result(spark, fact, dim):
    a = rows(left_join_null_safe(fact, dim, "i", "device_id", broadcast=False), "r", "loc")
    b = rows(left_join_null_safe(fact, dim, "i", "device_id", broadcast=True), "r", "loc")
    assert a == b


def test_role_join_fanout_in_both_roles(spark, fact, dim):
    out = role_join(fact, dim, {"i": "in_loc", "o": "out_loc"}, "device_id", "loc")
    got = rows(out, "r", "in_loc", "out_loc")
    assert (2, "Gate 1", None) in got          # "" matches nothing
    assert (4, None, "Nowhere") in got         # unknown id -> null; null id -> null device
    assert len([g for g in got if g[0] == 5]) == 4
    deduped = role_join(fact, dim.union(dim), {"i": "in_loc"}, "device_id", "loc", dedupe_dim=True)
    assert deduped.count() == 6


def test_fits_broadcast_bound(spark, dim):
    assert fits_broadcast(dim, 10_000)
    assert not fits_broadcast(dim, 10)


def test_distinct_keys_excludes_sentinel_keeps_null(spark, fact):
    got = [r["key"] for r in distinct_keys(fact, ["i", "o"]).collect()]
    assert sorted(got, key=lambda v: (v is not None, v)) == [None, "d1", "d2", "dup", "zz"]


def test_lookup_keys_null_safe(spark, fact, dim):
    keys = distinct_keys(fact, ["i", "o"])
    got = rows(lookup_keys(dim, "device_id", keys), "device_id", "loc")
    assert (None, "Nowhere") in got and len(got) == 5


def test_keep_first_order_and_null_group(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), (None, 5, "n5"), (None, 3, "n3"),
                                ("b", 1, "only")], "k string, o int, v string")
    got = rows(keep_first(df, ["k"], [F.col("o")]), "k", "v")
    assert got == sorted([("a", "early"), (None, "n3"), ("b", "only")], key=repr)


def test_keep_first_plans_partial_group_limit(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    plan = keep_first(df, ["k"], [F.col("o")])._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    partial = [i for i, l in enumerate(lines) if "WindowGroupLimit" in l and "Partial" in l]
    exchange = [i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l]
    assert partial and exchange and partial[0] > exchange[0]     # below the shuffle = runs before it


def test_bind_by_name_fills_and_orders(spark):
    a = spark.createDataFrame([(1, "x")], "id int, s string")
    b = spark.createDataFrame([("y", 2.5, 2)], "s string, v double, id int")
    out = bind_by_name(a, b)
    assert out.columns == ["id", "s", "v"]
    assert rows(out, "id", "s", "v") == [(1, "x", None), (2, "y", 2.5)]


def test_bind_by_name_type_clash_raises_before_running(spark):
    a = spark.createDataFrame([(1,)], "id int")
    b = spark.createDataFrame([("1",)], "id string")
    with pytest.raises(SchemaClash):
        bind_by_name(a, b)


def test_marks_null_behaviour(spark):
    df = spark.createDataFrame([("2024-01-03",), (None,), ("2024-01-05",)], "log_date string")
    assert next_load_date(df).first()[0] == dt.date(2024, 1, 6)
    assert latest_date(df).first()[0] is None
    assert latest_date(df.dropna()).first()[0] == dt.date(2024, 1, 5)
    empty = df.filter("false")
    assert next_load_date(empty).first()[0] is None
    assert next_load_date(empty, first="2024-01-01").first()[0] == dt.date(2024, 1, 1)


def test_date_spine_inclusive_and_refuses_backwards(spark):
    got = [r[0] for r in date_spine(spark, "2024-01-30", "2024-02-02").collect()]
    assert got == [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 1), dt.date(2024, 2, 2)]
    with pytest.raises(PySparkException):
        date_spine(spark, "2024-01-05", "2024-01-01").collect()


def test_has_rows(spark, fact):
    assert has_rows(fact).first()[0] is True
    assert has_rows(fact.filter("false")).first()[0] is False
