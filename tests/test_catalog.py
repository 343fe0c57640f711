import uuid

import pytest

from rollcall.plans import upsert_employee_view, upsert_employees
from rollcall.sinks import (
    current_view_version, drop_old_view_versions, read_table, read_view, replace_view, view_versions,
)
from tests.conftest import land
from tests.test_plans import _emp


@pytest.fixture
def name():
    return f"reg_{uuid.uuid4().hex[:10]}"


def test_view_is_rebuilt_from_itself(spark, name, tmp_path):
    place = str(tmp_path / "reg")
    assert read_view(spark, name) is None and current_view_version(spark, name) is None
    assert replace_view(spark.range(3), name, place) == 1
    assert replace_view(read_view(spark, name).selectExpr("id * 10 as id"), name, place) == 2
    assert sorted(r[0] for r in spark.sql(f"select id from {name}").collect()) == [0, 10, 20]
    assert replace_view(read_view(spark, name).selectExpr("id", "'x' as more"), name, place) == 3      # columns may change
    assert spark.table(name).columns == ["id", "more"]
    assert drop_old_view_versions(spark, name, place, 2) == [1] and view_versions(spark, name) == [2, 3]
    with pytest.raises(ValueError):
        drop_old_view_versions(spark, name, place, 0)


def test_failed_replace_leaves_the_view(spark, name, tmp_path):
    place = str(tmp_path / "reg")
    replace_view(spark.range(3), name, place)
    with pytest.raises(Exception):
        replace_view(spark.range(3).selectExpr("id", "raise_error('no') as v"), name, place)
    assert current_view_version(spark, name) == 1 and spark.table(name).count() == 3
    assert replace_view(spark.range(5), name, place) == 2 and spark.table(name).count() == 5


def test_employee_view_equals_the_versioned_register(spark, name, landing, warehouse, tmp_path):
    for feed in ([_emp("1", "a", "TUTOR"), _emp("2", "b", "X")], [_emp("2", "c", "PROFESSOR"), _emp("3", "d", "Y")]):
        land(landing, "employee", "employee", feed)
        upsert_employee_view(spark, str(landing), name, str(tmp_path / "reg"))
        upsert_employees(spark, str(landing), warehouse)
    want = read_table(spark, warehouse, "employee")
    assert sorted(map(tuple, spark.table(name).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
