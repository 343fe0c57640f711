"""Properties of the operators against plain-Python brute force."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollcall.functions import CATEGORY_RULES, category, remove_first
from rollcall.operators import bind_by_name, distinct_keys, keep_first, left_join_null_safe
from rollcall.plans import leave_history

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
keys = st.one_of(st.none(), st.sampled_from(["", "a", "b", "c", "d"]))


@SETTINGS
@given(fact=st.lists(keys, max_size=20), dim=st.lists(keys, max_size=8))
def test_left_join_keeps_every_fact_row(spark, fact, dim):
    f = spark.createDataFrame([(i, k) for i, k in enumerate(fact)], "r int, k string")
    d = spark.createDataFrame([(k, f"v{j}") for j, k in enumerate(dim)], "dk string, v string")
    out = left_join_null_safe(f, d, "k", "dk")
    per_key = Counter(dim)
    expected = sum(max(1, per_key.get(k, 0)) for k in fact)
    assert out.count() == expected
    assert {r["r"] for r in out.collect()} == set(range(len(fact)))


@SETTINGS
@given(rows=st.lists(st.tuples(keys, st.integers(0, 1000)), max_size=25, unique_by=lambda t: t[1]))
def test_keep_first_is_first_per_key(spark, rows):
    df = spark.createDataFrame(rows, "k string, o int")
    got = {r["k"]: r["o"] for r in keep_first(df, ["k"], [F.col("o")]).collect()}
    want = {}
    for k, o in rows:
        want[k] = min(o, want.get(k, o))
    assert got == want


@SETTINGS
@given(a=st.lists(keys, max_size=15), b=st.lists(keys, max_size=15))
def test_distinct_keys_matches_set(spark, a, b):
    n = max(len(a), len(b))
    a2, b2 = a + [None] * (n - len(a)), b + [None] * (n - len(b))
    df = spark.createDataFrame(list(zip(a2, b2)), "i string, o string")
    got = sorted((r["key"] for r in distinct_keys(df, ["i", "o"]).collect()), key=repr)
    want = sorted({v for v in a2 + b2 if v != ""}, key=repr)
    assert got == want


@SETTINGS
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="Ng oT", max_size=12)), max_size=15))
def test_remove_first_matches_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(remove_first("s", " Ng")).collect()]
    assert got == [None if t is None else t.replace(" Ng", "", 1) for t in texts]


@SETTINGS
@given(values=st.lists(st.one_of(st.none(), st.sampled_from(
    ["Professor", "Tutor", "Senior Resident", "Clerk", "Statistician", "Junior Resident", ""])), max_size=15))
def test_category_matches_rules(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(category("s")).collect()]
    lookup = {v: label for label, vs in reversed(CATEGORY_RULES) for v in vs}
    assert got == [lookup.get(v, "Other") for v in values]


@SETTINGS
@given(n1=st.integers(0, 5), n2=st.integers(0, 5))
def test_bind_by_name_counts_and_columns(spark, n1, n2):
    a = spark.createDataFrame([(i, "x") for i in range(n1)], "id int, s string")
    b = spark.createDataFrame([(1.0, i) for i in range(n2)], "v double, id int")
    out = bind_by_name(a, b)
    assert out.columns == ["id", "s", "v"] and out.count() == n1 + n2


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["2024-01-01", "2024-01-02"]), st.sampled_from(["e1", "e2"]),
                               st.sampled_from(["Y", "N", None]), st.sampled_from(["x", "y"])),
                     max_size=20),
       seed=st.randoms())
def test_leave_history_ignores_row_order(spark, rows, seed):
    def frame(rs):
        df = spark.createDataFrame(rs, "d string, emp_id string, active_status string, note string")
        return df.select(F.col("d").cast("date").alias("reportdate"), "emp_id", "active_status", "note",
                         F.lit("CL").alias("leave_type"), F.lit("r").alias("reason"),
                         F.lit("hr").alias("created_by"), F.lit("c").alias("creation_date"))
    shuffled = list(rows)
    seed.shuffle(shuffled)
    empty = frame([])
    a = sorted(tuple(r) for r in leave_history(frame(rows), empty).collect())
    b = sorted(tuple(r) for r in leave_history(frame(shuffled), empty).collect())
    assert a == b
    assert len(a) == len({(d, e) for d, e, s, _ in rows if s == "Y"})
