import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rollcall.functions import (
    CATEGORY_RULES, category, format_day, if_else, next_day, parse_date, remove_first, title_case,
)


def col_values(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {dtype}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("s"))).collect()]


def test_title_case_word_breaks(spark):
    got = col_values(spark, ["ENT/EYE (OLD)", "anna-marie o'brien", "JUNIOR RESIDENT NG",
                             "M.B.B.S DR.A.KUMAR", None, ""], title_case)
    assert got == ["Ent/Eye (Old)", "Anna-Marie O'brien", "Junior Resident Ng",
                   "M.b.b.s Dr.a.kumar", None, ""]


def test_title_case_is_not_collated(spark):
    df = spark.createDataFrame([("ABC",)], "s string").select(title_case("s").alias("t"))
    assert df.schema["t"].dataType.simpleString() == "string"
    # joins on the result compare as plain binary strings
    other = spark.createDataFrame([("Abc",)], "t string")
    assert df.join(other, "t").count() == 1


def test_remove_first_only_first_and_mid_word(spark):
    got = col_values(spark, ["Tutor Ng Ng", "Junior Resident Ng", "A Ngo", "none", None, " Ng"],
                     lambda c: remove_first(c, " Ng"))
    assert got == ["Tutor Ng", "Junior Resident", "Ao", "none", None, ""]


def test_remove_first_is_case_sensitive(spark):
    assert col_values(spark, ["X NG"], lambda c: remove_first(c, " Ng")) == ["X NG"]


def test_if_else_missing_condition_is_missing(spark):
    got = col_values(spark, ["000046", "000051", None],
                     lambda c: if_else(c == F.lit("000046"), F.lit("own"), F.lit("org")))
    assert got == ["own", "org", None]


def test_category_reference_rules(spark):
    cases = {
        "Assistant Professor": "Faculty", "Statistician": "Faculty",
        "Associate Professor": "Faculty", "Professor": "Faculty",
        "Junior Resident": "Junior Resident", "Tutor": "Junior Resident",
        "Senior Resident": "Senior Resident", "Clerk": "Other", None: "Other",
        "professor": "Other",
    }
    keys = list(cases)
    assert col_values(spark, keys, category) == [cases[k] for k in keys]
    assert sum(len(v) for _, v in CATEGORY_RULES) == 7


def test_category_first_rule_wins(spark):
    rules = [("A", ["x"]), ("B", ["x", "y"])]
    assert col_values(spark, ["x", "y", "z"], lambda c: category(c, rules)) == ["A", "B", "Other"]


def test_dates(spark):
    got = col_values(spark, ["2024-01-05", None], lambda c: next_day(parse_date(c)))
    assert got == [dt.date(2024, 1, 6), None]
    assert col_values(spark, ["2024-01-05"], lambda c: format_day(parse_date(c))) == ["05 Jan 2024"]


def test_parse_date_rejects_bad_text(spark):
    with pytest.raises(PySparkException):
        col_values(spark, ["2024/01/05"], parse_date)
