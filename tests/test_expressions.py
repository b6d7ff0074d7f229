import math

import pytest
from pyspark.sql import functions as F

from tablescope.functions import columns as C
from tablescope.functions import vocabulary as V


def first_column(df):
    return [r[0] for r in df.collect()]


def test_title_case_follows_letters(one):
    df = one(["it's a-b 3rd mcdonald", "ÉCOLE o'NEIL", "", None], "string")
    assert first_column(df.select(C.title_text(F.col("x")))) == ["It'S A-B 3Rd Mcdonald", "École O'Neil", "", None]


def test_title_case_merges_spellings(one):
    df = one(["american airlines", "American Airlines", "AMERICAN AIRLINES"], "string")
    assert set(first_column(df.select(C.title_text(F.col("x"))))) == {"American Airlines"}


def test_strip_removes_every_blank(one):
    df = one([" a\t\n", " a ", "a b", None], "string")
    assert first_column(df.select(C.strip_text(F.col("x")))) == ["a", "a", "a b", None]


def test_plain_number_is_guarded(one):
    texts = ["nan", "--5", "", "1d", "0x1F", "1_000", "inf", "1e5", ".5", "5.", "+5"]
    expected = [None] * 7 + [100000.0, 0.5, 5.0, 5.0]
    assert first_column(one(texts, "string").select(C.plain_number(F.col("x")))) == expected


def test_currency(one):
    texts = ["$1,234.56", "($2,350.00)", "(2,350.00)", " $5 ", "(−5)", "(-5)", "12d", "unknown", "€7", None]
    expected = [1234.56, -2350.0, -2350.0, 5.0, None, None, None, None, 7.0, None]
    assert first_column(one(texts, "string").select(C.currency_number(F.col("x")))) == expected


@pytest.mark.parametrize(
    "values, expected",
    [([1.0, 2.0, 3.0, 10.0], 1.763632614803888), ([5.0, 5.0, 5.0], 0.0), ([1.0, 2.0], None), ([], None)],
)
def test_unbiased_skew(one, values, expected):
    found = one(values, "double").agg(C.unbiased_skew(F.count("x"), F.skewness("x"))).collect()[0][0]
    assert found == expected if expected is None else math.isclose(found, expected, rel_tol=1e-12)


def test_half_even(one):
    assert first_column(one([0.25, 0.35, 2.5], "double").select(C.half_even(F.col("x"), 1))) == [0.2, 0.4, 2.5]
    assert first_column(one([2.5, 3.5], "double").select(C.fixed_text(F.col("x"), 0))) == ["2", "4"]


@pytest.mark.parametrize("score, word", [(92.0, "Excellent"), (90.0, "Excellent"), (89.9, "Good"), (60.0, "Fair"), (55.0, "Needs Work")])
def test_grades(one, score, word):
    assert first_column(one([score], "double").select(C.grade(F.col("x")))) == [word]


def test_value_text(one):
    df = one([1234.5], "double")
    texts = df.select(C.value_text(F.col("x"), "Claim Amount"), C.value_text(F.col("x"), "hit rate"), C.value_text(F.col("x"), "size"))
    assert tuple(texts.collect()[0]) == ("$1,234.50", "1234.5%", "1,234.5")


def test_keywords_match_parts_of_names():
    assert V.has_keyword("sentiment", V.DATE_KEYWORDS) and V.has_keyword("Paid", V.ID_KEYWORDS)
    assert not V.has_keyword("size", V.ID_KEYWORDS)
    assert V.type_label("nested") == "Other"


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 1.0, None)], "i int, x double, s string")
    assert [tuple(r) for r in C.nan_to_null(df).collect()] == [(1, None, "a"), (2, 1.0, None)]
