import pytest

from tablescope.plans import cardinality, semantic
from tablescope.functions import vocabulary as V
from tablescope.plans.semantic import convert_date, detect, expected_types, recommendations


def test_rules_in_order(spark):
    rows = [(i, f"n{i}", i * 1.5, "ab"[i % 2], f"note {i}", f"2024-01-{i % 28 + 1:02d}", i % 2 == 0, i % 5, [i]) for i in range(60)]
    df = spark.createDataFrame(
        rows, "order_id long, label string, price double, kind string, remark string, created string, paid boolean, size int, list array<int>"
    )
    found = detect(df)
    assert found.types == {
        "order_id": "id_column", "label": "high_cardinality", "price": "financial", "kind": "categorical", "remark": "text",
        "created": "date_column", "paid": "metric", "size": "metric", "list": "nested",
    }
    assert dict(found.df.dtypes)["created"] == "timestamp_ntz"
    assert found.of_type("financial", "metric") == ["price", "paid", "size"]


@pytest.mark.parametrize("distinct, expected", [(50, "categorical"), (51, "high_cardinality")])
def test_category_limit_is_exact(one, distinct, expected):
    assert detect(one([f"v{i % distinct}" for i in range(500)], "string")).types == {"x": expected}


@pytest.mark.parametrize("unique, expected", [(900, "id_column"), (899, "metric")])
def test_uniqueness_is_exact(one, unique, expected):
    keys = [min(i, unique) for i in range(1, 1001)]
    assert detect(one(keys, "long", "key")).types == {"key": expected}


def test_uniqueness_counts_against_values_present(one):
    assert detect(one([1, 2, 3, None, None, None], "long", "key")).types == {"key": "id_column"}


def test_dates_need_seventy_percent_of_all_rows(one):
    values = ["2020-1-5"] * 7 + ["n/a"] * 3
    assert detect(one(values, "string", "date")).types == {"date": "date_column"}
    assert detect(one(values[1:] + [None], "string", "date")).types == {"date": "categorical"}
    assert dict(convert_date(one(["20200105"] * 4, "string"), "x").dtypes) == {"x": "timestamp_ntz"}


def test_half_strict_dates_do_not_fall_back(one):
    values = ["2020-01-05"] * 6 + ["2020/01/05"] * 4
    assert dict(convert_date(one(values, "string"), "x").dtypes) == {"x": "string"}


def test_empty_table(spark):
    assert detect(spark.createDataFrame([], "id long, s string")).types == {"id": "metric", "s": "categorical"}


def test_expected_types(spark):
    rows = [(f"{i}", f"${i}", f"2024-01-{i + 1:02d}", f"v{i}", "x", i + 0.5, None) for i in range(20)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f double, g string")
    assert [r.expected for r in expected_types(df).orderBy("ordinal").collect()] == [
        "metric", "financial", "date_column", "id_column", "categorical", "metric", "categorical",
    ]


def test_expected_types_from_the_first_rows(spark):
    rows = [(i, "1" if i < 200 else f"word {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, s string")
    assert expected_types(df).where("column = 's'").collect()[0].expected == "categorical"
    assert expected_types(df, sample_rows=200, order_by="k").where("column = 's'").collect()[0].expected == "metric"


def test_last_recommendation_wins(spark):
    rows = [(f"{i % 4}", None if i % 2 else "x", "y", None) for i in range(20)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d double")
    texts = {r.column: r.recommendation for r in recommendations(detect(df)).collect()}
    assert texts["a"].startswith("Values appear numeric")
    assert texts["b"] == texts["c"] == texts["d"] == "Column has only one unique value. Consider removing."


def test_missing_recommendation(one):
    found = recommendations(detect(one(["a", "b", "c", None, None], "string"))).collect()
    assert [r.recommendation for r in found] == ["Column is 40.0% missing. Consider filling or removing."]


def test_sketch_is_only_believed_away_from_thresholds():
    assert cardinality.doubtful(50, 50) and cardinality.doubtful(48, 50) and not cardinality.doubtful(3, 50)
    assert cardinality.uniqueness_doubtful(91, 100, 0.9) and not cardinality.uniqueness_doubtful(100, 100, 0.9)


def test_inventory_counts_are_exact(spark):
    df = spark.createDataFrame([(i, [i], None if i % 3 == 0 else "a") for i in range(30)], "i int, l array<int>, s string")
    found = semantic.column_inventory(detect(df)).orderBy("ordinal").collect()
    assert [(r.unique_values, r.missing) for r in found] == [(30, 0), (None, 0), (1, 10)]


def test_votes_do_not_depend_on_outlines(spark):
    """Each value is tried in every format that its shape allows, and the set of a value is worked out once."""
    shapes = ["{y}-{m}-{d}", "{y}/{m}/{d}", "{m}/{d}/{y}", "{d}/{m}/{y}", "{m}-{d}-{y}", "{d}-{m}-{y}", "{y}.{m}.{d}", "{d}.{m}.{y}", "{m}/{d}/99", "{d}/{m}/05", "{y}0{m}{d}"]
    shapes += ["{d}-Mar-{y}", "Mar {d}, {y}", "March {d}, {y}", "May {d}, {y}", "{d} Mar {y}", "{d} March {y}", "{d} May {y}", "{m}/{d}/{y} 3:04 PM", "{m}/{d}/{y} 3:04 am", "mar {d}, {y}"]
    clocks = ["", " 3:04", " 3:04:05", " 13:04:05.5", "T3:04:05", "T3:04:05.123456", "T03:04:05Z", "T3:04:05.25Z", "T03:04:05+02:00", "T03:04:05.5-03:30", "\n", "\r\n", "\u2028", " ", "x", "é"]
    texts = [(s + c).format(y=y, m=m, d=d) for s in shapes for c in clocks for y, m, d in ((2020, 3, 14), (1999, 4, 31), (2021, 2, 10))]
    texts += ["", "abc", "12", "20200105", "99999999", "--", "A , ", "１/２/2020", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    want = {("date", "x", p): df.where(semantic.parse_date(df.x, p).isNotNull()).count() for p in V.DATE_FORMATS}
    assert semantic.format_votes(df, ["x"]) == want and all(want.values())


def test_each_value_is_read_once(spark, monkeypatch):
    """Few formats are tried on a value, and their work stands once in the plan."""
    plans = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or [])
    semantic.format_votes(spark.range(3).selectExpr("cast(id AS string) AS x"), ["x"])
    assert plans[0].count(V.DATE_FORMATS["yyyy.M.d"]) == 1 and plans[0].count("translate(") == 1
