import datetime

import pytest

from tablescope.operators.steps import StepCounts
from tablescope.plans.recipe import Recipe
from tablescope.session import scratch_path
from tablescope.sources import loading, saving
from tablescope.streaming.row_local import clean_stream


def write(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_is_typed_by_whole_columns(spark, tmp_path):
    text = ' id ,amount,flag,mixed,void,created\n1,1.5,True,1,,2020-1-5\n2,n/a,false,x,NULL,2020-01-06\n3,-2e3,True,2,,None\n'
    table = loading.load_csv(spark, write(tmp_path, text))
    assert table.df.dtypes == [
        ("id", "bigint"), ("amount", "double"), ("flag", "boolean"), ("mixed", "string"), ("void", "double"), ("created", "string"),
    ]
    assert [r.amount for r in table.df.orderBy("id").collect()] == [1.5, None, -2000.0]
    assert table.types == {"id": "id_column", "amount": "financial", "flag": "metric", "mixed": "categorical", "void": "metric", "created": "categorical"}


def test_quoted_line_breaks_are_noticed(spark, tmp_path):
    path = write(tmp_path, 'a,b\n1,"two\nlines"\n2,"say ""hi"""\n')
    assert loading.spans_lines(spark, path)
    assert [r.b for r in loading.scan_csv(spark, path).orderBy("a").collect()] == ["two\nlines", 'say "hi"']
    flat = tmp_path / "flat.csv"
    flat.write_text('a,b\n1,"x, y"\n')
    assert not loading.spans_lines(spark, str(flat))


def test_round_trip(spark):
    rows = [(1, " lead", 'quo"te', 0.1, datetime.datetime(2020, 1, 2)), (2, "tab\t", "com,ma", None, None), (3, "line\nbreak", None, 1e300, None)]
    df = spark.createDataFrame(rows, "i long, a string, b string, x double, t timestamp_ntz")
    path = saving.write_csv(df, scratch_path(spark, "test"), "out", datetime.date(2024, 7, 15))
    assert path.endswith("/out_2024-07-15.csv")
    back = loading.scan_csv(spark, path).orderBy("i").collect()
    assert [(r.a, r.b) for r in back] == [(" lead", 'quo"te'), ("tab\t", "com,ma"), ("line\nbreak", None)]
    assert [r.x for r in back] == ["0.1", None, "1.0E300"] and back[0].t == "2020-01-02 00:00:00"


def test_header_trim_refuses_repeated_names(spark):
    df = spark.createDataFrame([(1, 2)], "` a ` int, b int")
    assert loading.trim_header(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        loading.trim_header(spark.createDataFrame([(1, 2)], "` a ` int, a int"))


def test_display_projection(spark):
    df = spark.sql("SELECT timestamp_ntz'2020-01-02 10:00:00' t, date'2020-01-03' d, array(1, 2) l, 1.5D x, 'a' s")
    assert tuple(saving.display_projection(df).collect()[0]) == ("2020-01-02", "2020-01-03", "[1,2]", 1.5, "a")


def test_report_file(spark):
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "line_no int, line string")
    path = saving.write_report(lines, scratch_path(spark, "test"), "report", datetime.date(2024, 7, 15))
    assert path.endswith("report_2024-07-15.txt")
    assert [r.value for r in spark.read.text(path).collect()] == ["a", "b"]


def test_row_local_steps_run_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, " x "), (2, "None"), (None, "y")], "n int, s string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n int, s string").parquet(str(tmp_path / "in"))
    recipe = Recipe().then("trim_whitespace", name="s").then("standardize_case", name="s", case="upper").then("drop_missing_rows", name="n")
    cleaned = clean_stream(stream, recipe)
    assert cleaned.isStreaming
    query = cleaned.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.n, r.s) for r in spark.table("cleaned").collect()) == [(1, "X"), (2, None)]
    with pytest.raises(ValueError):
        clean_stream(stream, Recipe().then("remove_duplicates"))


def test_every_row_local_step_keeps_a_stream(spark, tmp_path):
    spark.sql("SELECT 1 n, ' $5 ' s, timestamp_ntz'2020-05-01' t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n int, s string, t timestamp_ntz").parquet(str(tmp_path / "in"))
    recipe = (
        Recipe().then("fill_missing", name="n", strategy="constant", value=0).then("trim_whitespace", name="s")
        .then("standardize_case", name="s").then("currency_to_number", name="s").then("extract_date_part", name="t", part="month")
        .then("rename_column", old="n", new="m").then("drop_column", name="t").then("drop_missing_rows")
    )
    cleaned = saving.display_projection(clean_stream(stream, recipe))
    assert cleaned.isStreaming and cleaned.columns == ["m", "s", "t_month"]
    query = cleaned.writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("steps").collect()] == [(1, 5.0, 5)]


def test_step_counts():
    assert StepCounts(5, 3, 0).rows_removed == 2


def test_wide_integers_keep_their_digits(spark):
    ids = [str(1234567890123456787 + i) for i in range(3)]
    df = spark.createDataFrame([(a, a + "000", a + ".5") for a in ids], "a string, b string, c string")
    found = loading.infer_types(df)
    assert [t for _, t in found.dtypes] == ["bigint", "string", "double"]
    assert sorted(str(r.a) for r in found.collect()) == ids and sorted(r.b for r in found.collect()) == [a + "000" for a in ids]


def test_scratch_folders_are_shared(spark, tmp_path):
    from tablescope.session import scratch_path

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            _jsc = spark.sparkContext._jsc

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError):
            scratch_path(Elsewhere, "x")


def test_only_files_with_odd_quotes_are_read_whole(spark, tmp_path):
    for i in range(10):
        text = 'x\ny "z"' if i == 4 else f"t {i}"
        quoted = '"' + text.replace('"', '""') + '"'
        (tmp_path / f"part {i}.csv").write_text(f'id,"a b"\n{i},{quoted}\n{i + 100},"say ""hi"""\n')
    odd = loading.odd_files(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in odd] == ["part 4.csv"]
    df = loading.scan_csv(spark, str(tmp_path))
    assert df.columns == ["id", "a b"]
    got = {r.id: r["a b"] for r in df.collect()}
    assert len(got) == 20 and got["4"] == 'x\ny "z"' and got["3"] == "t 3" and got["104"] == 'say "hi"'
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2
    assert loading.scan_csv(spark, str(tmp_path / "part 1.csv")).count() == 2


def test_votes_count_every_format_a_text_reads_in(spark):
    from tablescope.functions import vocabulary as V
    from tablescope.functions.columns import col
    from tablescope.plans.semantic import format_votes, parse_date

    values = ["2024-01-02", "2024-13-02", "1/2/2024", "13/2/2024", "Jan 2, 2024", None, "", "20240102", "no date 5", "1/2/24", "2024-01-02 10:20", "5.6.2024"]
    df = spark.createDataFrame([(v, w) for v, w in zip(values, reversed(values))], "a string, `b.c` string")
    got = format_votes(df, ["a", "b.c"])
    for name in df.columns:
        for p in V.DATE_FORMATS:
            assert got["date", name, p] == df.where(parse_date(col(name), p).isNotNull()).count()
    assert format_votes(df, []) == {}
