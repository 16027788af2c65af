import datetime as dt

from pyspark.sql import functions as F

from tablelens.functions import parse_date, text_to_number, type_class
from tablelens.operators import features as fe


def test_text_to_number_accepts(spark):
    vals = ["12", " 12 ", "1e3", "+5", "5.", ".5", "inf", "-Infinity"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(text_to_number(F.col("s"))).collect()]
    assert got == [12.0, 12.0, 1000.0, 5.0, 5.0, 0.5, float("inf"), float("-inf")]


def test_text_to_number_refuses(spark):
    vals = ["1d", "1f", "1_000", "1,000", "0x1F", "True", "", "1e400", "nan", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(text_to_number(F.col("s"))).collect()]
    assert got == [None] * len(vals)


def test_type_classes(spark, edge_profile):
    classes = [type_class(f.dataType) for f in edge_profile.schema.fields]
    assert classes == ["numeric", "numeric", "categorical", "boolean"]


def test_date_parsing_strict(spark):
    vals = ["2020-01-05", "2020-1-5", "2020-02-31", "2020-01-05 10:00:00"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(parse_date(F.col("s"), "yyyy-M-d")).collect()]
    assert got[0] == got[1] == dt.datetime(2020, 1, 5)
    assert got[2] is None and got[3] is None


def test_weekday_monday_zero(spark):
    days = ["2024-01-01", "2024-01-07", "2024-02-29", "2024-03-01"]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    out = fe.date_parts(df, "d", "yyyy-M-d").collect()
    assert [r["d_weekday"] for r in out] == [0, 6, 3, 4]
    assert [r["d_month"] for r in out] == [1, 1, 2, 3]


def test_date_share_threshold_is_strict(spark):
    rows = [("2020-01-0%d" % i,) for i in range(1, 9)] + [("junk",), ("junk",)]
    df = spark.createDataFrame(rows, "d string")
    res = fe.date_like_columns(df).first()
    assert abs(res["share"] - 0.8) < 1e-12 and res["is_date"] is False


def test_formats_of_agrees_with_every_format(spark):
    """The formats named by a value's class are those that parse it, none else."""
    from tablelens.functions.typing_rules import DATE_FORMATS, formats_of
    texts = ["2020-01-02", "1/2/2020", "13/2/2020", "2/13/2020", "2020/1/2", "2020.1.2", "1-2-2020", "31.12.2020", "2 Jan 2020",
             "2-Jan-2020", "Jan 2, 2020", "2 January 2020", "January 2, 2020", "31 Feb 2020", "2020-02-30", "2020", "x", "",
             None, "10:30", "2020-01-02 10:30", "2020-01-02T10:30:05.123Z", "1/2/2020 1:05:06+02:00", "2 May 2020 10:30",
             "May 2, 2020 10:30:01", "2020-01-02 10", "2020-01-02 x:y", "1-2-2020T01:02", "a" * 100, "99 99, 9999"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    every = [parse_date(F.col("s"), f).isNotNull().alias(f"f{j}") for j, f in enumerate(DATE_FORMATS)]
    for r in df.select("s", formats_of(F.col("s")).alias("had"), *every).collect():
        assert sorted(r["had"] or []) == [j for j in range(len(DATE_FORMATS)) if r[f"f{j}"]], r["s"]


def test_few_values(spark):
    from tablelens.operators import features as fe
    df = spark.createDataFrame([(f"v{i % 20:02d}", f"w{i % 21}", f"x{i}", i % 2 == 0, None) for i in range(2000)],
                               "a string, b string, c string, d boolean, e string")
    got = fe.few_values(df, df.columns, 20)
    assert got == {"a": [f"v{i:02d}" for i in range(20)], "b": None, "c": None, "d": [False, True], "e": []}
    assert fe.few_values(df.limit(0), ["a"], 20) == {"a": []}
