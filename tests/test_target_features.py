import pytest

from tablelens.operators import features as fe
from tablelens.operators import target as tg
from tablelens.sources import read_csv

CSV = "name,age,grade\nRama,20,A\nSara,22,B\nAli,19,A\nLina,21,C\n"


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("csv") / "test.csv"
    p.write_text(CSV)
    return read_csv(spark, str(p))


def test_csv_types(sample):
    assert [(f.name, f.dataType.simpleString()) for f in sample.schema.fields] == [
        ("name", "string"), ("age", "bigint"), ("grade", "string")]
    assert sample.count() == 4


def test_csv_tokens_and_header(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,a,,flag\n1,x,NA,True\nn/a,y,,false\n3.5,NULL,z,TRUE\n")
    df = read_csv(spark, str(p))
    assert df.columns == ["a", "a_1", "_c2", "flag"]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert types == {"a": "double", "a_1": "string", "_c2": "string", "flag": "boolean"}
    rows = df.collect()
    assert rows[1]["a"] is None and rows[2]["a_1"] is None and rows[0]["_c2"] is None


def test_validate_targets(sample):
    res = {r["column_name"]: (r["ok"], r["reason"], r["problem_type"]) for r in tg.validate_targets(sample).collect()}
    assert res["name"] == (False, "identifier", "classification")
    assert res["age"] == (True, "ok", "regression")
    assert res["grade"] == (True, "ok", "classification")
    assert tg.validate_target(sample, "nope") == (False, "not_found")


def test_label_encode_decode(sample):
    enc, labels = tg.label_encode(sample, "grade")
    assert [r["value"] for r in labels.orderBy("class_index").collect()] == ["A", "B", "C"]
    assert [r["label"] for r in enc.orderBy("name").collect()] == [0, 2, 0, 1]
    dec = tg.label_decode(enc, labels, "label", "back").collect()
    assert all(r["back"] == r["grade"] for r in dec)
    out = enc.sparkSession.createDataFrame([(7.0,)], "p double")
    assert tg.label_decode(out, labels, "p", "q").first()["q"] == "7"


def test_one_hot_drop_first(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    out = fe.one_hot(df, "c")
    assert out.columns == ["c_b"] and [r[0] for r in out.collect()] == [1, 0, 0]


def test_feature_spec_order_and_reuse(spark):
    rows = [(1, 2.0, "x", i % 2 == 0, "2020-01-0%d" % (i % 9 + 1), 10.0 * i) for i in range(30)]
    df = spark.createDataFrame(rows, "a long, b double, c string, f boolean, d string, y double")
    spec = fe.fit_features(df, "y")
    assert spec.output_columns[:2] == ["a", "b"]
    assert spec.output_columns[2:6] == ["d_year", "d_month", "d_day", "d_weekday"]
    assert "f_True" in spec.output_columns and spec.output_columns[-1] == "y"
    assert "a_x_b" in spec.output_columns
    new = spark.createDataFrame([(5, "zzz")], "a long, c string")
    out = spec.transform(new)
    assert out.columns == spec.feature_columns
    r = out.first()
    assert r["b"] == 0.0 and r["f_True"] == 0
    again = fe.FeatureSpec.from_json(spec.to_json())
    assert again.output_columns == spec.output_columns


def test_high_cardinality_dropped(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(25)], "k string, y double")
    spec = fe.fit_features(df, "y")
    assert "k" in spec.dropped and spec.feature_columns == []


def test_csv_fixture_profile(sample):
    from tablelens.operators import column_stats, outliers, profile
    ov = profile.table_overview(sample).first()
    assert (ov["n_rows"], ov["n_columns"], ov["missing_total"], ov["duplicate_rows"]) == (4, 3, 0, 0)
    assert (ov["n_numeric"], ov["n_categorical"]) == (1, 2)
    st = {r["column_name"]: r for r in column_stats.column_stats(sample).collect()}
    assert {c: st[c]["unique"] for c in st} == {"name": 4, "age": 4, "grade": 3}
    assert {c: st[c]["duplicate_values"] for c in st} == {"name": 0, "age": 0, "grade": 1}
    assert (st["age"]["min_num"], st["age"]["max_num"], st["age"]["outliers"]) == (19.0, 22.0, 0)
    f = outliers.fit_fences(sample)["age"]
    assert (f.q1, f.q3, f.lower, f.upper) == (19.75, 21.25, 17.5, 23.5)


def test_approximate_mode(spark):
    from tablelens.operators import column_stats
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    exact = {r["column_name"]: r["unique"] for r in column_stats.column_stats(df).collect()}
    approx = {r["column_name"]: r["unique"] for r in column_stats.column_stats(df, exact=False).collect()}
    for c in exact:
        assert abs(approx[c] - exact[c]) <= max(2, 0.15 * exact[c])   # rsd 0.05, 3 sigma


def test_single_and_all_column_validation_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    many = {r["column_name"]: (r["ok"], r["reason"]) for r in tg.validate_targets(df).collect()}
    for c in df.columns:
        assert tg.validate_target(df, c) == many[c]


def test_rows_of_a_class_stay_where_they_are(spark, monkeypatch):
    """Two classes are no key to deal rows out by; the class table goes to the rows, unless it is large."""
    from tablelens.functions import layout
    from tablelens.operators import target

    df = spark.createDataFrame([(i, "n" if i % 10 else "y") for i in range(200)] + [(900, None)], "id long, t string")

    def coded():
        out, labels = target.label_encode(df.repartition(7), "t")
        back = target.label_decode(out, labels, "label", "said")
        plan = back._jdf.queryExecution().executedPlan().toString()
        return sorted(map(tuple, back.collect())), plan, out.rdd.getNumPartitions()

    rows, plan, parts = coded()
    joins = [line for line in plan.splitlines() if "LeftOuter" in line]  # of rows with classes
    assert len(joins) >= 2 and all("BroadcastHashJoin" in line for line in joins) and parts == 7
    assert rows == [(i, "n" if i % 10 else "y", 0 if i % 10 else 1, "n" if i % 10 else "y") for i in range(200)]
    monkeypatch.setattr(layout, "SMALL_TABLE", 1)
    assert coded()[0] == rows
