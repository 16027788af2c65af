import numpy as np
import pandas as pd

from tablelens.operators import column_stats, outliers, profile


def _by_name(df, col):
    return {r["column_name"]: r[col] for r in df.collect()}


def test_missing(edge_profile):
    assert _by_name(profile.missing_by_column(edge_profile), "missing") == {"id": 0, "x": 2, "t": 2, "b": 1}
    r = profile.missing_total(edge_profile).first()
    assert r["missing_total"] == 5 and r["n_cells"] == 32 and r["missing_pct"] == 15.625


def test_unique_and_duplicate_values(edge_profile):
    d = profile.distinct_counts(edge_profile).collect()
    uniq = {r["column_name"]: r["unique"] for r in d}
    dup = {r["column_name"]: r["duplicate_values"] for r in d}
    assert uniq == {"id": 8, "x": 5, "t": 3, "b": 2}
    assert dup == {"id": 0, "x": 2, "t": 4, "b": 5}
    # property: unique + duplicates (+1 when missing exists) = rows
    for r in d:
        assert r["unique"] + r["duplicate_values"] + int(r["has_missing"]) == r["n_rows"]


def test_duplicate_rows(edge_profile):
    tb = edge_profile.select("t", "b")
    assert profile.duplicate_rows_total(tb).first()["duplicate_rows"] == 2
    assert profile.duplicate_rows_listing(tb).count() == 2


def test_duplicate_listing_chunks_match_bruteforce(spark):
    rows = [("hot",)] * 1000 + [("a",)] * 3 + [("b",)]
    df = spark.createDataFrame(rows, "v string")
    out = profile.duplicate_rows_listing(df, chunk=7, spread=4).groupBy("v").count()
    assert {r["v"]: r["count"] for r in out.collect()} == {"hot": 999, "a": 2}


def test_outlier_fences(edge_profile):
    f = outliers.fit_fences(edge_profile)
    assert (f["x"].q1, f["x"].q3) == (2.25, 4.0)
    assert (f["x"].lower, f["x"].upper) == (-0.375, 6.625)
    assert (f["b"].q1, f["b"].q3) == (0.5, 1.0)
    res = {r["column_name"]: r for r in outliers.iqr_outliers(edge_profile).collect()}
    assert res["x"]["outliers"] == 1 and res["b"]["outliers"] == 0
    assert res["t"]["outliers"] is None and res["t"]["q1"] is None
    rows = outliers.outlier_rows(edge_profile, "x").collect()
    assert [r["id"] for r in rows] == [5]


def test_column_stats_and_overview(edge_profile):
    st = {r["column_name"]: r for r in column_stats.column_stats(edge_profile).collect()}
    assert st["x"]["missing"] == 2 and st["x"]["unique"] == 5 and st["x"]["duplicate_values"] == 2
    assert st["x"]["min_num"] == 1.0 and st["x"]["max_num"] == 100.0 and st["x"]["outliers"] == 1
    assert st["t"]["min_str"] == "a" and st["t"]["max_str"] == "c"
    ov = profile.table_overview(edge_profile).first()
    assert ov["n_rows"] == 8 and ov["n_columns"] == 4 and ov["missing_total"] == 5
    assert (ov["n_numeric"], ov["n_categorical"], ov["n_boolean"]) == (2, 1, 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, t string")
    assert profile.missing_total(df).first()["missing_pct"] == 0.0
    assert profile.table_overview(df).first()["n_rows"] == 0
    res = {r["column_name"]: r for r in outliers.iqr_outliers(df).collect()}
    assert res["x"]["q1"] is None


def test_numeric_coercible_excludes_booleans(edge_profile):
    res = {r["column_name"]: r["is_numeric"] for r in profile.numeric_coercible(edge_profile).collect()}
    assert res == {"id": True, "x": True, "t": False, "b": False}


def test_size_estimate(spark):
    df = spark.createDataFrame([("ab", 1), ("é", None)], "s string, i int")
    res = {r["column_name"]: r["size_bytes"] for r in profile.size_estimate(df).collect()}
    assert res == {"s": 4, "i": 4}


def test_profile_matches_pandas_on_lineitem(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    pdf = df.toPandas()
    st = {r["column_name"]: r for r in column_stats.column_stats(df).collect()}
    for c in ["l_quantity", "l_extendedprice", "l_discount"]:
        s = pdf[c]
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        iqr = q3 - q1
        n_out = int(((s < q1 - 1.5 * iqr) | (s > q3 + 1.5 * iqr)).sum())
        assert st[c]["outliers"] == n_out
        assert st[c]["unique"] == s.nunique()
        assert st[c]["duplicate_values"] == int(s.duplicated().sum())


def test_select_by_class(edge_profile):
    assert profile.columns_of_class(edge_profile, include=["numeric"]) == ["id", "x"]
    assert profile.select_by_class(edge_profile, exclude=["numeric"]).columns == ["t", "b"]
    assert profile.dtypes_text(edge_profile) == "id: bigint, x: double, t: string, b: boolean"


def test_fingerprint_matches_exact(spark, edge_profile):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        "l_returnflag", "l_linestatus", "l_linenumber", "l_discount")
    for df in (li, edge_profile, edge_profile.select("t", "b")):
        a = profile.table_overview(df).first().asDict()
        b = profile.table_overview(df, method="fingerprint").first().asDict()
        assert a == b
        assert (profile.duplicate_rows_total(df).first().asDict()
                == profile.duplicate_rows_total(df, method="fingerprint").first().asDict())
    # a value must not move between columns unnoticed
    sw = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert profile.duplicate_rows_total(sw, method="fingerprint").first()["duplicate_rows"] == 0
    z = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert profile.duplicate_rows_total(z, method="fingerprint").first()["duplicate_rows"] == 1


def test_wide_table_chunks(spark):
    rng = np.random.default_rng(11)
    k = 60
    data = rng.integers(0, 5, size=(200, k)).astype(float)
    data[rng.random(size=data.shape) < 0.2] = np.nan
    cols = [f"w{i}" for i in range(k)]
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in row) for row in data],
                               ", ".join(f"{c} double" for c in cols))
    pdf = pd.DataFrame(data, columns=cols)
    miss = {r["column_name"]: r["missing"] for r in profile.missing_by_column(df).collect()}
    assert miss == {c: int(pdf[c].isna().sum()) for c in cols}
    st = {r["column_name"]: r for r in column_stats.column_stats(df).collect()}
    assert len(st) == k
    for c in cols:
        assert st[c]["unique"] == pdf[c].nunique()
        assert st[c]["duplicate_values"] == int(pdf[c].duplicated().sum())
        assert st[c]["max_num"] == pdf[c].max()


def test_duplicates_by_candidates(spark):
    """Equal to grouping whole rows, with missing values, both zeros and either join."""
    rows = [(i % 40 if i % 3 else None, float(i % 7) * (-1 if i % 2 else 1), "t" * (i % 5)) for i in range(300)]
    rows += [(1000, 0.0, "z"), (1000, -0.0, "z"), (1001, float("nan"), None), (1001, None, None), (1002, 1.0, "once")]
    df = spark.createDataFrame(rows, "a int, b double, c string")
    total = profile.duplicate_rows_total(df).first()
    assert profile.duplicate_rows_total(df, "candidates").first() == total and total["duplicate_rows"] > 2
    listed = profile.duplicate_rows_listing(df)
    by_candidates = profile.duplicate_rows_listing(df, method="candidates")
    assert listed.exceptAll(by_candidates).count() == 0 == by_candidates.exceptAll(listed).count()
    few, many = (profile.repeated_rows(df, n) for n in (10**6, 0))
    assert few.exceptAll(many).count() == 0 and few.count() == many.count()
    assert "Broadcast" in few._jdf.queryExecution().executedPlan().toString()
    assert profile.duplicate_rows_total(df.limit(0), "candidates").first()["n_rows"] == 0
