import csv
import io
import random

import pandas as pd
import pytest

from tablelens.sources import read_csv
from tablelens.sources.csv_records import inside_after, records


def written(path, rows, end="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_text(out.getvalue(), encoding="utf-8", newline="")
    return out.getvalue()


def cells(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("line,sep,outside,inside", [
    ("a,b", ",", False, True), ('"a,b', ",", True, False), ('a,"b', ",", True, False), ('"a""b"', ",", False, False),
    ('5" pipe,3', ",", False, False), ('x"', ",", False, False), ('"a"b,"c', ",", True, True), ("", ",", False, True),
    ('"a""', ",", True, False), ('""', ",", False, True), ('a;"b', ";", True, False), ('a;"b', ",", False, False),
    ('","', ",", False, True), ('""","""', ",", False, True),
])
def test_state_of_a_line(line, sep, outside, inside):
    assert (inside_after(line, False, sep), inside_after(line, True, sep)) == (outside, inside)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_breaks_in_quotes_over_many_splits(small_splits, tmp_path, end):
    rng = random.Random(1)
    pieces = ["plain", 'say "x"', "a,b", "line\nbreak", "two\n\n\nbreaks", "c\r\nd", '"', "\n", "", "é" * 40, "5\" pipe"]
    rows = [["id", "te\nxt", "other"]]
    for i in range(400):
        rows.append([i, " ".join(rng.choices(pieces, k=3)), rng.choice(pieces) if i % 50 else "long\n" * 700])
    text = written(tmp_path / "a.csv", rows, end)
    got = records(small_splits, str(tmp_path / "a.csv"))
    assert got.count() == 401 and got.where("first").count() == 1
    assert got.rdd.getNumPartitions() > 20
    expected = list(csv.reader(io.StringIO(text, newline="")))
    frame = read_csv(small_splits, str(tmp_path / "a.csv"), na_tokens=[], infer=False)
    assert frame.columns == ["id", "te\nxt", "other"]
    assert sorted(tuple(v or "" for v in r) for r in frame.collect()) == sorted(map(tuple, expected[1:]))


def test_several_files_and_types(small_splits, tmp_path):
    for k in range(3):
        written(tmp_path / f"f{k}.csv", [["n", "t"]] + [[100 * k + i, f"a\nb{i}" if i % 3 else "NA"] for i in range(60)])
    df = read_csv(small_splits, str(tmp_path))
    assert df.dtypes == [("n", "bigint"), ("t", "string")]
    whole = pd.concat([pd.read_csv(tmp_path / f"f{k}.csv") for k in range(3)])
    assert cells(df.na.fill("-")) == sorted(whole.fillna("-").itertuples(index=False, name=None))


def test_files_without_breaks_are_left_to_spark(spark, tmp_path):
    written(tmp_path / "a.csv", [["a", "b"], ["x,y", 'q"q'], ["", "z"]])
    assert records(spark, str(tmp_path / "a.csv")) is None
    assert cells(read_csv(spark, str(tmp_path / "a.csv")).na.fill("-")) == [("-", "z"), ("x,y", 'q"q')]


def test_awkward_files(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\ny\n2,z\n')
    with pytest.raises(Exception, match="not closed"):
        read_csv(spark, str(tmp_path / "open.csv")).collect()
    (tmp_path / "long.csv").write_text('a,b\n1,"x\ny",3,4\n')
    with pytest.raises(Exception, match="more than 2 fields"):
        read_csv(spark, str(tmp_path / "long.csv")).collect()
    (tmp_path / "bom.csv").write_bytes(b'\xef\xbb\xbfa,b\r\n\r\n1,"x\r\ny"\r\n2\r\n')
    assert cells(read_csv(spark, str(tmp_path / "bom.csv")).na.fill("-")) == [(1, "x\r\ny"), (2, "-")]
