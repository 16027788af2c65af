import pytest

from tablelens.sources.csv import read_csv


def _write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_overlong_rows_are_errors(spark, tmp_path):
    path = _write(tmp_path, a="x,y\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        read_csv(spark, path, infer=False).collect()


def test_blank_first_line_and_short_rows(spark, tmp_path):
    df = read_csv(spark, _write(tmp_path, a="\nx,y\n1,2\n3\n"))
    assert df.columns == ["x", "y"] and sorted(map(tuple, df.collect())) == [(1, 2), (3, None)]


def test_line_break_in_header(spark, tmp_path):
    df = read_csv(spark, _write(tmp_path, a='"na\nme",age\n"a\nb",2\n'), multi_line=True)
    assert df.columns == ["na\nme", "age"] and [tuple(r) for r in df.collect()] == [("a\nb", 2)]


def test_headers_must_agree(spark, tmp_path):
    with pytest.raises(ValueError, match="different headers"):
        read_csv(spark, _write(tmp_path, a="x,y\n1,2\n", b="y,x\n3,4\n"))


def test_many_files(spark, tmp_path):
    df = read_csv(spark, _write(tmp_path, a="x,y\n1,2\n", b="x,y\n3,u\n"))
    assert sorted(map(tuple, df.collect())) == [(1, "2"), (3, "u")]
