"""Large delimited files by chunks: equal to the reader that takes a file in one task."""

import csv
import random

import pytest

from accessio.sources import split, tables


def written(path, rows, sep, end):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, delimiter=sep, lineterminator=end)
        w.writerow(["k", "a cell", "b"])
        w.writerows(rows)


def cells(n, seed):
    r = random.Random(seed)
    parts = ["x", "ä", '"', "\n", "\r\n", ",", "\t", " ", "NA", "nan", "", "long " * 30, '""', "\n\n", "5"]
    return [(str(i), "".join(r.choice(parts) for _ in range(r.randrange(6))), r.choice(["", "NA", "v", '"', "\n" * 50])) for i in range(n)]


@pytest.fixture
def chunked(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize(("name", "end", "na"), [("t.csv", "\n", False), ("t.tsv", "\r\n", True), ("t.csv", "\r\n", False)])
def test_equal_to_one_task(chunked, tmp_path, name, end, na):
    path = str(tmp_path / name)
    rows = cells(400, len(end) + na)
    written(path, rows, tables.delimiter(path), end)
    one = tables.read_table(chunked, path, na_tokens=na, ordinal="ord")
    many = split.read_split_table(chunked, path, na_tokens=na, ordinal="ord")
    assert many.columns == one.columns
    assert [tuple(r)[:3] for r in many.orderBy("ord").collect()] == [tuple(r)[:3] for r in one.orderBy("ord").collect()]
    assert split._lines(chunked, path).select("block").distinct().count() > 20 and one.rdd.getNumPartitions() == 1
    if not na:
        assert [r.k for r in many.orderBy("ord").collect()] == [r[0] for r in rows]


def test_a_cell_over_many_chunks(chunked, tmp_path):
    path = str(tmp_path / "t.csv")
    rows = [("1", "short", "x"), ("2", "line\n" * 2000, 'q"q'), ("3", '"\n"' * 500, ""), ("4", "end", "y")]
    written(path, rows, ",", "\n")
    got = split.read_split_table(chunked, path, ordinal="o").orderBy("o").drop("o").collect()
    assert [tuple(r) for r in got] == rows


def test_several_files_and_no_rows(chunked, tmp_path):
    (tmp_path / "t.csv").mkdir()
    for k, n in enumerate((50, 0, 3)):
        written(str(tmp_path / "t.csv" / f"{k}.csv"), cells(n, k), ",", "\n")
    path = str(tmp_path / "t.csv")
    one, many = tables.read_table(chunked, path, ordinal="o"), split.read_split_table(chunked, path, ordinal="o")
    assert [tuple(r)[:3] for r in many.orderBy("o").collect()] == [tuple(r)[:3] for r in one.orderBy("o").collect()]
    written(str(tmp_path / "none.csv"), [], ",", "\n")
    assert split.read_split_table(chunked, str(tmp_path / "none.csv")).count() == 0
