"""Small files of many rows: work on them is dealt to tasks by rows."""

import hashlib

import pytest

from accessio.operators import relational
from accessio.plans import catalogue_queries as plans
from accessio.sources import tables


def test_spread(spark):
    one = spark.range(100).coalesce(1)
    dealt = relational.spread(one, "id", 30)
    assert dealt.rdd.getNumPartitions() == 4 and sorted(r.id for r in dealt.collect()) == list(range(100))
    assert relational.spread(one.limit(0), "id", 30).count() == 0


@pytest.mark.parametrize("make", [plans.refs, plans.catalogue_edges])
def test_parts_are_not_left_to_one_task(spark, tmp_path, monkeypatch, make):
    monkeypatch.setattr(plans, "PARTS_A_TASK", 100)
    parts = spark.range(1000).selectExpr("id AS p_partkey", "'a ring' AS p_name", "'Brand#1' AS p_brand", "CAST(id % 9 AS INT) AS p_size")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    plan = make(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 10), REPARTITION" in plan


def test_pages_share_folders(spark, tmp_path, monkeypatch):
    """A folder a task, not a page; rows of one id are pages of their own."""
    monkeypatch.setattr(plans, "PAGES_A_TASK", 10, raising=False)
    monkeypatch.setattr(plans, "scratch", lambda spark, name: str(tmp_path / name))
    rows = [(k, f"<p>{k}\nä</p>") for k in range(95)] + [(7, "again"), (7, "again"), (-3, ""), (None, "no id"), (8, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in plans.page_files(spark, str(tmp_path)).collect()]
    assert sorted((r for r in got if r[1]), key=str) == sorted(((k, hashlib.md5(f"{h}\n".encode()).hexdigest(), len(h) + 1) for k, h in rows if h is not None), key=str)
    assert [r for r in got if r[1] is None] == [(8, None, None)]
    folders = [f for f in (tmp_path / "pages" / "pages").iterdir() if f.is_dir()]
    assert 1 < len(folders) <= 10 and sum(1 for f in folders for _ in f.iterdir()) == len(rows)


def test_pages_written_again(spark, tmp_path):
    """A task that runs again leaves no second copy, and no rows are an empty table."""
    pages = spark.createDataFrame([("b.html", "1"), ("a.html", "2"), ("a.html", "0")], "name string, value string")
    for _ in range(2):
        tables.write_pages(pages, str(tmp_path / "out"), "name", "value")
    assert sorted((r.path.rpartition("/")[2], r.value) for r in tables.read_pages(spark, str(tmp_path / "out")).collect()) == [("000000000-a.html", "0"), ("000000001-a.html", "2"), ("000000002-b.html", "1")]
    tables.write_pages(pages.limit(0), str(tmp_path / "none"), "name", "value")
    with pytest.raises(ValueError, match="no pages found"):
        tables.required(tables.read_pages(spark, str(tmp_path / "none")), "pages")
