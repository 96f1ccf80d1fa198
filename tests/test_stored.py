"""Places over a whole table, a stored table that takes increments, firsts of a stream: against the batch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from accessio.operators import relational
from accessio.operators.stored import UpsertTable
from accessio.streaming.first import current, first_wins_stream


def test_places(spark):
    r = random.Random(1)
    names = [f"NCPPB {r.randrange(400)}" if r.random() < 0.9 else f"loan {r.choice('abc')}" for _ in range(900)]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "k string, i int").repartition(7)
    got = {x.i: x.place for x in relational.with_places(rows, [relational.numeric_order("k"), "i"]).collect()}
    by = lambda i: (names[i].startswith("loan"), int(names[i][6:]) if names[i][0] == "N" else 0, i)
    assert got == {i: place for place, i in enumerate(sorted(range(900), key=by))}
    assert relational.with_places(rows.limit(0), ["k"]).count() == 0
    plan = relational.with_places(rows, ["k", "i"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "Window [k" not in plan and "rangepartitioning" not in plan  # the numbering itself sorts no rows


# Increments ----------------------------------------------------------------------------------------


def increments(n, seed):
    r = random.Random(seed)
    return [[(f"k{r.randrange(60)}", r.randrange(5), n * 1000 - r.randrange(10**6), f"v{r.random()}") for _ in range(r.randrange(1, 60))] for n in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, level int, at long, v string")


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_increments_equal_one_batch(spark, tmp_path):
    parts = increments(6, 3)
    stored = UpsertTable(spark, str(tmp_path / "t"), ["k"], "at", buckets=8)
    seen = []
    for rows in parts:
        stored.merge(frame(spark, rows).repartition(3), F.col("level"))
        seen += rows
        want = relational.upsert_by_rank(frame(spark, seen), ["k"], F.col("level"), "at")
        assert sorted(map(tuple, stored.rows().select("k", "level", "at", "v").collect())) == sorted(map(tuple, want.select("k", "level", "at", "v").collect()))
    before = sorted(map(tuple, stored.rows().collect()))
    stored.forget_old()
    assert sorted(map(tuple, stored.rows().collect())) == before and len(stored._folders("increment=*/bucket=*")) == len(stored.versions())


def test_untouched_buckets_are_not_rewritten(spark, tmp_path):
    stored = UpsertTable(spark, str(tmp_path / "t"), ["k"], "at", buckets=8)
    stored.merge(frame(spark, [(f"k{i}", 1, i, "a") for i in range(50)]), F.col("level"))
    old, versions = files(tmp_path), stored.versions()
    stored.merge(frame(spark, [("k7", 2, 7, "b")]), F.col("level"))
    assert {f: t for f, t in files(tmp_path).items() if f in old} == old
    now = stored.versions()
    assert [b for b in now if now[b] != versions[b]] == [b for b in now if now[b] == 2] and len([b for b in now if now[b] == 2]) == 1
    assert stored.rows().count() == 50 and stored.rows().where("k = 'k7'").first().v == "b"
    stored.merge(frame(spark, []), F.col("level"))  # an empty increment writes nothing
    assert files(tmp_path).keys() >= old.keys() and max(stored._increments()) == 2


def test_broken_write_leaves_the_table(spark, tmp_path):
    stored = UpsertTable(spark, str(tmp_path / "t"), ["k"], "at", buckets=4)
    with pytest.raises(ValueError, match="nothing has been merged"):
        stored.rows()
    stored.merge(frame(spark, [("a", 1, 1, "x")]), F.col("level"))
    fails = F.when(F.col("v") == "y", F.raise_error(F.lit("broken"))).otherwise(F.col("level"))
    with pytest.raises(Exception, match="broken"):
        stored.merge(frame(spark, [("a", 2, 2, "y"), ("b", 1, 1, "z")]), fails.cast("int"))
    left = tmp_path / "t" / "increment=2" / "bucket=0"  # what a killed run may leave
    left.mkdir(parents=True, exist_ok=True)
    (left / "part-0.parquet").write_bytes(b"half")
    assert [tuple(x) for x in stored.rows().select("k", "v").collect()] == [("a", "x")]
    stored.merge(frame(spark, [("a", 2, 2, "w")]), F.col("level"))
    assert [tuple(x) for x in stored.rows().select("k", "v", "at").collect()] == [("a", "w", 1)] and max(stored._increments()) == 3


# Firsts of a stream --------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(f"k{r.randrange(30)}", r.randrange(2) if r.random() < 0.9 else None, at, r.random(), None if at % 5 else f'"ü\n{at}') for at in r.sample(range(-500, 500), 300)]
    whole = spark.createDataFrame(rows, "k string, kind int, at long, x double, note string")
    folder, keys = str(tmp_path / "in"), ["k", "kind"]
    out = str(tmp_path / "out")

    def kept(changes, number):
        changes.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run():
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = first_wins_stream(stream, keys, "at").writeStream.outputMode("update").foreachBatch(kept).option("checkpointLocation", str(tmp_path / "checkpoint"))
        query.trigger(availableNow=True).start().awaitTermination(300)

    for part in range(4):
        spark.createDataFrame(rows[part * 75 : part * 75 + 75], whole.schema).coalesce(1).write.mode("append").parquet(folder)
        if part in (1, 3):  # the second run starts from the first's checkpoint
            run()
    changes = spark.read.parquet(out)
    got = sorted(map(tuple, current(changes.drop("batch"), keys).select(*whole.columns).collect()), key=str)
    assert got == sorted(map(tuple, relational.first_wins(whole, keys, ["at"]).collect()), key=str)
    assert changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("revision").alias("last")).where("n != last + 1").count() == 0
    assert changes.agg(F.max("revision")).first()[0] > 0  # some were corrected
    assert len(os.listdir(out)) == 4


def test_keys_of_a_group_share_a_call():
    """Many keys, one read and one write of the state; an unchanged group isn't written."""
    from pyspark.sql import Row

    from accessio.streaming.first import _First

    class State:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    first = _First("long")
    first.state = State()
    rows = lambda *xs: iter([Row(key=k, at=at, payload=f"{k}{at}") for k, at in xs])
    tell = lambda *xs: [(r.payload, r.revision) for r in first.handleInputRows((0,), rows(*xs), None)]
    assert tell(("a", 5), ("b", 7), ("a", 3), ("c", 1)) == [("a3", 0), ("b7", 0), ("c1", 0)]
    assert tell(("a", 4), ("b", 6), ("d", 2)) == [("b6", 1), ("d2", 0)]
    assert tell(("a", 9)) == []
    assert State.calls == ["get", "update", "get", "update", "get"]
