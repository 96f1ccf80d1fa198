"""First of each key over a stream whose rows come in any order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from accessio.operators.relational import first_wins

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are dealt to so many groups. A call of the state store costs more than a key, so a group's keys are one value of the state.
GROUPS = 4096


class _First(StatefulProcessor):
    """Keeps the order of each key's first row and how often that has changed; tells of every change."""

    def __init__(self, order_type: str):
        self.order_type = order_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("first", f"keys array<string>, ats array<{self.order_type}>, revisions array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first: dict[str, tuple[Any, str]] = {}
        for r in rows:
            if r["key"] not in first or r["at"] < first[r["key"]][0]:
                first[r["key"]] = r["at"], r["payload"]
        held = self.state.get()
        known = {k: (at, n) for k, at, n in zip(*held, strict=True)} if held is not None else {}
        changed = {k: (at, known[k][1] + 1 if k in known else 0) for k, (at, _) in first.items() if k not in known or at < known[k][0]}
        if changed:
            known |= changed
            self.state.update((list(known), [at for at, _ in known.values()], [n for _, n in known.values()]))
        for k, (_, revision) in changed.items():
            yield Row(payload=first[k][1], revision=revision)

    def close(self) -> None:
        pass


def first_wins_stream(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Changes of first_wins(rows, keys, [order]): a key's row when it is first seen, and again whenever an earlier one turns up; `revision` counts.

    The state holds a key's order and revision alone, in RocksDB, which this sets for the
    session; a batch reads and writes the groups of its keys whole. order: a number without nulls, distinct within a key. Start it in
    update mode; a restart goes on from its checkpoint. Rows are sent as
    JSON, which keeps the values of strings, numbers, dates and structs of them.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = rows.schema[order].dataType.simpleString()
    packed = rows.select(F.to_json(F.struct(*[F.col(k) for k in keys]), {"ignoreNullFields": "false"}).alias("key"), F.col(order).alias("at"), F.to_json(F.struct("*")).alias("payload"))
    packed = packed.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(GROUPS)))
    changes = packed.groupBy("group").transformWithState(_First(kind), "payload string, revision long", "update", "none")
    return changes.select(F.from_json("payload", rows.schema).alias("row"), "revision").select("row.*", "revision")


def current(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that stand after all changes: of each key the last revision."""
    return first_wins(changes, keys, [-F.col("revision")]).drop("revision")
