"""One delimited file with line breaks inside quotes, read by many tasks.

Whether a line begins inside a quoted cell depends on the quotes before it: on
their parity alone, as every quote of a cell stands at its ends or is doubled. So a
first pass counts each chunk's quotes, a running sum over the chunks tells how each one
begins, and a second pass cuts the chunks into records side by side. Only records
that go over a chunk's end are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accessio.sources.tables import CSV, NA_TOKENS, delimiter


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its chunk begins), value, quotes: physical lines, in order within a chunk."""
    lines = spark.read.text(path, lineSep="\n")
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", quotes.cast("int").alias("quotes"))


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """Pieces of one chunk each."""
    for frame in frames:
        if len(frame):
            change = (frame["block"].ne(frame["block"].shift()) | frame["file"].ne(frame["file"].shift())).to_numpy()
            starts = np.flatnonzero(change)
            for i, j in zip(starts, [*starts[1:], len(frame)], strict=True):
                yield (frame["file"].iat[i], int(frame["block"].iat[i])), frame.iloc[i:j]


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """file, block, odd (quotes), begun0, begun1 (lines that begin outside quotes if the chunk begins outside, or inside), crlf (the file's first line ends so)."""
    totals: dict[tuple[str, int], list[int]] = {}
    for chunk, piece in _runs(frames):
        if chunk not in totals:
            totals[chunk] = [0, 0, 0, int(chunk[1] == 0 and piece["value"].iat[0].endswith("\r"))]
        seen = totals[chunk]
        before = (np.cumsum(piece["quotes"]) - piece["quotes"]).to_numpy() + seen[0] & 1
        seen[1] += int((before == 0).sum())
        seen[2] += int(before.sum())
        seen[0] = seen[0] + int(piece["quotes"].sum()) & 1
    yield pd.DataFrame([(*chunk, *seen) for chunk, seen in totals.items()], columns=["file", "block", "odd", "begun0", "begun1", "crlf"])


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """file, block, at (of the chunk's records), part (the chunk of this piece), whole, record."""
    columns = ["file", "block", "at", "part", "whole", "crlf", "record"]
    chunk, held, at, inside, carried, crlf = None, [], -1, 0, -1, 0

    def ended() -> list[tuple]:
        """The last record of a chunk; whole if the chunk ends outside quotes and the record began in it."""
        if chunk is None or not held:
            return []
        text = "\n".join(held)
        return [(chunk[0], chunk[1], at, chunk[1], inside == 0, crlf, text)] if at >= 0 else [(chunk[0], carried, None, chunk[1], False, crlf, text)]

    for key, piece in _runs(frames):
        rows = []
        if key != chunk:
            rows += ended()
            chunk, held, at = key, [], -1
            inside, carried, crlf = (int(piece[c].iat[0]) for c in ("inside", "carried", "crlf"))
        lines = piece["value"].tolist()
        after = (np.cumsum(piece["quotes"].to_numpy()) + inside) & 1
        before = np.r_[inside, after[:-1]]
        starts = np.flatnonzero(before == 0)
        first = int(starts[0]) if len(starts) else len(lines)
        held += lines[:first]
        for i, j in zip(starts, [*starts[1:], len(lines)], strict=False):
            if at >= 0:
                rows.append((key[0], key[1], at, key[1], True, crlf, "\n".join(held)))
            elif held:  # what the chunk before left open ends here
                rows.append((key[0], carried, None, key[1], False, crlf, "\n".join(held)))
            at, held = at + 1, lines[i:j]
        inside = int(after[-1])
        if rows:
            yield pd.DataFrame(rows, columns=columns)
    if rows := ended():
        yield pd.DataFrame(rows, columns=columns)


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at, record: the records of all files as texts, header and empty ones among them; (block, at) is their order in a file.

    In a file whose lines end in CRLF, line breaks inside cells become LF, as read_table has them.
    """
    lines = _lines(spark, path)
    counted = lines.mapInPandas(_counted, "file string, block long, odd int, begun0 long, begun1 long, crlf int")
    chunks = counted.groupBy("file", "block").agg(*[F.sum(c).alias(c) for c in ("odd", "begun0", "begun1", "crlf")])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
    begins = chunks.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).withColumn("begun", F.when(F.col("inside") == 0, F.col("begun0")).otherwise(F.col("begun1")))
    begins = begins.withColumn("carried", F.coalesce(F.last(F.when(F.col("begun") > 0, F.col("block")), True).over(earlier), F.lit(-1)))
    begins = begins.withColumn("crlf", F.max("crlf").over(Window.partitionBy("file")))
    known = lines.join(F.broadcast(begins.select("file", "block", "inside", "carried", "crlf")), ["file", "block"])
    pieces = known.mapInPandas(_cut, "file string, block long, at long, part long, whole boolean, crlf int, record string")
    open_ = pieces.where("NOT whole").groupBy("file", "block").agg(F.max("at").alias("at"), F.max("crlf").alias("crlf"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda x: x["record"]), "\n").alias("record"))
    every = pieces.where("whole").select("file", "block", "at", "crlf", "record").unionByName(open_.select("file", "block", "at", "crlf", "record"))
    bare = F.regexp_replace("record", r"\r$", "")
    return every.select("file", "block", "at", F.when(F.col("crlf") == 1, F.replace(bare, F.lit("\r\n"), F.lit("\n"))).otherwise(bare).alias("record"))


def read_split_table(spark: SparkSession, path: str, na_tokens: bool = False, ordinal: str | None = None) -> DataFrame:
    """read_table for large files: the same rows, but a file is read by as many tasks as it has chunks of spark.sql.files.maxPartitionBytes.

    The file is read twice. Quotes must stand around cells or be doubled in them, as
    write_table and csv modules write them; a quote inside a bare cell is for
    read_table. The chunks' counts are broadcast: a row a chunk.
    """
    sep = delimiter(path)
    names = spark.read.options(**CSV, sep=sep).csv(path).columns
    first = (F.col("block") == 0) & (F.col("at") == 0)
    rows = split_records(spark, path).where(~first).where("record != ''")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = rows.select(F.from_csv("record", schema, {**{k: str(v) for k, v in CSV.items() if k != "header"}, "sep": sep}).alias("r"), F.struct("file", F.struct("block", "at").alias("place")).alias("ord"))

    def cell(i: int) -> Column:
        c = F.col(f"r.c{i}")
        return F.when(c.isin(*NA_TOKENS), "").otherwise(F.coalesce(c, F.lit(""))) if na_tokens else F.coalesce(c, F.lit(""))

    return parsed.select(*[cell(i).alias(name) for i, name in enumerate(names)], *([F.col("ord").alias(ordinal)] if ordinal else []))
