"""What the corpus operators share: reading tables, cutting lineage, carrying columns.

Rules that hold for every operator of this folder:

* a null text counts as an empty text unless the operator says otherwise;
* operators that add columns to rows carry all input columns but those whose name
  (ignoring case) is one of their outputs, which the output replaces; names used
  inside never clash with them. Operators that return a table of their own
  (overlaps, near_duplicates, score_documents, media_column, mix) return the id and
  their outputs alone;
* repeated rows are kept and each gets its own result row;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the folder of spark.checkpoint.dir.

    Only a local session without that setting (tests on one machine) gets a
    temporary folder; elsewhere executors would not see each other's files, so
    that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "accessio-checkpoints"))
    return df.checkpoint()


def forget(df: DataFrame) -> None:
    """Deletes the files of a settled frame that nothing reads any more."""
    where = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if where.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str, fixed: bool) -> DataFrame:
    """df with a number for each row, the same whenever it is read.

    fixed: df is a table as its files hold it (or a projection or filter of it),
    or settled, so its partitions and their order never change; any other frame is
    settled first, as a shuffle may deal its rows otherwise the next time.
    """
    return (df if fixed else settled(df)).withColumn(name, F.monotonically_increasing_id())


#: Row numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def by_row(rows: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """rows joined with a settled frame by `row`, which is broadcast if it has no more than BROADCAST_ROWS."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few.hint("merge"), "row", how)


#: Parts that a key is cut into where its size isn't known.
SALTS = 16


def with_key(rows: DataFrame, few: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """rows joined with few (settled, one row a key): broadcast up to BROADCAST_ROWS, else by a shuffle in which spread cuts each key's rows into SALTS parts."""
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), keys, how)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*keys, "salt"], how).drop("salt")


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns named in0, in1 .., so that names used inside an operator can't clash with them, and the new name of each (found in any case)."""
    new = [f"in{i}" for i in range(len(df.columns))]
    return df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, new, strict=True)]), _AnyCase(zip(map(str.lower, df.columns), new, strict=True))


class _AnyCase(dict):
    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())


def carried(df: DataFrame, outputs: tuple[str, ...] | list[str]) -> list[str]:
    """Names of the columns that an operator with these outputs passes on."""
    taken = {c.lower() for c in outputs}
    return [c for c in df.columns if c.lower() not in taken]


def text_of(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def literal_longs(values: list[int]) -> Column:
    """An array literal; written as SQL text, which stays quick for thousands of values."""
    return F.expr("array(" + ",".join(f"{v}L" if v > -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows from now on, so that long texts don't pile up in a Python worker.

    This lowers a setting of the whole session, as Spark reads it when a query runs;
    results don't depend on it. A session that has fewer rows already keeps its own.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
