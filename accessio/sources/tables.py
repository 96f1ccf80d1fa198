"""Table sources and sinks: whole pages, CSV and TSV files in two dialects of missing values."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accessio.schema import conform

#: Cells that a data-frame CSV reader takes for missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files of a query's own, under spark.checkpoint.dir, which all executors share; only a local session may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="accessio-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delimiter(path: str) -> str:
    """Tab for names in .tsv (any case), else comma."""
    return "\t" if str(path).lower().endswith(".tsv") else ","


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, value: one row a file; bytes that are no UTF-8 become U+FFFD."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("value"))


def write_pages(df: DataFrame, path: str, name: str, value: str, tasks: int = 1) -> None:
    """Saves each row's value (string or binary) as a file of its own, for read_pages: path/task=../..-name.
    Spark's reader passes over files with nothing in them (null or empty).

    Spark's text writer needs a folder a page for that, and on local folders starts
    three processes for each (chmod of folder, file and checksum); here a task
    writes its pages into one folder. A page has the same name whenever a task is
    run again, and is moved there when it is whole. Names are file names; rows of
    one name get a file each.
    """
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    root = whole.removeprefix("file:") if whole.startswith("file:/") else whole

    def save(rows: Iterator) -> None:
        files, top = FileSystem.from_uri(root)
        context = TaskContext.get()
        folder = posixpath.join(top, f"task={context.partitionId()}")
        files.create_dir(folder)
        for at, row in enumerate(rows):
            unready = posixpath.join(folder, f".{at}-{context.taskAttemptId()}")  # readers pass over names with a dot
            with files.open_output_stream(unready) as out:
                out.write(bytes(row[1] or b""))
            files.move(unready, posixpath.join(folder, f"{at:09d}-{row[0]}"))

    files, top = FileSystem.from_uri(root)
    files.create_dir(top)  # there without rows, too
    pages = df.select(F.col(name).cast("string").alias("name"), F.col(value).cast("binary").alias("value"))
    pages.repartition(tasks, "name").sortWithinPartitions("name", "value").foreachPartition(save)


def read_table(spark: SparkSession, path: str, na_tokens: bool = False, ordinal: str | None = None) -> DataFrame:
    """A delimited file, all strings, missing cells empty. na_tokens: NA, None, null and the like are missing too.

    ordinal names a column for the rows' order: a struct of the file's path and the
    place in it, so files count in the order of their names, whatever their sizes.
    Any order parameter of this library takes it. A file with line breaks inside
    quotes is read by one task; for a large one see split.read_split_table.
    """
    df = spark.read.options(**CSV, sep=delimiter(path)).csv(path)

    def cell(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.when(c.isin(*NA_TOKENS), "").otherwise(F.coalesce(c, F.lit(""))) if na_tokens else F.coalesce(c, F.lit(""))

    out = df.select(*[cell(c).alias(c) for c in df.columns])
    if not ordinal:
        return out
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
    return df.select(*[cell(c).alias(c) for c in df.columns], place.alias(ordinal))


def write_table(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, crlf: bool = False) -> None:
    """A folder of delimited files: given columns only, quotes doubled, empty cells bare."""
    rows = conform(df, columns) if columns else df
    options = {"header": True, "sep": delimiter(path), "quote": '"', "escape": '"', "emptyValue": ""}
    if crlf:
        options["lineSep"] = "\r\n"
    rows.write.mode("overwrite").options(**options).csv(path)


def required(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no rows."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def split_sink(df: DataFrame, accept: Column, accepted: str, rest: str, columns: tuple[str, ...] | None = None) -> None:
    """Rows that satisfy accept to one table, all others (nulls too) to another; df is computed once."""
    kept = df.withColumn("__accept", F.coalesce(accept, F.lit(False))).persist()
    try:
        write_table(kept.where("__accept").drop("__accept"), accepted, columns)
        write_table(kept.where("NOT __accept").drop("__accept"), rest, columns)
    finally:
        kept.unpersist()


def observed(df: DataFrame, name: str, **counts: Column):
    """df and an observation of row counts that its next action fills; no second job."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()]), seen
