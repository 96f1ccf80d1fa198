"""Order-aware relational operators. Order is a column, never the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accessio.sources.tables import scratch


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Of each key the row that comes first; ends of partial sums, so hot keys cost no more than others."""
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), rank) if rest else F.lit(None)
    return df.groupBy(*keys).agg(first.alias("__row")).select(*[(F.col(c) if c in keys else F.col(f"__row.{c}").alias(c)) for c in df.columns])


def distinct_in_order(df: DataFrame, order: str) -> DataFrame:
    """Distinct rows apart from the order column, which keeps the place of each one's first."""
    return df.groupBy(*[c for c in df.columns if c != order]).agg(F.min(order).alias(order)).select(*df.columns)


def upsert_by_rank(df: DataFrame, keys: list[str], rank: Column, order: str) -> DataFrame:
    """Of each key the row of highest rank (a number), of those the first; order is that of the key's first row."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(-rank, order))
    return df.groupBy(*keys).agg(best.alias("__row"), F.min(order).alias(order)).select(*[(F.col(c) if c in (*keys, order) else F.col(f"__row.{c}").alias(c)) for c in df.columns])


def first_keys(df: DataFrame, key: str, n: int, order: str, skip_blank: bool = False) -> DataFrame:
    """The first n distinct values of key in order of first appearance; 0 means all."""
    rows = df.where(F.col(key) != "") if skip_blank else df
    found = rows.groupBy(key).agg(F.min(order).alias("__first"))
    return (found.orderBy("__first").limit(n) if n > 0 else found).select(key)


def of_first_keys(df: DataFrame, key: str, n: int, order: str, skip_blank: bool = False) -> DataFrame:
    """The rows of the first n values of key."""
    return df.join(first_keys(df, key, n, order, skip_blank), key, "left_semi") if n > 0 else df


def numeric_order(key: str, downwards: bool = False) -> Column:
    """Sort key: the first run of digits as a number, rows without digits last."""
    number = F.regexp_extract(key, r"(\d+)", 1).try_cast("double")
    return number.desc_nulls_last() if downwards else number.asc_nulls_last()


def with_values(df: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    """Every row once for each value, without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by key into tasks of about so many rows.

    A table of short rows is a small file, which one task or a few read, whatever
    the rows become behind it: what is made of a row, and a task's sorts, grow with the table.
    """
    return df.repartition(max(1, -(-df.count() // rows)), key)


def with_places(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """df with each row's place, 0, 1, 2 .., in the given order; rows equal in it are placed in any order.

    The rows are sorted by ranges and written once, under spark.checkpoint.dir; a
    row's place is its place in its range and the earlier ranges' rows, of which
    there is one count a range. No task sees more than a range.
    """
    spark, path = df.sparkSession, f"{scratch(df.sparkSession, 'places')}/rows"
    ranged = df.orderBy(*order).withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ranged.write.parquet(path)
    placed = spark.read.parquet(path)
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__range").select(*df.columns, (F.col("__before") + F.col("__at")).alias(name))
