"""Audit tallies over identifier and evidence tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filled_counts(df: DataFrame) -> DataFrame:
    """One row: for each column how many rows have a value."""
    return df.agg(*[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in df.columns])


def rollup_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Rows by outer and inner, with subtotals (inner null) and the total (both null); level: 0, 1, 3."""
    return df.rollup(outer, inner).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def identifier_summary(identifiers: DataFrame) -> DataFrame:
    """One row: rows, included, rejected (neither included nor empty), empty, and distinct included identifiers."""
    yes, none = F.col("include_for_search") == "yes", F.col("rule_name") == "no_identifier_found"
    return identifiers.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(yes).alias("n_included"),
        F.count_if(~yes & ~none).alias("n_rejected"),
        F.count_if(none).alias("n_empty"),
        F.count_distinct(F.when(yes, F.struct("ncppb_number", "normalized_identifier"))).alias("n_distinct"),
    )


def lookup_summary(results: DataFrame) -> DataFrame:
    """By database: lookups, lookups with ids, errors, ids."""
    return results.groupBy("ncbi_db").agg(
        F.count(F.lit(1)).alias("n_lookups"),
        F.count_if(F.col("id_count_returned").cast("int") > 0).alias("n_with_ids"),
        F.count_if(F.col("status") == "error").alias("n_errors"),
        F.sum(F.col("id_count_returned").try_cast("long")).alias("n_ids"),
    )
