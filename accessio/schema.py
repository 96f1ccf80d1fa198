"""Column lists of the linkage tables, and the operator that makes a frame fit one.

Every column is a string and a missing value is the empty string, never null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The tables' formats.
MASTER = (
    "ncppb_number", "ncppb_number_compact", "current_name", "name_as_received", "alternative_names", "pathovar",
    "host", "country", "other_collection_numbers", "ncppb_catalogue_url", "catalogue_sequence_links", "sequencing_type",
    "year_added", "type_strain_of_species", "pathotype_strain", "other_references", "notes", "raw_record_text",
)
SEARCH_TERMS = ("ncppb_number", "term_type", "search_term")
TERM_RESULTS = ("ncppb_number", "term_type", "search_term", "ncbi_db", "id_count_returned", "ids", "status", "error")
REFERENCES = ("ncppb_number", "other_references")
IDENTIFIERS = (
    "ncppb_number", "other_references", "matched_text", "normalized_identifier", "prefix", "suffix",
    "rule_name", "confidence", "include_for_search", "biosample_query", "context",
)
RAW_ROWS = (
    "ncppb_number", "query_source", "normalized_identifier", "prefix", "suffix", "search_term", "ncbi_db", "ncbi_uid",
    "ncbi_accession", "source_url", "title", "organism", "taxid", "identifiers", "infraspecies", "attributes",
    "metadata_text", "id_count_returned", "status", "error",
)
EVIDENCE = (
    "ncppb_number", "ncbi_db", "ncbi_uid", "ncbi_accession", "source_url", "title", "organism", "taxid",
    "evidence_level", "evidence_decision", "evidence_class", "evidence_score", "matched_identifier",
    "matched_identifier_type", "identifier_rule_name", "identifier_confidence", "reject_reason", "query_source",
    "search_term", "metadata_text", "status", "error",
)


def strings(columns: tuple[str, ...]) -> StructType:
    return StructType([StructField(c, StringType(), False) for c in columns])


def conform(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Exactly these columns, in order, as strings; absent ones and nulls are empty."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in columns])
