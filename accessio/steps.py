"""The linkage steps from file to file, each one Spark job or two; python -m accessio runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accessio.operators import catalogue, evidence, identifiers, relational, terms
from accessio.schema import EVIDENCE, IDENTIFIERS, MASTER, RAW_ROWS, REFERENCES, SEARCH_TERMS, TERM_RESULTS
from accessio.sources import lookup, paged, tables
from accessio.sources.split import read_split_table

ORDER = "__order"


def _read(spark: SparkSession, path: str, na_tokens: bool = False, what: str = "rows", large: bool = False) -> DataFrame:
    """A table with its rows' order; large ones are read in chunks. A table without rows is an error."""
    return tables.required((read_split_table if large else tables.read_table)(spark, path, na_tokens, ORDER), f"{what} in {path}")


def _write(df: DataFrame, path: str, columns: tuple[str, ...], **counts) -> dict[str, int]:
    """Writes the table and gives the counts that were observed on the way."""
    rows, seen = tables.observed(df, f"rows of {path}", **counts)
    tables.write_table(rows, path, columns)
    return seen.get


def records(spark: SparkSession, input: str, output: str) -> dict[str, int]:
    """The catalogue of saved pages."""
    return _write(tables.required(catalogue.page_records(tables.read_pages(spark, input)), f"records in {input}"), output, MASTER)


def master(spark: SparkSession, input: str, output: str) -> dict[str, int]:
    """The cleaned master table of a catalogue table."""
    return _write(catalogue.master(_read(spark, input, True, "records"), ORDER), output, MASTER)


def search_terms(spark: SparkSession, input: str, output: str) -> dict[str, int]:
    """The search terms of the master table."""
    return _write(terms.search_terms(_read(spark, input, True, "strains"), ORDER), output, SEARCH_TERMS)


def _service(email: str, api_key: str, delay: float, timeout: float, answers: str) -> Callable[[], lookup.Service]:
    """answers: a folder of recorded answers that stands in for the network."""
    return lambda: lookup.Service(email, api_key, delay=delay, timeout=timeout, **({"opener": paged.Recorded(answers)} if answers else {}))


def lookups(spark: SparkSession, input: str, output: str, limit_strains: int = 10, retmax: int = 5, email: str = "", api_key: str = "", delay: float = lookup.DELAY, timeout: float = lookup.TIMEOUT, tasks: int = 1, answers: str = "") -> dict[str, int]:
    """The ids that every database has for the terms of the first strains."""
    asked = terms.term_lookups(_read(spark, input, True, "terms"), ORDER, limit_strains)
    found = lookup.HttpLookup(_service(email, api_key, delay, timeout, answers), tasks=tasks)
    return _write(found.terms(asked, retmax), output, TERM_RESULTS, with_ids=F.col("id_count_returned") > 0, errors=F.col("status") == "error") | {"requests": found.requests}


def references(spark: SparkSession, input: str, output: str) -> dict[str, int]:
    """Number and other references of each record of saved pages."""
    return _write(tables.required(catalogue.page_references(tables.read_pages(spark, input)), f"references in {input}"), output, REFERENCES, filled=F.col("other_references") != "")


def identifier_table(spark: SparkSession, input: str, output: str, drop_empty_rows: bool = False, large: bool = False) -> dict[str, int]:
    """The identifier candidates of reference texts."""
    found = identifiers.extract_identifiers(_read(spark, input, what="references", large=large), keep_empty=not drop_empty_rows, carry=(ORDER,))
    included, empty = F.col("include_for_search") == "yes", F.col("rule_name") == "no_identifier_found"
    return _write(found.orderBy(ORDER, "place"), output, IDENTIFIERS, included=included, rejected=~included & ~empty, empty=empty)


def harvest(
    spark: SparkSession, input: str, output: str, log: str = "", email: str = "", api_key: str = "", delay: float = lookup.DELAY, timeout: float = lookup.TIMEOUT, retmax: int = lookup.PAGE, max_ids_per_query: int = lookup.MOST_IDS,
    summary_batch_size: int = lookup.BATCH, limit_strains: int = 0, no_ncppb_number: bool = False, attempts: int = 5, wait: float = 60.0, tasks: int = 1, answers: str = "",
) -> dict[str, int]:
    """The records that a query for each identifier finds. The log (else beside the output) keeps attempts, so a run that is started again goes on."""
    given = relational.of_first_keys(_read(spark, input, what="identifiers"), "ncppb_number", limit_strains, ORDER, skip_blank=True)
    found = lookup.HttpLookup(_service(email, api_key, delay, timeout, answers), page=retmax, most=max_ids_per_query, batch=summary_batch_size, tasks=tasks)
    rows = found.harvest(lookup.query_specs(given, ORDER, not no_ncppb_number), log or f"{output.rstrip('/')}.attempts", attempts=attempts, wait=wait)
    counts = {status: F.col("status") == status for status in ("ok", "no_hit", "error")}
    return _write(rows.orderBy("ncppb_number", "query_source", "search_term", "ncbi_uid"), output, RAW_ROWS, **counts) | {"requests": found.requests}


def classify(spark: SparkSession, raw_input: str, identifiers: str, matches_output: str, review_output: str, no_ncppb_number: bool = False, large: bool = False) -> dict[str, int]:
    """Accepted rows in one table, all others in another."""
    index = evidence.pattern_index(_read(spark, identifiers, what="identifiers"), ORDER, not no_ncppb_number)
    judged = evidence.classify_indexed(_read(spark, raw_input, what="records", large=large), index, carry=(ORDER,)).orderBy(ORDER)
    decided = {d: F.col("evidence_decision") == d for d in ("accept", "review", "reject", "no_data")}
    rows, seen = tables.observed(judged, "evidence", **decided)
    tables.split_sink(rows, decided["accept"], matches_output, review_output, EVIDENCE)
    return seen.get


#: Steps by the name that the command line knows them by, in the order of a whole run.
STEPS = {
    "records": records, "master": master, "terms": search_terms, "lookups": lookups,
    "references": references, "identifiers": identifier_table, "harvest": harvest, "classify": classify,
}
