"""Search terms of the master table: up to seven kinds a row, as one array that is exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessio.functions import text as T
from accessio.operators.relational import distinct_in_order, of_first_keys, with_values

#: Fixed value: the collection's name in full.
COLLECTION = "National Collection of Plant Pathogenic Bacteria"
#: Databases that terms are looked up in, in order.
DATABASES = ("biosample", "assembly", "sra", "taxonomy")


def _both(a: Column, b: Column) -> Column:
    return F.concat(F.lit('"'), a, F.lit('" "'), b, F.lit('"'))


def _term(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("term_type"), T.clean(value).alias("search_term"))


def search_terms(rows: DataFrame, order: str) -> DataFrame:
    """ncppb_number, term_type, search_term, in the order of rows and kinds; distinct; an empty table keeps its columns."""
    n, small, now, old = (F.trim(T.text(c)) for c in ("ncppb_number", "ncppb_number_compact", "current_name", "name_as_received"))
    none = F.lit(None).cast("string")

    def given(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise(none)

    single = F.array(
        _term("ncppb_number", n),
        _term("ncppb_number_compact", small),
        _term("collection_name_plus_number", given(n != "", F.concat(F.lit(f'"{COLLECTION}" '), T.all_digits(n)))),
        _term("current_name_plus_number", given((now != "") & (n != ""), _both(now, n))),
        _term("received_name_plus_number", given((old != "") & (n != "") & (old != now), _both(old, n))),
    )
    others = F.transform(T.split_multi("alternative_names"), lambda a: _term("alternative_name_plus_number", given(n != "", _both(a, n))))
    numbers = F.transform(T.split_multi("other_collection_numbers"), lambda a: _term("other_collection_number", a))
    every = F.filter(F.concat(single, others, numbers), lambda t: t["search_term"] != "")
    found = rows.select(n.alias("__number"), F.col(order).alias("__row"), F.posexplode(every).alias("__place", "__term"))
    found = found.select(F.col("__number").alias("ncppb_number"), "__term.term_type", "__term.search_term", F.struct("__row", "__place").alias("__ord"))
    return distinct_in_order(found, "__ord").orderBy("__ord").drop("__ord")


def term_lookups(terms: DataFrame, order: str, first: int = 10, databases: tuple[str, ...] = DATABASES) -> DataFrame:
    """The terms of the first strains (0: all), once for each database."""
    return with_values(of_first_keys(terms, "ncppb_number", first, order), "ncbi_db", databases)
