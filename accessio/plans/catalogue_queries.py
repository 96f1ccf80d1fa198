"""Queries of the linkage operators on the driver's tables, each with the SQL of its result.

The tables hold no catalogue texts, so two views are derived from columns alone:
`refs` (a reference text for each part) and `raw` (a looked-up record for each
order). Both sides of a comparison build them by the same concatenation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accessio.functions import html as H
from accessio.functions import text as T
from accessio.operators import catalogue, evidence, identifiers, relational, report, terms
from accessio.operators.stored import UpsertTable
from accessio.schema import EVIDENCE, MASTER, RAW_ROWS
from accessio.sources import lookup, paged, tables
from accessio.sources.split import read_split_table
from accessio.sources.tables import scratch
from accessio.streaming.first import current, first_wins_stream

QUERIES: dict = {}
ORACLES: dict = {}

REFS = """SELECT 'NCPPB ' || p_partkey AS ncppb_number, p_partkey, p_size,
  'This isolate is also in the collections; ICMP ' || p_partkey || ', LMG-' || p_size || ' The source of this isolate was ex A.C. Brown B' || p_size AS other_references
FROM part"""
RAW = """SELECT o_orderkey, o_custkey, 'NCPPB ' || (o_orderkey % 300) AS ncppb_number, CAST(o_orderkey AS VARCHAR(20)) AS ncbi_uid,
  CASE WHEN o_orderkey % 17 = 0 THEN 'no_hit' WHEN o_orderkey % 19 = 0 THEN 'error' ELSE 'ok' END AS status,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Pseudomonas syringae' ELSE 'Xanthomonas citri' END AS organism,
  CASE o_orderkey % 4 WHEN 0 THEN 'strain NCPPB ' || (o_orderkey % 300) WHEN 1 THEN 'culture NCPPB:' || (o_custkey % 300)
    WHEN 2 THEN 'isolate ICMP ' || (o_orderkey % 300) || ' of leaf' ELSE 'LMG-' || (o_custkey % 50) || ' B ' || (o_custkey % 50) END AS metadata_text
FROM orders"""
# The general pattern for engines without lookaround; both sides read _ as :
GENERAL_RE = r"\b(?:[A-Za-z]{1,10}(?:[-/][A-Za-z]{1,10})*)\s*[-:/.]?\s*(?:[0-9][A-Za-z0-9]*(?:[/.-][A-Za-z0-9]+)*)(?:\b|$)"
PARTS_A_TASK, ORDERS_A_TASK, ORDERS_A_FILE, PAGES_A_TASK = 5_000, 25_000, 2_000_000, 1_000
CLEAN_SQL = r"trim(regexp_replace(replace(text, '_', ':'), '\s+', ' ', 'g'))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts for work of a millisecond a row: a million of them are a file of a few megabytes."""
    return relational.spread(_table(spark, sf_dir, "part"), "p_partkey", PARTS_A_TASK)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REFS.replace("FROM part", "FROM {source}"), source=_parts(spark, sf_dir))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW.replace("FROM orders", "FROM {source}"), source=relational.spread(_table(spark, sf_dir, "orders"), "o_orderkey", ORDERS_A_TASK))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier candidates of documents, by rule."""
    docs = _table(spark, sf_dir, "documents")
    found = identifiers.extract_identifiers(docs, "doc_id", "text")
    return found.groupBy("rule_name", "include_for_search").agg(F.count(F.lit(1)).alias("n"))


def _long(c):
    return c.cast("long")


# Scalars and projections ---------------------------------------------------------------------------


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned, CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS BIGINT) AS n FROM documents")
def clean_text(spark, sf_dir):
    """SCL1, SCL11, PRJ3"""
    c = T.clean("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("cleaned"), _long(F.char_length(c)).alias("n"))


@query(r"""SELECT c_custkey, CASE WHEN regexp_matches(c_name, '\d') THEN 'NCPPB ' || regexp_extract(c_name, '\d+') ELSE c_name END AS standard,
  CASE WHEN regexp_matches(c_name, '\d') THEN 'NCPPB' || regexp_extract(c_name, '\d+') ELSE upper(c_name) END AS compact,
  regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, coalesce(nullif(ltrim(regexp_extract(c_name, '\d+'), '0'), ''), '0') AS bare FROM customer""")
def numbers(spark, sf_dir):
    """SCL3-5, SCL8, SCL9, SCL16"""
    s = T.standard_number("c_name")
    return _table(spark, sf_dir, "customer").select("c_custkey", s.alias("standard"), T.compact(s).alias("compact"), T.all_digits("c_name").alias("digits"), T.without_leading_zeros(T.first_digits("c_name")).alias("bare"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS ncppb_number, s_name AS current_name, CAST(s_nationkey AS VARCHAR) AS country, '' AS host FROM supplier")
def alias_map(spark, sf_dir):
    """PRJ1, PRJ2, PRJ5: headers in any case and spacing, by ranked aliases"""
    given = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("NCPPB  No."), F.col("s_name").alias(" Taxon "), F.col("s_nationkey").alias("Country of Origin"))
    return catalogue.map_columns(given).select("ncppb_number", "current_name", "country", "host")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'pv. ' || p_size ELSE p_brand END AS pathovar FROM part")
def conditional_fill(spark, sf_dir):
    """PRJ4, SCL6"""
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_brand")).alias("pathovar"), F.concat(F.lit("Xanthomonas campestris pv. "), "p_size").alias("name"))
    return catalogue.fill_blank(rows, "pathovar", T.pathovar("name")).select("p_partkey", "pathovar")


@query("SELECT p_partkey, 'ICMP ' || p_partkey || '; LMG-' || p_size AS found FROM part")
def collection_numbers(spark, sf_dir):
    """SCL7, AGG10"""
    return refs(spark, sf_dir).select("p_partkey", T.collection_numbers("other_references", "other_references").alias("found"))


@query(r"""SELECT p_partkey, CAST(len(list_filter(string_split(replace(replace(p_name, ' ', ' ; '), 'a', '|'), ';'), lambda x: trim(replace(x, '|', '')) <> '' OR false)) AS BIGINT) AS at_least,
  array_to_string(list_filter(list_transform(string_split(replace(replace(replace(p_name, ' ', ' ; '), 'a', '|'), '|', ';'), ';'), lambda x: trim(x)), lambda x: x <> ''), '/') AS parts FROM part""")
def split_multi(spark, sf_dir):
    """EXP4"""
    cell = F.replace(F.replace("p_name", F.lit(" "), F.lit(" ; ")), F.lit("a"), F.lit("|"))
    some = F.filter(F.split(cell, ";"), lambda x: F.trim(F.replace(x, F.lit("|"), F.lit(""))) != "")
    return _table(spark, sf_dir, "part").select("p_partkey", _long(F.size(some)).alias("at_least"), F.array_join(T.split_multi(cell), "/").alias("parts"))


# Order, distinct, limits ---------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def first_wins_dedupe(spark, sf_dir):
    """AGG1, AGG3, AGG4, WIN1"""
    rows = _table(spark, sf_dir, "lineitem")
    return relational.first_wins(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY user_id, event_type")
def distinct_rows(spark, sf_dir):
    """AGG2, AGG9"""
    return relational.distinct_in_order(_table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("first_id")), "first_id")


@query(r"SELECT c_custkey, c_name FROM customer ORDER BY CAST(regexp_extract(c_name, '(\d+)', 1) AS DOUBLE) DESC NULLS LAST, c_custkey LIMIT 25")
def numeric_key_sort_topk(spark, sf_dir):
    """LIM1, LIM4, SRT1"""
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy(relational.numeric_order("c_name", downwards=True), "c_custkey").limit(25)


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY min(o_orderkey) LIMIT 40) GROUP BY 1")
def first_n_semi_join(spark, sf_dir):
    """JN3, JN4, LIM1, LIM2"""
    return relational.of_first_keys(_table(spark, sf_dir, "orders"), "o_custkey", 40, "o_orderkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, db AS ncbi_db FROM nation CROSS JOIN (VALUES ('biosample'), ('assembly'), ('sra'), ('taxonomy')) AS t(db)")
def cross_join_dbs(spark, sf_dir):
    """JN5"""
    return relational.with_values(_table(spark, sf_dir, "nation").select("n_name"), "ncbi_db", terms.DATABASES)


_UPSERT = """SELECT user_id, arg_max(event_type, rank * 10000000000 - event_id) AS event_type, arg_max(event_id, rank * 10000000000 - event_id) AS kept_id, min(event_id) AS first_id
FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 0 END AS rank FROM events) GROUP BY user_id"""


def _ranked_events(spark, sf_dir) -> tuple[DataFrame, Column]:
    ranks = F.create_map(*[x for k, v in {"purchase": 4, "click": 3, "view": 2}.items() for x in (F.lit(k), F.lit(v))])
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("kept_id"), F.col("event_id").alias("first_id"))
    return rows, F.coalesce(F.try_element_at(ranks, F.col("event_type")), F.lit(0))


@query(_UPSERT)
def upsert_by_rank(spark, sf_dir):
    """AGG6, AGG7, SRT2, JN9"""
    rows, rank = _ranked_events(spark, sf_dir)
    return relational.upsert_by_rank(rows, ["user_id"], rank, "first_id")


@query(_UPSERT)
def upsert_increments(spark, sf_dir):
    """AGG6, AGG7 into a stored table: four increments merged one after the other give what one batch gives"""
    rows, rank = _ranked_events(spark, sf_dir)
    stored = UpsertTable(spark, f"{scratch(spark, 'upsert')}/events", ["user_id"], "first_id", buckets=16)
    for part in range(4):
        stored.merge(rows.where(F.pmod(F.xxhash64("kept_id"), F.lit(4)) == part), rank)
    return stored.rows().select(*rows.columns)


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def first_wins_changes(spark, sf_dir):
    """AGG1, AGG3, WIN1 on a stream: first of each key by order, in micro-batches of any order, with a restart in between; what stands after all changes"""
    root, keys = scratch(spark, "stream"), ["user_id", "event_type"]
    rows = _table(spark, sf_dir, "events").select(*keys, "event_id", "value")
    part = F.pmod(F.xxhash64("event_id"), F.lit(6))

    def kept(changes: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").parquet(f"{root}/changes/batch={number}")

    for run in range(2):  # the second goes on from the first's checkpoint
        for k in range(3 * run, 3 * run + 3):
            rows.where(part == k).repartition(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        changes = first_wins_stream(stream, keys, "event_id")
        changes.writeStream.outputMode("update").foreachBatch(kept).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return current(spark.read.parquet(f"{root}/changes").drop("batch"), keys)


# Terms and identifiers -----------------------------------------------------------------------------


@query("""WITH m AS (SELECT p_partkey, 'NCPPB ' || p_partkey AS n, 'NCPPB' || p_partkey AS c, p_name AS cur, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS rec FROM part)
SELECT DISTINCT * FROM (
  SELECT n AS ncppb_number, 'ncppb_number' AS term_type, n AS search_term FROM m
  UNION ALL SELECT n, 'ncppb_number_compact', c FROM m
  UNION ALL SELECT n, 'collection_name_plus_number', '"National Collection of Plant Pathogenic Bacteria" ' || p_partkey FROM m
  UNION ALL SELECT n, 'current_name_plus_number', '"' || cur || '" "' || n || '"' FROM m WHERE cur <> ''
  UNION ALL SELECT n, 'received_name_plus_number', '"' || rec || '" "' || n || '"' FROM m WHERE rec <> '' AND rec <> cur
  UNION ALL SELECT n, 'alternative_name_plus_number', '"alt ' || p_partkey || '" "' || n || '"' FROM m
  UNION ALL SELECT n, 'other_collection_number', 'ICMP ' || p_partkey FROM m
  UNION ALL SELECT n, 'other_collection_number', 'LMG 1' FROM m)""")
def multi_branch_terms(spark, sf_dir):
    """SET1, SCL10, FLT2, FLT3, AGG2"""
    key = F.concat(F.lit("NCPPB "), "p_partkey")
    rows = _parts(spark, sf_dir).select(
        key.alias("ncppb_number"), T.compact(key).alias("ncppb_number_compact"), F.col("p_name").alias("current_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("name_as_received"),
        F.concat(F.lit("alt "), "p_partkey").alias("alternative_names"), F.concat(F.lit("ICMP "), "p_partkey", F.lit(" ;| LMG 1")).alias("other_collection_numbers"), F.col("p_partkey").alias("ord"),
    )
    return terms.search_terms(rows, "ord")


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all({CLEAN_SQL}, '{GENERAL_RE}')) AS BIGINT) AS n, array_to_string(regexp_extract_all({CLEAN_SQL}, '{GENERAL_RE}'), chr(10)) AS found FROM documents")
def identifier_candidates_general(spark, sf_dir):
    """SCL19, EXP5: all matches of the general pattern"""
    found = T.matches(T.clean(F.translate("text", "_", ":")), identifiers.GENERAL, 2)
    return _table(spark, sf_dir, "documents").select("doc_id", found.alias("m")).select("doc_id", _long(F.size("m")).alias("n"), F.array_join(F.transform("m", lambda m: m["text"]), "\n").alias("found"))


@query(rf"""WITH t AS (SELECT doc_id, {CLEAN_SQL} AS t FROM documents), m AS (SELECT doc_id, t, regexp_replace(t, '({GENERAL_RE})', chr(1) || '\1' || chr(2)) AS s FROM t)
SELECT doc_id, strpos(s, chr(1)) - 1 AS start_at, strpos(s, chr(2)) - 2 AS end_at,
  trim(regexp_replace(substr(t, CAST(greatest(strpos(s, chr(1)) - 1 - 80, 0) + 1 AS BIGINT), CAST(strpos(s, chr(2)) - 2 + 80 - greatest(strpos(s, chr(1)) - 1 - 80, 0) AS BIGINT)), '\s+', ' ', 'g')) AS context
FROM m WHERE strpos(s, chr(1)) > 0""")
def context_window(spark, sf_dir):
    """SCL20, SCL21, WIN3: offsets and surroundings of the first match"""
    text = T.clean(F.translate("text", "_", ":"))
    first = _table(spark, sf_dir, "documents").select("doc_id", text.alias("t")).withColumn("m", F.get(T.matches(F.col("t"), identifiers.GENERAL, 2), F.lit(0))).where("m IS NOT NULL")
    return first.select("doc_id", _long(F.col("m.start")).alias("start_at"), _long(F.col("m.end")).alias("end_at"), T.context(F.col("t"), F.col("m.start"), F.col("m.end")).alias("context"))


@query(rf"""WITH t AS (SELECT doc_id, {CLEAN_SQL} AS t FROM documents), m AS (SELECT doc_id, t, string_split(regexp_replace(t, '({GENERAL_RE})', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM t),
u AS (SELECT doc_id, t, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM m),
w AS (SELECT *, CAST(coalesce(sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM u)
SELECT doc_id, CAST(i - 2 AS BIGINT) AS place, split_part(part, chr(2), 1) AS matched, start_at, start_at + strpos(part, chr(2)) - 1 AS end_at,
  trim(regexp_replace(substr(t, greatest(start_at - 80, 0) + 1, start_at + strpos(part, chr(2)) - 1 + 80 - greatest(start_at - 80, 0)), '\s+', ' ', 'g')) AS context FROM w WHERE i > 1""")
def context_windows(spark, sf_dir):
    """SCL20, SCL21, WIN3, EXP5: every match of every document with its offsets and surroundings"""
    found = _table(spark, sf_dir, "documents").select("doc_id", T.clean(F.translate("text", "_", ":")).alias("t")).withColumn("ms", T.matches(F.col("t"), identifiers.GENERAL, 2))
    each = found.select("doc_id", "t", F.posexplode_outer("ms").alias("place", "m")).where("m IS NOT NULL")
    return each.select("doc_id", _long(F.col("place")).alias("place"), F.col("m.text").alias("matched"), _long(F.col("m.start")).alias("start_at"), _long(F.col("m.end")).alias("end_at"), T.context(F.col("t"), F.col("m.start"), F.col("m.end")).alias("context"))


_REF_ROWS = f"""WITH refs AS ({REFS}), rows AS (
  SELECT *, 0 AS place, 'ICMP ' || p_partkey AS matched_text, 'ICMP' AS prefix, '' || p_partkey AS suffix, 'known_collection_prefix' AS rule_name, 'high' AS confidence FROM refs
  UNION ALL SELECT *, 1, 'LMG-' || p_size, 'LMG', '' || p_size, 'known_collection_prefix', 'high' FROM refs
  UNION ALL SELECT *, 2, 'B' || p_size, 'B', '' || p_size, 'source_context_single_letter_code', 'low' FROM refs)"""


@query(_REF_ROWS + """ SELECT ncppb_number, matched_text, prefix || ' ' || suffix AS normalized_identifier, prefix, suffix, rule_name, confidence, 'yes' AS include_for_search,
  prefix || '[All Fields] AND ' || suffix || '[All Fields]' AS biosample_query, CAST(place AS BIGINT) AS place FROM rows""")
def identifier_candidates_known(spark, sf_dir):
    """EXP5, SCL12, SCL13, RUL1, AGG6, SET4: candidates with merge and order"""
    found = identifiers.extract_identifiers(refs(spark, sf_dir))
    return found.select("ncppb_number", "matched_text", "normalized_identifier", "prefix", "suffix", "rule_name", "confidence", "include_for_search", "biosample_query", _long(F.col("place")).alias("place"))


@query(_REF_ROWS + " SELECT rule_name, confidence, count(*) AS n, count(DISTINCT ncppb_number) AS strains FROM rows GROUP BY 1, 2")
def classify_candidates(spark, sf_dir):
    """RUL1, FLT8, AGG14"""
    found = identifiers.extract_identifiers(refs(spark, sf_dir), keep_empty=False)
    return found.groupBy("rule_name", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ncppb_number").alias("strains"))


@query(rf"SELECT count(*) AS n_docs, count(*) FILTER (NOT regexp_matches({CLEAN_SQL}, '{GENERAL_RE}')) AS n_empty FROM documents")
def outer_expand(spark, sf_dir):
    """EXP6, FLT9: a text without candidates keeps one row"""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "_", ":").alias("text"))
    found = identifiers.extract_identifiers(docs, "doc_id", "text")
    return found.agg(F.count_distinct("ncppb_number").alias("n_docs"), F.count_if(F.col("rule_name") == "no_identifier_found").alias("n_empty"))


@query(f"""WITH refs AS ({REFS}) SELECT ncppb_number, 'ncppb_number' AS query_source, ncppb_number AS normalized_identifier, 'NCPPB[All Fields] AND ' || p_partkey || '[All Fields]' AS search_term FROM refs
UNION ALL SELECT ncppb_number, 'other_reference', 'ICMP ' || p_partkey, 'ICMP[All Fields] AND ' || p_partkey || '[All Fields]' FROM refs
UNION ALL SELECT ncppb_number, 'other_reference', 'LMG ' || p_size, 'LMG[All Fields] AND ' || p_size || '[All Fields]' FROM refs
UNION ALL SELECT ncppb_number, 'other_reference', 'B ' || p_size, 'B[All Fields] AND ' || p_size || '[All Fields]' FROM refs""")
def query_specs(spark, sf_dir):
    """SET2, AGG4, SCL14, FLT1, WIN1"""
    found = identifiers.extract_identifiers(refs(spark, sf_dir), carry=("p_partkey",))
    return lookup.query_specs(found.withColumn("ord", F.col("p_partkey") * 1000 + F.col("place")), "ord").select("ncppb_number", "query_source", "normalized_identifier", "search_term")


# Evidence ------------------------------------------------------------------------------------------

# Which identifiers of its strain a record names, for SQL without lookaround.
_JUDGED = f"""WITH refs AS ({REFS}), raw AS ({RAW}), joined AS (
  SELECT w.*, r.p_partkey, r.p_size, ' ' || metadata_text || ' ' AS t FROM raw w LEFT JOIN refs r USING (ncppb_number)
), hits AS (
  SELECT *, p_partkey IS NOT NULL AND regexp_matches(t, '\\bNCPPB[ :]0*' || p_partkey || '[^0-9]') AS own,
    p_partkey IS NOT NULL AND regexp_matches(t, '[^A-Za-z0-9]ICMP ' || p_partkey || '[^A-Za-z0-9]') AS icmp,
    p_partkey IS NOT NULL AND regexp_matches(t, '[^A-Za-z0-9]LMG-' || p_size || '[^A-Za-z0-9]') AS lmg,
    p_partkey IS NOT NULL AND regexp_matches(t, '[^A-Za-z0-9]B ' || p_size || '[^A-Za-z0-9]') AS b,
    regexp_extract(t, 'NCPPB[ :]0*([0-9]+)', 1) AS named, CAST(o_orderkey % 300 AS VARCHAR) AS expected FROM joined
), best AS (
  SELECT *, CASE WHEN status <> 'ok' THEN '' WHEN own THEN ncppb_number WHEN icmp THEN 'ICMP ' || p_partkey WHEN lmg THEN 'LMG ' || p_size WHEN b THEN 'B ' || p_size ELSE '' END AS best,
    CASE WHEN own THEN 100 WHEN icmp OR lmg THEN 90 WHEN b THEN 40 ELSE 0 END AS points, named <> '' AND named <> expected AS clash FROM hits
), judged AS (
  SELECT *, CASE WHEN status = 'no_hit' THEN 'no_biosample_candidate' WHEN status <> 'ok' THEN 'review_query_error' WHEN clash THEN 'reject_conflicting_identifier'
    WHEN organism LIKE 'P%' AND points >= 90 THEN 'review_strong_identifier_non_target_organism' WHEN organism LIKE 'P%' AND points > 0 THEN 'reject_weak_identifier_non_target_organism'
    WHEN organism LIKE 'P%' THEN 'reject_non_target_taxon' WHEN points = 100 THEN 'confirmed_ncppb_identifier' WHEN points = 90 THEN 'confirmed_equivalent_collection_identifier'
    WHEN points > 0 THEN 'review_local_or_donor_identifier_only' WHEN organism <> '' THEN 'review_taxon_only' ELSE 'review_no_organism_or_strain_identifier' END AS class FROM best
), decided AS (
  SELECT *, CASE WHEN class = 'no_biosample_candidate' THEN 'no_data' WHEN class LIKE 'confirmed%' THEN 'accept' WHEN class LIKE 'reject%' THEN 'reject' ELSE 'review' END AS decision,
    CASE WHEN class = 'review_taxon_only' THEN 20 WHEN status <> 'ok' OR class IN ('reject_non_target_taxon', 'review_no_organism_or_strain_identifier') THEN 0 ELSE points END AS score FROM judged)"""


def _named_refs(spark, sf_dir) -> DataFrame:
    """The references of strains that the records of raw name; these try no others' patterns."""
    named = spark.sql(RAW.replace("FROM orders", "FROM {source}"), source=_table(spark, sf_dir, "orders")).select("ncppb_number").distinct()
    return refs(spark, sf_dir).join(named, "ncppb_number", "left_semi")


def _patterns(references: DataFrame) -> DataFrame:
    found = identifiers.extract_identifiers(references, carry=("p_partkey",))
    return evidence.build_patterns(found.withColumn("ord", F.col("p_partkey") * 1000 + F.col("place")), "ord")


def _judged(spark, sf_dir) -> DataFrame:
    return evidence.classify_rows(raw(spark, sf_dir), _patterns(_named_refs(spark, sf_dir)))


@query(_JUDGED + " SELECT ncbi_uid, best AS matched_identifier FROM best WHERE best <> ''")
def pattern_match_best(spark, sf_dir):
    """JN1, JN2, AGG7, AGG8, SCL23, SCL24, FLT7, RUL3"""
    joined = raw(spark, sf_dir).where("status = 'ok'").join(_patterns(_named_refs(spark, sf_dir)), "ncppb_number")
    best = evidence.best_identifier(F.col("patterns"), F.col("metadata_text"))
    return joined.select("ncbi_uid", best["value"].alias("matched_identifier")).where("matched_identifier IS NOT NULL")


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 300 AS own, 'NCPPB ' || (o_orderkey % 300) || ', NCPPB No. 00' || (o_custkey % 300) || '; ncppb#' || (o_orderkey % 7) AS text FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_filter(list_distinct([CAST(own AS VARCHAR), CAST((SELECT o_custkey FROM orders o WHERE o.o_orderkey = t.o_orderkey) % 300 AS VARCHAR), CAST(o_orderkey % 7 AS VARCHAR)]), lambda x: x <> CAST(own AS VARCHAR))), ';') AS conflicts FROM t""")
def conflict_numbers(spark, sf_dir):
    """SCL16, SCL26, AGG11, SET5, SRT3"""
    own = F.col("o_orderkey") % 300
    text = F.concat(F.lit("NCPPB "), own, F.lit(", NCPPB No. 00"), F.col("o_custkey") % 300, F.lit("; ncppb#"), F.col("o_orderkey") % 7)
    found = F.array_sort(F.array_except(T.found_numbers(text), F.array(own.cast("string"))))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ";").alias("conflicts"))


_CLASSIFIED = _JUDGED + """ SELECT ncbi_uid, decision AS evidence_decision, class AS evidence_class, CAST(score AS VARCHAR) AS evidence_score,
  CASE WHEN class IN ('review_taxon_only', 'reject_non_target_taxon', 'review_no_organism_or_strain_identifier') THEN '' ELSE best END AS matched_identifier FROM decided"""


@query(_CLASSIFIED)
def classify_evidence(spark, sf_dir):
    """RUL2-RUL4, JN1, JN2, FLT6, PRJ6"""
    return _judged(spark, sf_dir).select("ncbi_uid", "evidence_decision", "evidence_class", "evidence_score", "matched_identifier")


@query(_CLASSIFIED)
def classify_indexed(spark, sf_dir):
    """JN1, JN2, FLT7, AGG7: the same by an inverted index of the patterns, joined with the texts by strain and token"""
    found = identifiers.extract_identifiers(_named_refs(spark, sf_dir), carry=("p_partkey",))
    index = evidence.pattern_index(found.withColumn("ord", F.col("p_partkey") * 1000 + F.col("place")), "ord")
    return evidence.classify_indexed(raw(spark, sf_dir), index).select("ncbi_uid", "evidence_decision", "evidence_class", "evidence_score", "matched_identifier")


@query(_JUDGED + " SELECT ncbi_uid, decision AS evidence_decision, class AS evidence_class, decision = 'accept' AS accepted FROM decided")
def split_accept_review(spark, sf_dir):
    """SNK2, SNK3, SRC3, SRC4: accepted rows in one table, all others in another, both written and read again"""
    where = scratch(spark, "split")
    tables.split_sink(_judged(spark, sf_dir), F.col("evidence_decision") == "accept", f"{where}/accepted.tsv", f"{where}/review.tsv")
    both = [tables.read_table(spark, f"{where}/{name}.tsv").withColumn("accepted", F.lit(name == "accepted")) for name in ("accepted", "review")]
    return both[0].unionByName(both[1]).select("ncbi_uid", "evidence_decision", "evidence_class", "accepted")


@query(_JUDGED + """ SELECT count(*) AS rows, count(*) FILTER (decision = 'accept') AS accepted, count(*) FILTER (decision = 'review') AS review, count(*) FILTER (decision = 'reject') AS rejected,
  count(*) FILTER (decision = 'no_data') AS no_data, count(*) FILTER (score >= 90) AS strong FROM decided""")
def run_metrics(spark, sf_dir):
    """SNK4, AGG13: the counts that a run observes while it writes its table, without another pass"""
    decided = lambda d: F.col("evidence_decision") == d
    rows, seen = tables.observed(
        _judged(spark, sf_dir), "evidence", accepted=decided("accept"), review=decided("review"), rejected=decided("reject"), no_data=decided("no_data"), strong=F.col("evidence_score").cast("int") >= 90
    )
    tables.write_table(rows, f"{scratch(spark, 'metrics')}/evidence.tsv", EVIDENCE)
    return spark.createDataFrame([seen.get])


@query(_JUDGED + " SELECT decision AS evidence_decision, class AS evidence_class, count(*) AS n, CAST(grouping(decision, class) AS BIGINT) AS level FROM decided GROUP BY ROLLUP (decision, class)")
def audit_rollup(spark, sf_dir):
    """AGG14"""
    return report.rollup_counts(_judged(spark, sf_dir), "evidence_decision", "evidence_class")


@query(_REF_ROWS + " SELECT count(*) AS n_rows, count(*) AS n_included, CAST(0 AS BIGINT) AS n_rejected, CAST(0 AS BIGINT) AS n_empty, count(DISTINCT ncppb_number || prefix || ' ' || suffix) AS n_distinct FROM rows")
def identifier_summary(spark, sf_dir):
    """AGG13, AGG14"""
    return report.identifier_summary(identifiers.extract_identifiers(refs(spark, sf_dir)))


# Pages and documents -------------------------------------------------------------------------------


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '<a\b[^>]*?href\s*=\s*["'']?([^"''\s>]*)[^>]*>(.*?)</a>')) AS BIGINT) AS n_links,
  array_to_string(list_transform(regexp_extract_all(html, '<a\b[^>]*?href\s*=\s*["'']?([^"''\s>]*)[^>]*>(.*?)</a>', 1), lambda x: CASE WHEN starts_with(x, '/') THEN 'https://example.org' || x WHEN regexp_matches(x, '^[a-z]+:') THEN x ELSE 'https://example.org/' || x END), ' ') AS links FROM pages""")
def page_links(spark, sf_dir):
    """SCL30: addresses of links, made absolute"""
    found = H.links("html")
    return _table(spark, sf_dir, "pages").select("page_id", _long(F.size(found)).alias("n_links"), F.array_join(F.transform(found, lambda x: H.absolute(x["href"], "https://example.org/")), " ").alias("links"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS title,
  CAST(length(regexp_replace(html, '<[^>]+>', '', 'g')) AS BIGINT) AS n_text FROM pages""")
def page_label_values(spark, sf_dir):
    """SCL29: title and length of the text; catalogue_records looks labels up"""
    title = T.clean(H.unescape_common(H.without_tags(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))))
    return _table(spark, sf_dir, "pages").select("page_id", title.alias("title"), _long(F.char_length(F.regexp_replace(H.page_source("html"), "<[^>]+>", ""))).alias("n_text"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 50 END AS total, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '' || user_id ELSE user_id || ' ' || event_id END AS ids FROM events""")
def search_documents(spark, sf_dir):
    """JSN1, JSN3, SCL31: total and ids of search documents; none, without a count, with a raw tab in a string"""
    which = F.col("event_id") % 3
    one, two = F.concat(F.lit('"'), "user_id", F.lit('"')), F.concat(F.lit('"'), "user_id", F.lit('", "'), "event_id", F.lit('"'))
    document = F.when(which == 0, "{}").otherwise(
        F.concat(F.lit('{"header": {"type": "a\tb"}, "esearchresult": {"count": "'), F.col("event_id") % 50, F.lit('", "idlist": ['), F.when(which == 1, one).otherwise(two), F.lit("]}}"))
    )
    return _table(spark, sf_dir, "events").select("event_id", lookup.search_result(document).alias("r")).select("event_id", _long(F.col("r.total")).alias("total"), F.array_join("r.ids", " ").alias("ids"))


@query("""SELECT event_id, 'A' || event_id AS accession, 'a ' || event_type AS title, '' AS taxonomy, k AS n_summaries FROM (SELECT *, CAST(1 + event_id % 2 AS BIGINT) AS k FROM events)""")
def summary_documents(spark, sf_dir):
    """JSN1, JSN2: the summaries of a document by id, one record's fields flattened; a raw line break in a string"""
    one = F.concat(F.lit('"7": {"accession": "A'), "event_id", F.lit('", "title": "a\n'), "event_type", F.lit('"}'))
    other = F.when(F.col("event_id") % 2 == 1, ', "8": {"title": "other"}').otherwise("")
    document = F.concat(F.lit('{"result": {"uids": ["7", "8"], '), one, other, F.lit("}}"))
    found = _table(spark, sf_dir, "events").select("event_id", lookup.summaries_of(document).alias("m"))
    flat = {c: x for c, x in zip(RAW_ROWS[6:17], lookup.flattened(F.lit("7"), F.col("m")["7"], exact_xml=False), strict=True)}
    return found.select("event_id", flat["ncbi_accession"].alias("accession"), flat["title"].alias("title"), flat["taxid"].alias("taxonomy"), _long(F.size("m")).alias("n_summaries"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'strain: ab ' || p_partkey || ' c; host: ' || p_brand WHEN 2 THEN 'attribute: x y' ELSE '' END AS attributes FROM part""")
def xml_mixed(spark, sf_dir):
    """XML1-XML3: malformed fragments, mixed content, attributes at any depth, by the element tree"""
    k = F.col("p_partkey") % 4
    mixed = F.concat(F.lit('<A><B><Attribute attribute_name="strain">ab<i> '), "p_partkey", F.lit('</i> c</Attribute></B><Attribute harmonized_name="host">'), "p_brand", F.lit("</Attribute></A>"))
    xml = F.when(k == 0, "<Attribute>open").when(k == 1, mixed).when(k == 2, "<Attribute>x\n <b>y</b></Attribute><Attribute> </Attribute>").otherwise("")
    return _table(spark, sf_dir, "part").select("p_partkey", lookup.attributes(xml).alias("attributes"))


@query("SELECT p_partkey, 'strain: ' || p_partkey || '; host: ' || p_brand || '; attribute: ' || p_size AS attributes FROM part")
def xml_attributes(spark, sf_dir):
    """SCL17, XML2, XML3 where values are one run of text, in the JVM"""
    xml = F.concat(F.lit('<Attribute attribute_name="strain" harmonized_name="x">'), "p_partkey", F.lit('</Attribute><Attribute harmonized_name="host">'), "p_brand", F.lit("</Attribute><Attribute> "), "p_size", F.lit(" </Attribute><Attribute/>"))
    return _table(spark, sf_dir, "part").select("p_partkey", lookup.xml_attributes(xml).alias("attributes"))


_LOOKED = """WITH hits AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)"""


def _looked_up(spark, sf_dir, failing: bool) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").dropDuplicates(["o_orderkey"])
    uid = F.col("o_orderkey").cast("string")
    hits = orders.select(F.concat(F.lit("c"), "o_custkey").alias("search_term"), uid.alias("uid"), F.col("o_orderkey").alias("place"))
    summaries = orders.select(uid.alias("uid"), F.to_json(F.struct(F.concat(F.lit("S"), "o_orderkey").alias("accession"), F.col("o_orderpriority").alias("title"))).alias("summary"))
    term = F.concat(F.lit("c"), "c_custkey").alias("search_term")
    customers = _table(spark, sf_dir, "customer")
    errors = customers.where("c_custkey % 10 = 3").select(term, F.lit("timed out").alias("error")) if failing else None
    blank = [F.lit("").alias(c) for c in lookup.SPEC[1:5]]
    return lookup.ReplayLookup(hits, summaries, errors).records(customers.select(F.col("c_custkey").cast("string").alias("ncppb_number"), *blank, term), most=3)


@query(_LOOKED + """ SELECT CAST(c_custkey AS VARCHAR) AS ncppb_number, coalesce(CAST(o_orderkey AS VARCHAR), '') AS ncbi_uid, CASE WHEN o_orderkey IS NULL THEN '' ELSE o_orderpriority END AS title,
  CAST(coalesce(total, 0) AS VARCHAR) AS id_count_returned, CASE WHEN o_orderkey IS NULL THEN 'no_hit' ELSE 'ok' END AS status
FROM customer LEFT JOIN (SELECT * FROM hits WHERE rn <= 3) ON c_custkey = o_custkey""")
def lookup_replay(spark, sf_dir):
    """SRC6-SRC8, JN6, JN7, LIM3, RUL6, EXP7, PRJ7"""
    return _looked_up(spark, sf_dir, False).select("ncppb_number", "ncbi_uid", "title", "id_count_returned", "status")


@query(_LOOKED + """ SELECT CAST(c_custkey AS VARCHAR) AS ncppb_number, 'c' || c_custkey AS search_term, 'biosample' AS ncbi_db, CASE WHEN kind = 'ok' THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS ncbi_uid,
  CASE WHEN kind = 'ok' THEN 'S' || o_orderkey ELSE '' END AS ncbi_accession, CASE WHEN kind = 'ok' THEN 'https://www.ncbi.nlm.nih.gov/biosample/S' || o_orderkey ELSE '' END AS source_url,
  CASE WHEN kind = 'ok' THEN o_orderpriority ELSE '' END AS title, CASE WHEN kind = 'ok' THEN o_orderpriority ELSE '' END AS metadata_text,
  CASE kind WHEN 'error' THEN '' WHEN 'ok' THEN CAST(total AS VARCHAR) ELSE '0' END AS id_count_returned, kind AS status, CASE kind WHEN 'error' THEN 'timed out' ELSE '' END AS error
FROM (SELECT *, CASE WHEN c_custkey % 10 = 3 THEN 'error' WHEN o_orderkey IS NULL THEN 'no_hit' ELSE 'ok' END AS kind
  FROM customer LEFT JOIN (SELECT * FROM hits WHERE rn <= 3) ON c_custkey = o_custkey) WHERE kind <> 'error' OR coalesce(rn, 1) = 1""")
def lookup_errors(spark, sf_dir):
    """RUL5, RUL6, PRJ7: a failed lookup is one row, whatever had been found; hits and lookups without any beside it"""
    return _looked_up(spark, sf_dir, True).select("ncppb_number", "search_term", "ncbi_db", "ncbi_uid", "ncbi_accession", "source_url", "title", "metadata_text", "id_count_returned", "status", "error")


def _search_answers(hits: DataFrame, totals: DataFrame, page: int, most: int) -> DataFrame:
    """search_term, request, answer: the documents of the first `most` hits (search_term, uid, place from 0), a page each, and of searches without any. totals: search_term, total."""
    pages = hits.where(F.col("place") < most).groupBy("search_term", (F.floor(F.col("place") / page) * page).alias("start")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "uid"))), lambda x: x["uid"]).alias("ids"))
    every = totals.join(pages, "search_term", "left").select("search_term", "total", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    sized = every.withColumn("size", F.least(F.lit(page), F.lit(most) - F.col("start")).cast("int"))
    body = F.to_json(F.struct(F.struct(F.col("total").cast("string").alias("count"), F.col("ids").alias("idlist")).alias("esearchresult")))
    return sized.select("search_term", paged.search_request(F.lit("biosample"), F.col("search_term"), F.col("start"), F.col("size")).alias("request"), body.alias("answer"))


@query("""WITH hits AS (SELECT 'nation ' || c_nationkey AS search_term, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, 'u' || c_custkey AS uid, count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer)
SELECT search_term, CAST(place AS BIGINT) AS place, uid, CAST(total AS BIGINT) AS total FROM hits WHERE place < 50 AND search_term NOT IN ('nation 3', 'nation 4')""")
def paged_search(spark, sf_dir):
    """SRC6, SRC7, SRC9: searches answered page by page, pages read by several tasks; a filter on terms keeps others from being asked for"""
    customers = _table(spark, sf_dir, "customer")
    term = F.concat(F.lit("nation "), "c_nationkey").alias("search_term")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    hits = customers.select(term, F.concat(F.lit("u"), "c_custkey").alias("uid"), place.alias("place"))
    nations = _table(spark, sf_dir, "nation").select(F.concat(F.lit("nation "), "n_nationkey").alias("search_term"))
    totals = nations.join(hits.groupBy("search_term").agg(F.count(F.lit(1)).alias("total")), "search_term", "left").fillna(0)
    counts = totals.select(paged.search_request(F.lit("biosample"), F.col("search_term"), F.lit(0), F.lit(0)).alias("request"), F.to_json(F.struct(F.struct(F.col("total").cast("string").alias("count"), F.array().cast("array<string>").alias("idlist")).alias("esearchresult"))).alias("answer"))
    folder = f"{scratch(spark, 'answers')}/searches"
    asked = totals.where(~F.col("search_term").isin("nation 3", "nation 4"))  # asking for the others would fail
    paged.record_answers(_search_answers(hits, asked, 15, 50).drop("search_term").unionByName(counts.where(~F.col("request").rlike("nation [34][|]"))), folder)
    terms = [r.search_term for r in nations.collect()]  # the 25 nations
    found = paged.paged_search(spark, lambda: lookup.Service(delay=0, opener=paged.Recorded(folder)), terms, page=15, most=50)
    return found.where(F.col("search_term").isin([t for t in terms if t not in ("nation 3", "nation 4")]))


@query(_LOOKED + """ SELECT CAST(c_custkey AS VARCHAR) AS ncppb_number, CASE WHEN kind = 'ok' THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS ncbi_uid, CASE WHEN kind = 'ok' THEN o_orderpriority ELSE '' END AS title,
  CASE kind WHEN 'error' THEN '' WHEN 'ok' THEN CAST(total AS VARCHAR) ELSE '0' END AS id_count_returned, kind AS status, CAST(CASE WHEN kind = 'error' THEN 3 WHEN c_custkey % 10 = 3 THEN 2 ELSE 1 END AS BIGINT) AS attempts
FROM (SELECT *, CASE WHEN c_custkey % 10 = 7 THEN 'error' WHEN o_orderkey IS NULL THEN 'no_hit' ELSE 'ok' END AS kind
  FROM customer LEFT JOIN (SELECT * FROM hits WHERE rn <= 3) ON c_custkey = o_custkey) WHERE kind <> 'error' OR coalesce(rn, 1) = 1""")
def lookup_retries(spark, sf_dir):
    """SRC6-SRC9, JN7, RUL5, RUL6: lookups over several tasks with pages and batches of two; a service that has no answer for some terms at first, and never for others, which end as dead letters after three attempts"""
    orders, customers = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    hits = orders.select("o_custkey", F.concat(F.lit("c"), "o_custkey").alias("search_term"), F.col("o_orderkey").cast("string").alias("uid"), place.alias("place"), "o_orderpriority")
    totals = customers.select(F.concat(F.lit("c"), "c_custkey").alias("search_term"), "c_custkey").join(hits.groupBy("search_term").agg(F.count(F.lit(1)).alias("total")), "search_term", "left").fillna(0)
    two = hits.where("place < 3").groupBy("search_term", F.floor(F.col("place") / 2).alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "uid", F.col("o_orderpriority").alias("title")))).alias("rs"))
    ids = F.transform("rs", lambda r: r["uid"])
    each = F.map_from_entries(F.transform("rs", lambda r: F.struct(r["uid"], F.to_json(F.struct(r["title"].alias("title"))))))
    body = F.concat(F.lit('{"result": {"uids": '), F.to_json(ids), F.lit(", "), F.array_join(F.transform(F.map_entries(each), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}}"))
    summaries = two.select("search_term", paged.summary_request(F.lit("biosample"), F.array_join(ids, ",")).alias("request"), body.alias("answer"))
    rest = F.regexp_extract("search_term", r"(\d+)", 1).cast("long") % 10
    root = scratch(spark, "service")
    specs = customers.select(F.col("c_custkey").cast("string").alias("ncppb_number"), *[F.lit("").alias(c) for c in lookup.SPEC[1:5]], F.concat(F.lit("c"), "c_custkey").alias("search_term"))
    for state, known in (("at first", ~rest.isin(3, 7)), ("later", rest != 7)):
        # a page of two, then what is left of three; a search without hits is one empty page
        paged.record_answers(_search_answers(hits.drop("o_custkey", "o_orderpriority"), totals.where(known).select("search_term", "total"), 2, 3).unionByName(summaries), f"{root}/{state}", near="search_term")
    log = lookup.AttemptLog(spark, f"{root}/log")
    for state, attempts in (("at first", 1), ("later", 3)):
        looked = lookup.HttpLookup(lambda folder=f"{root}/{state}": lookup.Service(delay=0, opener=paged.Recorded(folder)), page=2, most=3, batch=2, tasks=4)
        found = looked.harvest(specs, log.path, every=5000, attempts=attempts, wait=0.0)
    return found.join(log.state().select("ncppb_number", _long(F.col("attempts")).alias("attempts")), "ncppb_number").select("ncppb_number", "ncbi_uid", "title", "id_count_returned", "status", "attempts")


@query("SELECT event_type AS ncbi_db, count(*) AS n_lookups, count(*) FILTER (value > 50) AS n_with_ids, count(*) FILTER (event_id % 7 = 0) AS n_errors, CAST(sum(CASE WHEN value > 50 THEN 2 ELSE 0 END) AS BIGINT) AS n_ids FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    """AGG13, AGG14, RUL6"""
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("ncbi_db"), F.when(F.col("value") > 50, 2).otherwise(0).alias("id_count_returned"), F.when(F.col("event_id") % 7 == 0, "error").otherwise("ok").alias("status"))
    return report.lookup_summary(rows)


@query("SELECT count(*) FILTER (coalesce(p_name, '') <> '') AS p_name, count(*) FILTER (coalesce(p_brand, '') <> '') AS p_brand, count(*) FILTER (p_size IS NOT NULL) AS p_size FROM part")
def filled_counts(spark, sf_dir):
    """AGG14"""
    return report.filled_counts(_table(spark, sf_dir, "part").select("p_name", "p_brand", "p_size"))


# Rules, one case each ------------------------------------------------------------------------------

# A text for each rule, and what it gives: prefix, suffix, matched text, rule, confidence.
_RULES = """(VALUES (0, 'isolated by X. A ', '', 'A', '', 'A ', 'source_context_single_letter_code', 'low'),
  (1, 'isolated by J. Smith No ', '', 'NO', '', 'No ', 'source_context_number_label', 'low'),
  (2, 'this AND ', ' that', 'AND', '', 'AND ', 'stopword_prefix', 'reject'),
  (3, 'of NBC', '', 'NBC', '', 'NBC', 'known_collection_prefix', 'high'),
  (4, 'by G. Orian ', '', 'ORIAN', '', 'Orian ', 'person_or_local_reference_code', 'low'),
  (5, 'accession Xyz ', '', 'XYZ', '', 'Xyz ', 'contextual_reference_code', 'medium'),
  (6, 'see XS', '/5', 'XS', '/5', 'XS', 'uppercase_general_code', 'medium'),
  (7, 'see q ', '', 'Q', '', 'q ', 'single_letter_code', 'low'),
  (8, 'see Xyz-', '', 'XYZ', '', 'Xyz-', 'general_code_candidate', 'low'),
  (9, 'nothing of note', '', '', '', '', 'no_identifier_found', 'none'))"""
RULE_TEXTS = f"SELECT p_partkey, before || CASE WHEN k = 9 THEN '' ELSE '' || p_partkey END || behind AS text FROM part JOIN {_RULES} AS t(k, before, behind, prefix, tail, matched, rule, confidence) ON p_partkey % 10 = k"


@query(f"""SELECT CAST(p_partkey AS VARCHAR) AS ncppb_number, before || found || behind AS other_references, matched || found || tail AS matched_text, trim(prefix || ' ' || found || tail) AS normalized_identifier,
  prefix, found || tail AS suffix, rule AS rule_name, confidence, CASE WHEN confidence IN ('reject', 'none') THEN 'no' ELSE 'yes' END AS include_for_search,
  CASE WHEN confidence IN ('reject', 'none') THEN '' ELSE prefix || '[All Fields] AND ' || found || '[All Fields]' || CASE WHEN tail = '' THEN '' ELSE ' AND 5[All Fields]' END END AS biosample_query,
  CASE WHEN k = 9 THEN '' ELSE before || found || behind END AS context
FROM (SELECT *, CASE WHEN k = 9 THEN '' ELSE '' || p_partkey END AS found FROM part JOIN {_RULES} AS t(k, before, behind, prefix, tail, matched, rule, confidence) ON p_partkey % 10 = k)""")
def identifier_rules(spark, sf_dir):
    """RUL1 (all nine rules and none), SET6, SCL12, SCL13, SCL22, SCL25, FLT9, EXP6: every column of one text a rule"""
    k = F.col("p_partkey") % 10
    before = F.array(*[F.lit(x) for x in ("isolated by X. A ", "isolated by J. Smith No ", "this AND ", "of NBC", "by G. Orian ", "accession Xyz ", "see XS", "see q ", "see Xyz-", "nothing of note")])
    text = F.concat(F.get(before, k.cast("int")), F.when(k == 9, "").otherwise(F.col("p_partkey").cast("string")), F.when(k == 2, " that").when(k == 6, "/5").otherwise(""))
    found = identifiers.extract_identifiers(_table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")
    return found.drop("place")


# One record a class of evidence, for the strain of each part.
_CASES = """(VALUES (0, 'no_hit', '', 'x', 'no_public_data_found', 'no_data', 'no_biosample_candidate', 0, '', 'query_returned_no_biosample_records'),
  (1, 'error', '', 'x', 'ambiguous', 'review', 'review_query_error', 0, '', 'query_error'),
  (2, 'ok', 'Xanthomonas citri', 'NCPPB # and NCPPB 99999', 'ambiguous', 'reject', 'reject_conflicting_identifier', 100, 'own', 'conflicting_ncppb_number:99999'),
  (3, 'ok', 'Pseudomonas', 'strain ICMP #', 'probable_strain_match', 'review', 'review_strong_identifier_non_target_organism', 90, 'icmp', 'strong_identifier_match_non_xanthomonas_organism'),
  (4, 'ok', 'Pseudomonas', 'isolate B@ x', 'ambiguous', 'reject', 'reject_weak_identifier_non_target_organism', 40, 'b', 'weak_identifier_match_non_xanthomonas_organism'),
  (5, 'ok', 'Pseudomonas', 'leaf', 'ambiguous', 'reject', 'reject_non_target_taxon', 0, '', 'non_xanthomonas_organism'),
  (6, 'ok', '', 'ncppb no. 00#', 'strong_strain_match', 'accept', 'confirmed_ncppb_identifier', 100, 'own', ''),
  (7, 'ok', 'Xanthomonas sp.', '(icmp_#)', 'strong_strain_match', 'accept', 'confirmed_equivalent_collection_identifier', 90, 'icmp', ''),
  (8, 'ok', 'Xanthomonas', 'B-@', 'probable_strain_match', 'review', 'review_local_or_donor_identifier_only', 40, 'b', 'local_or_donor_identifier_requires_manual_review'),
  (9, 'ok', 'xanthomonas', 'leaf', 'taxon_level_only', 'review', 'review_taxon_only', 20, '', 'no_exact_strain_identifier_match'),
  (10, 'ok', '', 'leaf', 'ambiguous', 'review', 'review_no_organism_or_strain_identifier', 0, '', 'no_organism_or_strain_identifier'))
  AS t(k, status, organism, template, level, decision, class, score, kind, reason)"""
EVIDENCE_ROWS = f"""SELECT 'NCPPB ' || p_partkey AS ncppb_number, 'biosample' AS ncbi_db, 'u' || p_partkey AS ncbi_uid, 'S' || p_partkey AS ncbi_accession, 'http://x/' || p_partkey AS source_url, p_name AS title, organism,
  '' || p_size AS taxid, 'other_reference' AS query_source, 'q' || p_partkey AS search_term, replace(replace(template, '#', '' || p_partkey), '@', '' || p_size) AS metadata_text, status, CASE WHEN status = 'error' THEN 'down' ELSE '' END AS error
FROM part JOIN {_CASES} ON p_partkey % 11 = k"""


@query(f"""WITH rows AS ({EVIDENCE_ROWS})
SELECT r.*, level AS evidence_level, decision AS evidence_decision, class AS evidence_class, CAST(score AS VARCHAR) AS evidence_score,
  CASE kind WHEN 'own' THEN r.ncppb_number WHEN 'icmp' THEN 'ICMP ' || p_partkey WHEN 'b' THEN 'B ' || p_size ELSE '' END AS matched_identifier,
  CASE kind WHEN '' THEN '' WHEN 'own' THEN 'ncppb_number' ELSE 'other_reference_identifier' END AS matched_identifier_type,
  CASE kind WHEN 'own' THEN 'ncppb_number' WHEN 'icmp' THEN 'known_collection_prefix' WHEN 'b' THEN 'source_context_single_letter_code' ELSE '' END AS identifier_rule_name,
  CASE kind WHEN '' THEN '' WHEN 'b' THEN 'low' ELSE 'high' END AS identifier_confidence, reason AS reject_reason
FROM rows r JOIN part ON r.ncppb_number = 'NCPPB ' || p_partkey JOIN {_CASES} ON p_partkey % 11 = k""")
def evidence_classes(spark, sf_dir):
    """RUL2 (all eleven classes), RUL3, RUL4, PRJ6, SCL23, SCL24, SCL26: every column, row by row"""
    rows = spark.sql(EVIDENCE_ROWS.replace("FROM part", "FROM {part}"), part=_parts(spark, sf_dir))
    patterns = _patterns(refs(spark, sf_dir)).hint("merge")  # by the size of its file Spark would broadcast every part's patterns
    return evidence.classify_rows(rows, patterns).select(*EVIDENCE)


# Catalogue pages -----------------------------------------------------------------------------------


def catalogue_pages(spark, sf_dir) -> DataFrame:
    """path, value: pages of ten parts each, a header row with the record's link and a detail row with labels; every second page is a view-source save."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")

    def detail(label: str, *value) -> list:
        return [F.lit(f"<tr><td><strong>{label}:</strong></td><td>"), *value, F.lit("</td></tr>\n")]

    record = F.concat(
        F.lit("<tr><td>"), size, F.lit('</td><td><a href="furtherinfo.cfm?ncppb_no='), k, F.lit('">NCPPB '), k, F.lit("</a></td><td><i>"), F.col("p_name"), F.lit("</i> pv. x"), size, F.lit("</td></tr>\n<tr><td colspan=3><table>"),
        *detail("Country", F.col("p_brand")), *detail("Other references", F.lit("ICMP "), k, F.lit(",<br>LMG-"), size, F.lit(" &amp; more")), *detail("Notes", F.lit("seen")), *detail("Notes", F.lit("again "), size),
        *detail("Host", F.lit("")), *detail("Shelf", F.lit("none")), *detail("Sequencing link", F.lit('<a href="/s/'), k, F.lit('">One</a> <a href="http://q/2"></a>')), F.lit("</table></td></tr>\n"),
    )
    given = _table(spark, sf_dir, "part").withColumn("page", F.floor(F.col("p_partkey") / 10))
    rows = relational.spread(given, "page", PARTS_A_TASK).select("page", F.struct("p_partkey", record.alias("html")).alias("r"))
    whole = rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("rs")).select("page", F.concat(F.lit("<table>\n"), F.array_join(F.transform("rs", lambda r: r["html"]), ""), F.lit("</table>")).alias("html"))
    escaped = F.replace(F.replace(F.replace("html", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split(escaped, "\n"), lambda x: F.concat(F.lit('<tr><td class="line-number"></td><td class="line-content"><span>'), x, F.lit("</span></td></tr>")))
    return whole.select(F.format_string("page%09d", "page").alias("path"), F.when(F.col("page") % 2 == 1, F.concat(F.lit("<table>"), F.array_join(lines, ""), F.lit("</table>"))).otherwise(F.col("html")).alias("value"))


@query("""SELECT 'NCPPB ' || p_partkey AS ncppb_number, 'NCPPB' || p_partkey AS ncppb_number_compact, p_name || ' pv. x' || p_size AS current_name, '' AS name_as_received, '' AS alternative_names, 'pv. x' || p_size AS pathovar, '' AS host, p_brand AS country,
  'ICMP ' || p_partkey || '; LMG-' || p_size AS other_collection_numbers, 'https://ncppb.fera.co.uk/furtherinfo.cfm?ncppb_no=' || p_partkey AS ncppb_catalogue_url, 'One <https://ncppb.fera.co.uk/s/' || p_partkey || '>; http://q/2' AS catalogue_sequence_links,
  '' AS sequencing_type, '' AS year_added, '' AS type_strain_of_species, '' AS pathotype_strain, 'ICMP ' || p_partkey || ', LMG-' || p_size || ' & more' AS other_references, 'seen; again ' || p_size AS notes,
  p_size || ' NCPPB ' || p_partkey || ' ' || p_name || ' pv. x' || p_size || ' Country: ' || p_brand || ' Other references: ICMP ' || p_partkey || ', LMG-' || p_size || ' & more Notes: seen Notes: again ' || p_size || ' Host: Shelf: none Sequencing link: One' AS raw_record_text FROM part""")
def catalogue_records(spark, sf_dir):
    """EXP1-EXP3, JN8, JN10, FLT4, FLT5, AGG12, SCL15, SCL27, SCL29, SCL32: records of catalogue pages, view-source saves among them, all 18 columns"""
    return catalogue.page_records(catalogue_pages(spark, sf_dir)).select(*MASTER)


@query("""SELECT 'NCPPB ' || p_partkey AS ncppb_number, p_name AS current_name, CASE p_partkey % 4 WHEN 0 THEN 'seen; later' WHEN 1 THEN 'seen again ' || p_size WHEN 2 THEN 'seen; again ' || p_size ELSE '' END AS notes, p_brand AS host FROM part WHERE p_partkey % 3 <> 0""")
def catalogue_edges(spark, sf_dir):
    """FLT4, AGG12, SCL27, FLT5: record rows of two cells give no record; a label met again replaces what it is part of, is appended else, and doesn't count if empty"""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")

    def notes(*values) -> Column:
        return F.concat(*[x for v in values for x in (F.lit("<tr><td><strong>Notes:</strong></td><td>"), v, F.lit("</td></tr>"))])

    again = F.concat(F.lit("seen again "), size)
    met = F.when(F.col("p_partkey") % 4 == 0, notes(again, F.lit("seen"), F.lit("later"))).when(F.col("p_partkey") % 4 == 1, notes(again, F.lit(" "))).when(F.col("p_partkey") % 4 == 2, notes(F.lit("seen"), F.concat(F.lit("again "), size))).otherwise(notes(F.lit("")))
    third = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("<td>"), F.col("p_name"), F.lit("</td>")))
    html = F.concat(
        F.lit("<table><tr><td>"), size, F.lit('</td><td><a href="furtherinfo.cfm?ncppb_no='), k, F.lit('">NCPPB '), k, F.lit("</a></td>"), third, F.lit("</tr><tr><td colspan=3><table>"), met,
        F.lit("<tr><td><strong>Host:</strong></td><td>"), F.col("p_brand"), F.lit("</td></tr></table></td></tr></table>"),
    )
    pages = _parts(spark, sf_dir).select(F.format_string("page%09d", "p_partkey").alias("path"), html.alias("value"))
    return catalogue.page_records(pages).select("ncppb_number", "current_name", "notes", "host")


@query("SELECT 'NCPPB ' || p_partkey AS ncppb_number, 'ICMP ' || p_partkey || ', LMG-' || p_size || ' & more' AS other_references FROM part")
def catalogue_references(spark, sf_dir):
    """WIN2, EXP1, EXP3, SCL30: of each record's link the text up to the next link"""
    return catalogue.page_references(catalogue_pages(spark, sf_dir))


@query("""SELECT ncppb_number, ncppb_number_compact, current_name, pathovar, country, CAST(row_number() OVER (ORDER BY k NULLS LAST, seen) AS BIGINT) AS place FROM (
  SELECT *, TRY_CAST(regexp_extract(ncppb_number, '[0-9]+') AS DOUBLE) AS k FROM (
    SELECT CASE WHEN p_partkey % 7 = 0 THEN 'loan ' || p_type ELSE 'NCPPB ' || p_size END AS ncppb_number, CASE WHEN p_partkey % 7 = 0 THEN 'LOAN' || replace(upper(p_type), ' ', '') ELSE 'NCPPB' || p_size END AS ncppb_number_compact,
      p_name || ' pv. z' AS current_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'pv. z' END AS pathovar, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS country, p_partkey AS seen,
      row_number() OVER (PARTITION BY CASE WHEN p_partkey % 7 = 0 THEN 'loan ' || p_type ELSE 'NCPPB ' || p_size END ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1)""")
def master_table(spark, sf_dir):
    """SCL2, SCL3-6, SCL8, SRT1, PRJ1-PRJ5, AGG1: the cleaned master table, first of each number, in numeric order"""
    given = _table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" loan  "), "p_type")).otherwise(F.concat(F.lit("ncppb no "), "p_size")).alias("Accession  Number"),
        F.concat(F.lit(" "), "p_name", F.lit(" pv. z")).alias("TAXON"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("nan").alias("pv."),
        F.when(F.col("p_partkey") % 3 == 0, " NaN ").otherwise(F.col("p_brand")).alias("Origin"),
        F.col("p_partkey").alias("at"),
    )
    done = catalogue.master(given, "at", place="place").withColumn("place", F.col("place") + 1)
    return done.select("ncppb_number", "ncppb_number_compact", "current_name", "pathovar", "country", "place")


# Files ---------------------------------------------------------------------------------------------


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, 'say "' || p_name || '", ' || chr(10) || p_brand AS quoted, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'NA' ELSE p_brand END AS stdlib_cell,
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '' ELSE p_brand END AS frame_cell, CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS place FROM part""")
def table_files(spark, sf_dir):
    """SRC2-SRC5, SNK1, SNK2, SCL11: a table written and read in both dialects of missing cells, quotes and line breaks in cells, order over files"""
    cell = F.when(F.col("p_partkey") % 3 == 1, "NA").when(F.col("p_partkey") % 3 == 2, F.col("p_brand"))
    quoted = F.concat(F.lit('say "'), "p_name", F.lit('", \n'), "p_brand")
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), quoted.alias("quoted"), cell.alias("cell"), F.col("p_partkey").alias("k"))
    path = f"{scratch(spark, 'table')}/part.tsv"
    tables.write_table(rows.repartitionByRange(3, "k").sortWithinPartitions("k"), path, ("p_partkey", "quoted", "cell"))
    plain = relational.with_places(tables.read_table(spark, path, ordinal="ord").withColumnRenamed("cell", "stdlib_cell"), ["ord"]).withColumn("place", F.col("place") + 1).drop("ord")
    return plain.join(tables.read_table(spark, path, na_tokens=True).select("p_partkey", F.col("cell").alias("frame_cell")), "p_partkey")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'say "' || o_orderpriority || '", ' || chr(10) || o_orderstatus AS quoted, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'NA' ELSE o_orderstatus END AS cell,
  CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS place FROM orders""")
def split_table_file(spark, sf_dir):
    """SRC4, SRC5: a large file with line breaks inside quotes, or more of them by the million rows, read in chunks by many tasks; rows in the order of the files"""
    cell = F.when(F.col("o_orderkey") % 3 == 1, "NA").when(F.col("o_orderkey") % 3 == 2, F.col("o_orderstatus"))
    quoted = F.concat(F.lit('say "'), "o_orderpriority", F.lit('", \n'), "o_orderstatus")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"), quoted.alias("quoted"), cell.alias("cell"))
    path = f"{scratch(spark, 'table')}/orders.csv"
    files = max(1, -(-rows.count() // ORDERS_A_FILE))  # each of several chunks; a task sorts and writes one
    tables.write_table(rows.repartitionByRange(files, "o_orderkey").sortWithinPartitions("o_orderkey"), path, ("key", "quoted", "cell"), crlf=True)
    read = read_split_table(spark, path, ordinal="ord")
    return relational.with_places(read, ["ord"]).select(F.col("key").alias("o_orderkey"), "quoted", "cell", (F.col("place") + 1).alias("place"))


@query("SELECT page_id, md5(html || chr(10)) AS page, CAST(length(html) + 1 AS BIGINT) AS n FROM pages")
def page_files(spark, sf_dir):
    """SRC1, SRC12: whole files as rows; an empty result is an error"""
    path, given = f"{scratch(spark, 'pages')}/pages", _table(spark, sf_dir, "pages")
    mark = F.when(F.col("html").isNull(), ".none").otherwise("")  # a file can't be null
    named = given.select(F.concat(F.lit("page_id="), F.coalesce(F.col("page_id").cast("string"), F.lit("")), mark).alias("name"), F.concat(F.coalesce("html", F.lit("")), F.lit("\n")).alias("value"))
    tables.write_pages(named, path, "name", "value", tasks=max(1, -(-given.count() // PAGES_A_TASK)))
    pages, value = tables.required(tables.read_pages(spark, path), "pages"), F.when(~F.col("path").endswith(".none"), F.col("value"))
    return pages.select(F.regexp_extract("path", r"page_id=(-?\d+)", 1).try_cast("long").alias("page_id"), F.md5(value).alias("page"), _long(F.char_length(value)).alias("n"))


@query("""SELECT r_name, CASE WHEN n = 0 THEN 'no customers of ' || r_name || ' found' ELSE '' || n END AS outcome FROM (
  SELECT r_name, count(c_custkey) FILTER (c_nationkey % 2 = r_regionkey % 2 AND r_regionkey <> 3) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)""")
def required_rows(spark, sf_dir):
    """SRC12: rows that must be there are counted, or the run ends in an error that names them; one run a region"""
    nations, customers = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    outcomes = []
    for region in _table(spark, sf_dir, "region").collect():  # five
        own = customers.join(nations.where(F.col("n_regionkey") == region.r_regionkey), F.col("c_nationkey") == F.col("n_nationkey")).where((F.col("c_nationkey") % 2 == region.r_regionkey % 2) & F.lit(region.r_regionkey != 3))
        try:
            outcomes.append((region.r_name, str(tables.required(own, f"customers of {region.r_name}").count())))
        except ValueError as problem:
            outcomes.append((region.r_name, str(problem)))
    return spark.createDataFrame(outcomes, "r_name string, outcome string")
