"""Evidence: which of a strain's identifiers a record names, and what follows from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessio.functions import text as T
from accessio.schema import EVIDENCE

# Scores and the genus in question.
SCORES = {"high": 90, "medium": 60, "low": 40, "none": 0, "reject": 0}
GENUS = r"(?iu)\bXanthomonas\b"
_JOINT = r"\s*[:_./-]?\s*"
_FIELDS = ("evidence_level", "evidence_decision", "evidence_class", "evidence_score", "matched_identifier", "matched_identifier_type", "identifier_rule_name", "identifier_confidence", "reject_reason")


def number_pattern(digits: Column) -> Column:
    return F.concat(F.lit(r"(?iu)\bNCPPB(?:\s*(?:No\.?|Number|#|:|-|_))?\s*0*"), digits, F.lit(r"(?!\d)"))


def identifier_pattern(identifier: Column) -> Column:
    """A pattern for an identifier of a letter prefix and a suffix, with any separators; null for others."""
    whole = F.upper(T.clean(identifier))
    shape = r"^([A-Z]{1,12}(?:[-/][A-Z]{1,12})*)\s+(.+)$"
    parts = [F.filter(F.split(F.regexp_extract(whole, shape, g), "[^A-Z0-9]+"), lambda x: x != "") for g in (1, 2)]
    body = F.concat(F.array_join(parts[0], _JOINT), F.lit(_JOINT), F.array_join(parts[1], _JOINT))
    fits = whole.rlike(shape) & (F.size(parts[0]) > 0) & (F.size(parts[1]) > 0)
    return F.when(fits, F.concat(F.lit("(?iu)(?<![A-Za-z0-9])"), body, F.lit("(?![A-Za-z0-9])")))


def _bare(digits: Column) -> Column:
    return T.without_leading_zeros(digits)


def digit_tokens(text: Column) -> Column:
    """The numbers of a text, without leading zeros, each once; and the empty token, which every text has."""
    return F.array_distinct(F.array_append(F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), _bare), ""))


def number_keys(digits: Column) -> Column:
    return F.array(F.when(digits.rlike("^[0-9]+$"), _bare(digits)).otherwise(""))


def identifier_keys(identifier: Column) -> Column:
    """Tokens of which a text has one at least if it matches identifier_pattern; the empty one for identifiers without digits.

    Of the first digits, with any separators between them, a text may have the parts
    glued: its number that begins there is the first part, or the first two joined, and so on.
    """
    digits = F.split(F.regexp_extract(F.upper(T.clean(identifier)), "[0-9]+(?:[^A-Z0-9]+[0-9]+)*", 0), "[^0-9]+")
    return F.array_distinct(F.transform(digits, lambda x, i: F.when(x == "", "").otherwise(_bare(F.array_join(F.slice(digits, 1, i + 1), "")))))


def score(kind: Column, rule: Column, confidence: Column) -> Column:
    table = F.create_map(*[x for k, v in SCORES.items() for x in (F.lit(k), F.lit(v))])
    return F.when(kind == "ncppb_number", 100).when(rule == "known_collection_prefix", 90).otherwise(F.coalesce(F.try_element_at(table, confidence), F.lit(30)))


def _pattern(ord_: Column, value: Column, kind: str, pattern: Column, keys: Column, rule: Column, confidence: Column) -> Column:
    parts = {"ord": ord_, "value": value, "identifier_type": F.lit(kind), "pattern": pattern, "keys": keys, "rule_name": rule, "confidence": confidence, "score": score(F.lit(kind), rule, confidence)}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _own_pattern(digits: Column, at: Column) -> Column:
    """The pattern of a strain's own number."""
    place = F.struct(F.lit(0).alias("branch"), at.alias("at"))
    return _pattern(place, F.concat(F.lit("NCPPB "), digits), "ncppb_number", number_pattern(digits), number_keys(digits), F.lit("ncppb_number"), F.lit("high"))


def pattern_index(identifiers: DataFrame, order: str, with_number: bool = True) -> DataFrame:
    """ncppb_number, token, p: the patterns of build_patterns as rows, one for each token that a text must have one of.

    An inverted index: no strain's patterns are ever gathered, however many it has.
    """
    strain, value, digits = F.col("ncppb_number"), F.col("value"), T.first_digits("ncppb_number")
    rows = identifiers.select(
        T.clean("ncppb_number").alias("ncppb_number"), F.upper(T.clean("normalized_identifier")).alias("value"), identifier_pattern(F.col("normalized_identifier")).alias("pattern"),
        identifier_keys(F.col("normalized_identifier")).alias("keys"), (F.lower(T.clean("include_for_search")) == "yes").alias("included"), *[T.clean(c).alias(c) for c in ("rule_name", "confidence")], F.col(order).alias("at"),
    )
    place = F.struct(F.lit(1).alias("branch"), F.col("at").alias("at"))
    named = F.lit(with_number) & (digits != "")
    wanted = F.col("included") & (strain != "") & F.col("pattern").isNotNull() & ~(named & (value == F.concat(F.lit("NCPPB "), digits)))
    other = F.when(wanted, _pattern(place, value, "other_reference_identifier", F.col("pattern"), F.col("keys"), F.col("rule_name"), F.col("confidence")))
    offered = rows.select("ncppb_number", F.explode(F.array(F.when(named, _own_pattern(digits, F.col("at"))), other)).alias("p")).where("p IS NOT NULL")
    once = offered.groupBy("ncppb_number", F.col("p.value").alias("value"), F.col("p.identifier_type").alias("kind")).agg(F.min_by("p", "p.ord").alias("p"))
    return once.select("ncppb_number", F.explode("p.keys").alias("token"), "p")


def pattern_candidates(texts: DataFrame, index: DataFrame) -> DataFrame:
    """texts (ncppb_number, text, ..) with each pattern p of their strain that they have a token of: joined by strain and token."""
    tokens = texts.withColumn("token", F.explode(digit_tokens(F.col("text"))))
    return tokens.join(index, ["ncppb_number", "token"])


def build_patterns(identifiers: DataFrame, order: str, with_number: bool = True) -> DataFrame:
    """ncppb_number, patterns: each strain's patterns in order, the strain's own number first; equal values once.

    One pass over the identifiers: equal values of a strain meet first, so a strain
    gathers different ones alone; its own number's pattern is made of its key.
    """
    strain, value = T.clean("ncppb_number"), F.upper(T.clean("normalized_identifier"))
    pattern, keys = identifier_pattern(F.col("normalized_identifier")), identifier_keys(F.col("normalized_identifier"))
    rule, confidence = T.clean("rule_name"), T.clean("confidence")
    digits = T.first_digits("ncppb_number")
    rows = identifiers.select(strain.alias("ncppb_number"), (F.lower(T.clean("include_for_search")) == "yes").alias("included"), value.alias("value"), pattern.alias("pattern"), keys.alias("keys"), rule.alias("rule"), confidence.alias("confidence"), F.col(order).alias("at"))
    # rows that offer no pattern of their own still tell of their strain
    rows = rows.withColumn("value", F.when(F.col("included") & (F.col("ncppb_number") != "") & F.col("pattern").isNotNull(), F.col("value")))
    place = F.struct(F.lit(1).alias("branch"), F.col("at").alias("at"))
    other = F.when(F.col("value").isNotNull(), _pattern(place, F.col("value"), "other_reference_identifier", F.col("pattern"), F.col("keys"), F.col("rule"), F.col("confidence")))
    once = rows.groupBy("ncppb_number", "value").agg(F.min_by(other, F.col("at")).alias("other"), F.min("at").alias("at"))
    name = F.concat(F.lit("NCPPB "), digits)
    others = F.array_sort(F.collect_list("other"))
    strains = once.groupBy("ncppb_number").agg(others.alias("others"), F.min("at").alias("at"))
    own = _own_pattern(digits, F.col("at"))
    every = F.when(digits != "", F.concat(F.array(own), F.filter("others", lambda x: x["value"] != name))).otherwise(F.col("others")) if with_number else F.col("others")
    return strains.select("ncppb_number", every.alias("patterns")).where(F.size("patterns") > 0)


def metadata_text(rows: DataFrame) -> Column:
    """The record's text, or its fields joined."""
    have = set(rows.columns)
    parts = [T.text(c) if c in have else F.lit("") for c in ("title", "organism", "identifiers", "infraspecies", "attributes")]
    return T.first_filled(T.clean("metadata_text") if "metadata_text" in have else F.lit(""), T.clean(F.concat_ws(" ", *parts)))


def best_identifier(patterns: Column, text: Column) -> Column:
    """Of the patterns that the text matches the one of highest score, of those the first; null if none matches.

    A pattern is tried only if the text has one of its tokens.
    """
    found = T.once(digit_tokens(text), lambda tokens: F.filter(patterns, lambda p: F.arrays_overlap(p["keys"], tokens) & F.rlike(text, p["pattern"])))
    ranked = F.transform(found, lambda p, i: F.struct((-p["score"]).alias("s"), i.alias("i"), p.alias("p")))
    return F.array_min(ranked)["p"]


def evidence_of(status: Column, organism: Column, number: Column, text: Column, best: Column) -> Column:
    """The evidence struct; the first case that holds. best: best_identifier(...)"""
    expected = T.first_digits(number)
    conflicts = F.array_sort(F.array_except(T.found_numbers(text), F.array(expected)))
    known = best["value"].isNotNull()
    strong = (best["identifier_type"] == "ncppb_number") | (best["rule_name"] == "known_collection_prefix")
    genus = organism.rlike(GENUS)
    foreign = (organism != "") & ~genus

    def case(level: str, decision: str, kind: str, points, reason, named: bool) -> Column:
        points = F.lit(points) if isinstance(points, int) else points
        empty = F.lit("")
        about = [F.coalesce(best[c], empty) if named else empty for c in ("value", "identifier_type", "rule_name", "confidence")]
        values = [F.lit(level), F.lit(decision), F.lit(kind), points.cast("int"), *about, F.lit(reason) if isinstance(reason, str) else reason]
        return F.struct(*[v.alias(n) for n, v in zip(_FIELDS, values, strict=True)])

    points = F.coalesce(best["score"], F.lit(0))
    clash = F.concat(F.lit("conflicting_ncppb_number:"), F.array_join(conflicts, ";"))
    return (
        F.when(status == "no_hit", case("no_public_data_found", "no_data", "no_biosample_candidate", 0, "query_returned_no_biosample_records", False))
        .when(status != "ok", case("ambiguous", "review", "review_query_error", 0, "query_error", False))
        .when(F.size(conflicts) > 0, case("ambiguous", "reject", "reject_conflicting_identifier", points, clash, True))
        .when(foreign & known & strong, case("probable_strain_match", "review", "review_strong_identifier_non_target_organism", points, "strong_identifier_match_non_xanthomonas_organism", True))
        .when(foreign & known, case("ambiguous", "reject", "reject_weak_identifier_non_target_organism", points, "weak_identifier_match_non_xanthomonas_organism", True))
        .when(foreign, case("ambiguous", "reject", "reject_non_target_taxon", 0, "non_xanthomonas_organism", False))
        .when(best["identifier_type"] == "ncppb_number", case("strong_strain_match", "accept", "confirmed_ncppb_identifier", points, "", True))
        .when(best["rule_name"] == "known_collection_prefix", case("strong_strain_match", "accept", "confirmed_equivalent_collection_identifier", points, "", True))
        .when(known, case("probable_strain_match", "review", "review_local_or_donor_identifier_only", points, "local_or_donor_identifier_requires_manual_review", True))
        .when(genus, case("taxon_level_only", "review", "review_taxon_only", 20, "no_exact_strain_identifier_match", False))
        .otherwise(case("ambiguous", "review", "review_no_organism_or_strain_identifier", 0, "no_organism_or_strain_identifier", False))
    )


def _staged(rows: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    have = set(rows.columns)
    cell = lambda c: T.clean(c) if c in have else F.lit("")
    return rows.select("*", T.clean("ncppb_number").alias("__key"), metadata_text(rows).alias("__text"), cell("status").alias("__status"), cell("organism").alias("__organism")), cell


def _evidence_rows(judged: DataFrame, cell: Callable[[str], Column], carry: tuple[str, ...]) -> DataFrame:
    """The evidence table of staged rows with their best identifier."""
    judged = judged.withColumn("__evidence", evidence_of(F.col("__status"), F.col("__organism"), F.col("__key"), F.col("__text"), F.col("__best")))
    out = {f: F.col(f"__evidence.{f}") for f in _FIELDS} | {"evidence_score": F.col("__evidence.evidence_score").cast("string"), "metadata_text": F.col("__text")}
    return judged.select(*[out.get(c, cell(c)).alias(c) for c in EVIDENCE], *carry)


def classify_rows(rows: DataFrame, patterns: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The evidence table of raw rows; each row tries its own strain's patterns alone.

    The join is by strain, so Spark may broadcast the patterns where they are small
    and splits a strain with very many rows by its skew join. A strain's patterns
    come as one array; for strains with very many, see classify_indexed.
    """
    staged, cell = _staged(rows)
    joined = staged.join(patterns.withColumnRenamed("ncppb_number", "__key"), "__key", "left")
    # patterns are tried for rows that have a record only
    best = F.when(F.col("__status") == "ok", best_identifier(F.col("patterns"), F.col("__text")))
    return _evidence_rows(joined.withColumn("__best", best), cell, carry)


def classify_indexed(rows: DataFrame, index: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """classify_rows by a pattern_index: patterns meet the texts that have one of their tokens, by a join on strain and token.

    What a text's best identifier is depends on strain and text alone, so equal
    texts of a strain are matched once, whatever rows they stand in.
    """
    staged, cell = _staged(rows)
    staged = staged.withColumn("__digest", F.md5("__text"))
    texts = staged.where("__status = 'ok'").groupBy(F.col("__key").alias("ncppb_number"), "__digest").agg(F.first("__text").alias("text"))
    found = pattern_candidates(texts, index).where(F.rlike("text", F.col("p.pattern")))
    best = found.groupBy(F.col("ncppb_number").alias("__key"), "__digest").agg(F.min_by("p", F.struct(-F.col("p.score"), "p.ord")).alias("__found"))
    judged = staged.join(best, ["__key", "__digest"], "left").withColumn("__best", F.when(F.col("__status") == "ok", F.col("__found")))
    return _evidence_rows(judged, cell, carry)
