"""Identifier candidates in free text: four patterns, a rule for each match, the best of equal ones.

All of it is one projection: a text's matches, rules and merge stay in its row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accessio.functions import text as T
from accessio.schema import IDENTIFIERS

# Prefixes, words and phrases of the rules.
KNOWN_PREFIXES = (
    "ATCC", "BCCM", "CCUG", "CFBP", "CIP", "DSM", "DSMZ", "IBSP", "ICMP", "ICPB", "IMI", "ISPAVE-B", "ITCC",
    "JCM", "LMG", "NBC", "NCTC", "NIB", "NRRL", "PD", "PDDCC", "RIV", "UQM", "VKM", "WDCM", "ATTCC",
)
STOP_WORDS = (
    "A", "AN", "AND", "AS", "AT", "BY", "COLLECTION", "COLLECTIONS", "DONOR", "EX", "FOR", "FROM", "IN",
    "IS", "ISOLATE", "NO", "OF", "ON", "OR", "REFERENCE", "SOURCE", "THE", "THIS", "TO", "WAS", "WITH",
)
CONTEXT_PHRASES = (
    "donor reference", "donor ref", "reference is", "reference was", "also in the collections",
    "also in collections", "in the collections", "collection", "accession",
)
SOURCE_PHRASES = ("isolated by", "source of this isolate", "the source", "received from", "obtained from")
RANKS = {"none": 0, "reject": 1, "low": 2, "medium": 3, "high": 4}

# A match neither begins nor ends beside a letter or digit; letters match in any case. Runs are possessive
# where what follows can't be part of them, which changes no match and saves the tries at shorter runs. Letters in
# any case, by Unicode's rules, are the ASCII ones, the long s and the Kelvin sign; naming them is quicker than a flag.
_LETTER = r"A-Za-z\u017f\u212a"
_ALONE, _ENDED = f"(?<![{_LETTER}0-9])", f"(?![{_LETTER}0-9])"
_SEP = r"\s*+[-:_/.]?\s*+"
KNOWN = f"{_ALONE}((?iu:{'|'.join(sorted(KNOWN_PREFIXES, key=len, reverse=True))})){_SEP}([{_LETTER}]*+[-_/]?[0-9][{_LETTER}0-9./-]*){_ENDED}"
GENERAL = f"{_ALONE}([{_LETTER}]{{1,10}}+(?:[-/][{_LETTER}]{{1,10}}+)*+){_SEP}([0-9][{_LETTER}0-9]*+(?:[/.-][{_LETTER}0-9]++)*+){_ENDED}"
AFTER_DIGITS = f"{_ALONE}[0-9]++[/-]([{_LETTER}]{{1,10}}+)[/-]([0-9][{_LETTER}0-9.-]*){_ENDED}"
AFTER_LETTERS = f"{_ALONE}[{_LETTER}]{{1,10}}+[-/]([{_LETTER}]{{1,10}}+)[-/]?([0-9][{_LETTER}0-9.-]*){_ENDED}"
#: (pattern, known pass, marks of which a match has one)
PASSES = ((KNOWN, True, ""), (GENERAL, False, ""), (AFTER_DIGITS, False, "-/"), (AFTER_LETTERS, False, "-/"))


def normal_parts(prefix: Column, suffix: Column) -> tuple[Column, Column, Column]:
    """Prefix, suffix and the two joined, in upper case; the suffix without blanks and outer punctuation."""
    p = F.upper(T.clean(prefix))
    s = F.regexp_replace(F.btrim(F.upper(T.clean(suffix)), F.lit(".,;:")), T.SPACE, "")
    return p, s, F.trim(F.concat(p, F.lit(" "), s))


def terms_query(prefix: Column, suffix: Column) -> Column:
    """Every run of letters and digits as a term over all fields, joined by AND."""
    parts = F.concat(*[F.filter(F.split(F.upper(c), "[^A-Za-z0-9]+"), lambda x: x != "") for c in (prefix, suffix)])
    return F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit("[All Fields]"))), " AND ")


def initials_before(context: Column, prefix: Column, matched: Column) -> Column:
    """Initials, the prefix, white space and what the match has after its first blank (or all of it)."""
    at = F.instr(matched, " ")
    rest = F.when(at > 0, F.substr(matched, at + 1)).otherwise(matched)
    return F.contains(context, F.lit(".")) & F.rlike(context, F.concat(F.lit(r"(?iu)(?:\b[A-Z]\.\s*){1,4}"), T.quoted_pattern(prefix), F.lit(r"\s+"), T.quoted_pattern(rest)))


def classified(prefix: Column, raw_prefix: Column, matched: Column, context: Column, known: Column) -> Column:
    """(rule_name, confidence, include_for_search); the first rule that holds. The context is searched only by rules that come to be asked."""
    one = F.char_length(prefix) == 1
    source, about = T.contains_any(context, SOURCE_PHRASES), T.contains_any(context, CONTEXT_PHRASES)

    def result(rule: str, confidence: str, include: str = "yes") -> Column:
        return F.struct(F.lit(rule).alias("rule_name"), F.lit(confidence).alias("confidence"), F.lit(include).alias("include_for_search"))

    return (
        F.when(one & (source | about), result("source_context_single_letter_code", "low"))
        .when((prefix == "NO") & source, result("source_context_number_label", "low"))
        .when(prefix.isin(*STOP_WORDS), result("stopword_prefix", "reject", "no"))
        .when(known, result("known_collection_prefix", "high"))
        .when((F.char_length(prefix) > 1) & initials_before(context, raw_prefix, matched), result("person_or_local_reference_code", "low"))
        .when(about, result("contextual_reference_code", "medium"))
        .when(T.is_upper(raw_prefix) & ~one, result("uppercase_general_code", "medium"))
        .when(one, result("single_letter_code", "low"))
        .otherwise(result("general_code_candidate", "low"))
    )


# In a cleaned text a match has a digit in its last word, and begins two words before that at most: a prefix, and
# a mark that stands alone. Zones are such words together; between two of them stand words without digits.
_BARE, _NUMBERED = "[^ 0-9]++ ", "[^ 0-9]*+[0-9][^ ]*+"
ZONE = f"(?<![^ ])(?:{_BARE}){{0,2}}{_NUMBERED}(?: (?:{_BARE}){{0,2}}{_NUMBERED})*+"


def all_candidates(text: Column) -> Column:
    """Every match of every pass over a cleaned text, in order, as an array of structs; but none whose identifier the known pass has too, which outranks it.

    One scan of the text finds its zones; the passes look at these alone, and rules
    are asked for what is left of their matches.
    """

    def of(zones: Column, pattern: str, known: bool, marks: str) -> Column:
        able = F.filter(zones, lambda z: reduce(Column.__or__, [F.contains(z["text"], F.lit(m)) for m in marks])) if marks else zones

        def shifted(z: Column) -> Column:
            return F.transform(T.matches(z["text"], pattern, 2), lambda m: F.struct(m["text"].alias("raw"), m["g1"].alias("g1"), m["g2"].alias("g2"), (z["start"] + m["start"]).alias("start"), (z["start"] + m["end"]).alias("end"), F.lit(known).alias("known")))

        return F.flatten(F.transform(able, shifted))

    # one transform after another: a lambda's variable is a value, so nothing is computed twice
    def with_parts(m: Column, i: Column) -> Column:
        prefix, suffix, whole = normal_parts(m["g1"], m["g2"])
        return F.struct(whole.alias("normalized_identifier"), i.alias("i"), prefix.alias("prefix"), suffix.alias("suffix"), *[m[c].alias(c) for c in ("start", "end", "known", "raw", "g1")])

    def outranked(every: Column) -> Column:
        names = F.transform(F.filter(every, lambda m: m["known"]), lambda m: m["normalized_identifier"])
        return T.once(names, lambda known: F.filter(every, lambda m: m["known"] | ~F.array_contains(known, m["normalized_identifier"])))

    def with_context(m: Column) -> Column:
        return F.struct(*[m[c].alias(c) for c in ("normalized_identifier", "i", "prefix", "suffix", "known", "raw", "g1")], T.context(text, m["start"], m["end"]).alias("context"))

    def with_rule(m: Column) -> Column:
        rule = classified(m["prefix"], m["g1"], m["raw"], m["context"], m["known"])
        return F.struct(m["normalized_identifier"].alias("normalized_identifier"), m["i"].alias("i"), T.clean(m["raw"]).alias("matched_text"), *[m[c].alias(c) for c in ("prefix", "suffix", "context", "known")], rule.alias("rule"))

    every = T.once(T.matches(text, ZONE), lambda zones: F.concat(*[of(zones, *x) for x in PASSES]))
    left = T.once(F.transform(every, with_parts), outranked)
    return F.transform(F.transform(left, with_context), with_rule)


def _rank(c: Column) -> Column:
    ranks = F.create_map(*[x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(ranks, c["rule"]["confidence"]), F.lit(0))


def best_of_equal(df: DataFrame, candidates: str, out: str) -> DataFrame:
    """One candidate an identifier: the highest confidence, of those the first (of the known pass the last); in order of first sight.

    Two sorts by identifier instead of a search for each: n log n in a long text.
    The sorted arrays are columns of their own, so that the look at the element
    before does not sort again.
    """

    def firsts(name: str) -> Column:
        return F.filter(name, lambda c, i: (i == 0) | (F.get(F.col(name), i - 1)["normalized_identifier"] != c["normalized_identifier"]))

    by_rank = F.array_sort(F.transform(candidates, lambda c: F.struct(c["normalized_identifier"].alias("normalized_identifier"), (-_rank(c)).alias("r"), F.when(c["known"], -c["i"]).otherwise(c["i"]).alias("o"), c.alias("c"))))
    by_place = F.array_sort(F.transform(candidates, lambda c: F.struct(c["normalized_identifier"].alias("normalized_identifier"), c["i"].alias("i"))))
    merged = F.zip_with(firsts("__by_place"), firsts("__by_rank"), lambda p, b: F.struct(p["i"].alias("i"), b["c"].alias("c")))
    return df.withColumns({"__by_rank": by_rank, "__by_place": by_place}).withColumn(out, F.transform(F.array_sort(merged), lambda m: m["c"])).drop("__by_rank", "__by_place")


def extract_identifiers(rows: DataFrame, key: str = "ncppb_number", text: str = "other_references", keep_empty: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """The identifier table of (key, text) rows, plus carried columns and `place`, the candidate's place in its text.

    keep_empty: a text without candidates gives one row of rule no_identifier_found.
    """
    cleaned = rows.select(T.clean(key).alias("ncppb_number"), T.clean(text).alias("other_references"), *carry)
    sets = cleaned.withColumn("every", all_candidates(F.col("other_references")))
    merged = best_of_equal(sets, "every", "best")
    # an inner explode would have its size test pushed below, where the matches would be found once more
    flat = merged.select("ncppb_number", "other_references", *carry, F.posexplode_outer("best").alias("place", "c"))
    flat = flat if keep_empty else flat.where("c IS NOT NULL")
    include = F.col("c.rule.include_for_search")
    values = {
        "matched_text": F.col("c.matched_text"),
        "normalized_identifier": F.col("c.normalized_identifier"),
        "prefix": F.col("c.prefix"),
        "suffix": F.col("c.suffix"),
        "rule_name": F.coalesce("c.rule.rule_name", F.lit("no_identifier_found")),
        "confidence": F.coalesce("c.rule.confidence", F.lit("none")),
        "include_for_search": F.coalesce(include, F.lit("no")),
        "biosample_query": F.when(include == "yes", terms_query(F.col("c.prefix"), F.col("c.suffix"))),
        "context": F.col("c.context"),
    }
    return flat.select(
        *[(F.coalesce(values[c], F.lit("")).alias(c) if c in values else F.col(c)) for c in IDENTIFIERS],
        *carry,
        F.coalesce("place", F.lit(0)).alias("place"),
    )
