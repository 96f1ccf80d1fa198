"""Scalar text functions, Column to Column, all evaluated in the JVM.

`(?U)` makes character classes Unicode ones; white space then also has the
no-break space and the four separators U+001C to U+001F.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Fixed value: the catalogue whose numbers are standardised.
CATALOGUE = "NCPPB"
#: Fixed value: a collection number of other catalogues inside a text.
COLLECTION_NUMBER = r"(?iu)\b(?:ATCC|BCCM|CCUG|CFBP|CIP|DSMZ?|ICMP|JCM|LMG|NCTC|NIB|NRRL|PDDCC|PD|RIV|UQM|VKM|WDCM)\s*[-:]?\s*[A-Z]*\d+[A-Z0-9.-]*\b"
FOUND_NUMBER = r"(?iu)\bNCPPB(?:\s*(?:No\.?|Number|#|:|-|_))?\s*0*(\d{1,5})(?!\d)"


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def clean(c: Column | str) -> Column:
    """White space runs become one blank, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(text(c), SPACE, " "))


def clean_cell(c: Column | str) -> Column:
    """clean, and the word nan (in any case) becomes empty."""
    done = clean(c)
    return F.when(F.lower(done) == "nan", "").otherwise(done)


def first_digits(c: Column | str) -> Column:
    return F.regexp_extract(text(c), r"(?U)(\d+)", 1)


def all_digits(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"(?U)[^\d]", "")


def standard_number(c: Column | str) -> Column:
    """The catalogue's name and the first run of digits; without digits the cleaned text."""
    digits = first_digits(c)
    return F.when(digits != "", F.concat(F.lit(CATALOGUE + " "), digits)).otherwise(clean(c))


def compact(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(text(c)), SPACE, "")


def pathovar(c: Column | str) -> Column:
    found = F.regexp_extract(text(c), r"(?U)\bpv\.?\s+([A-Za-z0-9_.-]+)", 1)
    return F.when(found != "", F.concat(F.lit("pv. "), found)).otherwise("")


def collection_numbers(*texts: Column | str) -> Column:
    """Collection numbers in the texts, cleaned, in upper case, each once in order, joined by '; '."""
    found = F.concat(*[F.regexp_extract_all(text(t), F.lit(COLLECTION_NUMBER), F.lit(0)) for t in texts])
    return F.array_join(F.array_distinct(F.transform(found, lambda m: F.upper(clean(m)))), "; ")


def split_multi(c: Column | str) -> Column:
    """Values of a multi-valued cell: cut at ; and |, trimmed, blanks dropped. The word nan is no value."""
    whole = F.trim(F.regexp_replace(text(c), r"^(?U)[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    parts = F.transform(F.split(F.replace(whole, F.lit("|"), F.lit(";")), ";"), lambda p: F.regexp_replace(p, r"^(?U)[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.filter(parts, lambda p: (p != "") & (F.lower(whole) != "nan"))


def without_leading_zeros(c: Column) -> Column:
    return F.coalesce(F.nullif(F.ltrim(c, F.lit("0")), F.lit("")), F.lit("0"))


def found_numbers(c: Column | str) -> Column:
    """Catalogue numbers named in a text, without leading zeros, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(FOUND_NUMBER), F.lit(1)), without_leading_zeros))


def first_filled(*choices: Column) -> Column:
    """The first choice that is neither null nor empty; else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def is_upper(c: Column) -> Column:
    """Has a letter with case and none in lower case."""
    return (c == F.upper(c)) & (c != F.lower(c))


def quoted_pattern(c: Column) -> Column:
    r"""A pattern that matches the text itself: \Q...\E, safe for a text with \E in it."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def folded(c: Column) -> Column:
    """Lower case; the letters that Unicode's rules take for s, k and i become these."""
    return F.lower(F.translate(c, "\u017f\u212a\u0131\u0130", "skii"))


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    """The text has one of the phrases (small ASCII letters), in any case."""
    return once(folded(c), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in phrases]))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed a single time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def matches(c: Column, pattern: str, groups: int = 0) -> Column:
    """All matches as an array of (start, end, text, g1 ..): code points, end exclusive.

    A text costs one pass for its matches and, if it has any, one for the pieces
    between them, whose lengths give the offsets. Groups come from each match's
    own text, so a pattern may look around itself only for what is absent: an end
    of text must satisfy it as well.
    """
    kind = "".join(f",g{g}:string" for g in range(1, groups + 1))
    none = F.from_json(F.lit("[]"), f"array<struct<start:int,end:int,text:string{kind}>>")

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["piece"])
        end = start + F.char_length(m["whole"])
        parts = [F.regexp_extract(m["whole"], pattern, g).alias(f"g{g}") for g in range(1, groups + 1)]
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), m["whole"].alias("text"), *parts)).alias("out"))

    def walked(whole: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        pairs = F.zip_with(F.slice(F.split(c, pattern, -1), 1, F.size(whole)), whole, lambda p, w: F.struct(p.alias("piece"), w.alias("whole")))
        return F.when(F.size(whole) > 0, F.aggregate(pairs, begin, step, lambda acc: acc["out"])).otherwise(none)

    return once(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), walked)


def context(c: Column, start: Column, end: Column, radius: int = 80) -> Column:
    """The text around a span, clamped to the text and cleaned."""
    low = F.greatest(start - radius, F.lit(0))
    return clean(F.substr(c, low + 1, end + radius - low))
