"""Scalar functions against plain Python, on awkward strings."""

import re

import pytest
from pyspark.sql import functions as F

from accessio.functions import html as H
from accessio.functions import text as T

AWKWARD = ["", " ", "a\xa0b", "\x85x\x1cy\x1f", "  a \t\n b ", "NCPPB 0045", "ncppb45 and 46", "é ß", "x" * 300, "nan", " NaN ", "no digits", "ſ K 7", None]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def py_clean(v):
    return " ".join((v or "").split())


def test_clean(spark):
    assert column(spark, AWKWARD, T.clean) == [py_clean(v) for v in AWKWARD]
    assert column(spark, AWKWARD, lambda c: T.clean(T.clean(c))) == [py_clean(v) for v in AWKWARD]


def test_clean_cell(spark):
    assert column(spark, AWKWARD, T.clean_cell) == ["" if py_clean(v).lower() == "nan" else py_clean(v) for v in AWKWARD]


def test_numbers(spark):
    def standard(v):
        m = re.search(r"\d+", v or "")
        return f"NCPPB {m[0]}" if m else py_clean(v)

    assert column(spark, AWKWARD, T.standard_number) == [standard(v) for v in AWKWARD]
    assert column(spark, ["a12b3", "", None], T.all_digits) == ["123", "", ""]
    assert column(spark, ["000", "0045", "7"], T.without_leading_zeros) == ["0", "45", "7"]


@pytest.mark.parametrize(
    ("text", "found"),
    [("NCPPB 0045 x", ["45"]), ("NCPPB:45, ncppb-7 NCPPB No. 9", ["45", "7", "9"]), ("NCPPB 123456", []), ("NCPPB/45 NCPPB.45", []), ("NCPPB 45 NCPPB 45", ["45"]), ("NCPPB number 3", ["3"])],
)
def test_found_numbers(spark, text, found):
    assert column(spark, [text], T.found_numbers) == [found]


def test_pathovar_and_collections(spark):
    assert column(spark, ["X. campestris pv. citri", "X pv citri", "X PV. citri", ""], T.pathovar) == ["pv. citri", "pv. citri", "", ""]
    assert column(spark, ["icmp 204, LMG-673; icmp 204, DSMZ:9"], T.collection_numbers) == ["ICMP 204; LMG-673; DSMZ:9"]


def test_split_multi(spark):
    assert column(spark, ["a; b|c ;; ", "nan", None, " x "], T.split_multi) == [["a", "b", "c"], [], [], ["x"]]


def test_matches_have_exact_offsets(spark):
    texts = ["ab12 b1 12", "é1 漢字b2", "", "b1b2b3"]
    pattern = "(b)([0-9])"
    got = column(spark, texts, lambda c: T.matches(c, pattern, 2))
    want = [[(m.start(), m.end(), m[0], m[1], m[2]) for m in re.finditer(pattern, t)] for t in texts]
    assert [[tuple(x) for x in row] for row in got] == want


def test_html(spark):
    assert column(spark, ["a<br/>b<b>c</b>&amp;lt;"], lambda c: H.unescape(H.without_tags(c))) == ["a bc&lt;"]
    assert column(spark, ["&eacute;&#x41;"], H.unescape) == ["éA"]
    hrefs = ["/x", "y?z=1", "http://q/r", "//h/p", ""]
    assert column(spark, hrefs, lambda c: H.absolute(c, "https://e.org/")) == [H.joined_url("https://e.org/", h) for h in hrefs]
