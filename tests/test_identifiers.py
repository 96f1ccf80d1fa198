"""Identifier candidates: the published first rows, one text a rule, merging and order."""

import pytest

from accessio.operators import identifiers
from accessio.operators.identifiers import extract_identifiers
from accessio.schema import IDENTIFIERS

COLLECTIONS = "This isolate is also in the collections; "
GOLDEN = {
    "NCPPB 45": ("This isolate was isolated by W.J. Dowson", []),
    "NCPPB 101": (COLLECTIONS + "ICMP 204, LMG 673, DSM 18958", [("ICMP 204", "known_collection_prefix", "high"), ("LMG 673", "known_collection_prefix", "high"), ("DSM 18958", "known_collection_prefix", "high")]),
    "NCPPB 109": ("", []),
    "NCPPB 182": (COLLECTIONS + "ATCC 13901, ICMP 305, LMG 896 The source of this isolate was ex M.T. Cook", [("ATCC 13901", "known_collection_prefix", "high"), ("ICMP 305", "known_collection_prefix", "high"), ("LMG 896", "known_collection_prefix", "high")]),
    "NCPPB 184": (COLLECTIONS + "ATCC 13902, ICPB XV101", [("ATCC 13902", "known_collection_prefix", "high"), ("ICPB XV101", "known_collection_prefix", "high"), ("XV 101", "contextual_reference_code", "medium")]),
    "NCPPB 206": (COLLECTIONS + "ICMP 326, LMG 8284, CFBP 7162", [("ICMP 326", "known_collection_prefix", "high"), ("LMG 8284", "known_collection_prefix", "high"), ("CFBP 7162", "known_collection_prefix", "high")]),
    "NCPPB 208": ("This isolate was isolated by G. Orian PC5", [("PC 5", "uppercase_general_code", "medium")]),
    "NCPPB 273": ("The source of this isolate was ex A.C. Brown B67", [("B 67", "source_context_single_letter_code", "low")]),
}


def run(spark, texts, **how):
    df = spark.createDataFrame([(k, t) for k, t in texts], "ncppb_number string, other_references string")
    return extract_identifiers(df, **how).orderBy("ncppb_number", "place").collect()


def test_golden(spark):
    rows = run(spark, [(k, t) for k, (t, _) in GOLDEN.items()])
    for key, (text, want) in GOLDEN.items():
        got = [r for r in rows if r.ncppb_number == key]
        if want:
            assert [(r.normalized_identifier, r.rule_name, r.confidence) for r in got] == want
            assert all(r.include_for_search == "yes" and r.other_references == text for r in got)
        else:
            assert [(r.rule_name, r.confidence, r.include_for_search, r.matched_text) for r in got] == [("no_identifier_found", "none", "no", "")]
    one = next(r for r in rows if r.normalized_identifier == "XV 101")
    assert one.biosample_query == "XV[All Fields] AND 101[All Fields]" and one.matched_text == "XV101"
    assert list(one.asDict())[: len(IDENTIFIERS)] == list(IDENTIFIERS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("isolated by X. A 12", ("A 12", "source_context_single_letter_code", "low", "yes")),
        ("isolated by J. Smith No 12", ("NO 12", "source_context_number_label", "low", "yes")),
        ("this AND 12 that", ("AND 12", "stopword_prefix", "reject", "no")),
        ("of NBC5720", ("NBC 5720", "known_collection_prefix", "high", "yes")),
        ("by G. Orian 12", ("ORIAN 12", "person_or_local_reference_code", "low", "yes")),
        ("accession Xyz 12", ("XYZ 12", "contextual_reference_code", "medium", "yes")),
        ("see XS52/5", ("XS 52/5", "uppercase_general_code", "medium", "yes")),
        ("see q 12", ("Q 12", "single_letter_code", "low", "yes")),
        ("see Xyz-12", ("XYZ 12", "general_code_candidate", "low", "yes")),
    ],
)
def test_rules(spark, text, want):
    first = run(spark, [("1", text)])[0]
    assert (first.normalized_identifier, first.rule_name, first.confidence, first.include_for_search) == want


def test_separators_and_embedded(spark):
    for text in ("LMG-673", "LMG 673", "LMG:673", "LMG_673", "LMG.673", "LMG/673", "LMG673"):
        assert run(spark, [("1", text)])[0].normalized_identifier == "LMG 673"
    assert "ABC 12" in [r.normalized_identifier for r in run(spark, [("1", "77/ABC/12")])]
    assert "CD 5" in [r.normalized_identifier for r in run(spark, [("1", "Ab-CD-5")])]


def test_merge_keeps_best_and_first_place(spark):
    rows = run(spark, [("1", "xyz 5; accession XYZ 5 then ICMP 7")])
    assert [r.normalized_identifier for r in rows] == ["ICMP 7", "XYZ 5"]
    assert rows[1].confidence == "medium"


def test_empty_rows_switch_and_partitions(spark):
    assert run(spark, [("1", ""), ("2", None)], keep_empty=False) == []
    texts = [(str(i), f"ICMP {i % 7}, q {i}") for i in range(40)]
    df = spark.createDataFrame(texts, "ncppb_number string, other_references string")
    a = sorted(map(tuple, extract_identifiers(df.repartition(1)).collect()))
    b = sorted(map(tuple, extract_identifiers(df.repartition(7)).collect()))
    assert a == b


def test_zones_hold_all_matches(spark, monkeypatch):
    """The passes over zones find what they find over whole texts."""
    import random

    r = random.Random(7)
    parts = ["ICMP", "LMG", "icmp", "ISPAVE-B", "B", "no", "the", "source", "of", "Brown", "A.", "-", ":", "_", "/", ".", ",", ";", "(", ")", "12", "7", "0034", "5a", "ſ", "é", "x1y", "1/ab/2", "ab-cd-3", " ", " ", " ", " ", "  "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(1500)]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "ncppb_number string, other_references string").cache()
    by_zone = sorted(map(tuple, identifiers.extract_identifiers(rows).collect()))
    monkeypatch.setattr(identifiers, "ZONE", "(?s).+")
    assert sorted(map(tuple, identifiers.extract_identifiers(rows).collect())) == by_zone
    assert sum(x[2] != "" for x in by_zone) > 1500
    rows.unpersist()
