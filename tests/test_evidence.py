"""One record for each case of the evidence tree, and the order of the cases."""

import pytest

from accessio.operators import evidence, report
from accessio.plans import catalogue_queries as plans
from accessio.schema import EVIDENCE

IDS = [
    (0, "NCPPB 45", "ICMP 204", "known_collection_prefix", "high", "yes"),
    (1, "NCPPB 45", "PC 5", "uppercase_general_code", "medium", "yes"),
    (2, "NCPPB 45", "AND 12", "stopword_prefix", "reject", "no"),
    (3, "NCPPB 45", "ICMP 204", "general_code_candidate", "low", "yes"),
]


def classify(spark, records, with_number=True):
    ids = spark.createDataFrame(IDS, "ord int, ncppb_number string, normalized_identifier string, rule_name string, confidence string, include_for_search string")
    patterns = evidence.build_patterns(ids, "ord", with_number)
    raw = spark.createDataFrame(records, "ncppb_number string, status string, organism string, metadata_text string, title string")
    return evidence.classify_rows(raw, patterns)


X, P = "Xanthomonas citri", "Pseudomonas"
CASES = [
    (("no_hit", X, "NCPPB 45"), ("no_data", "no_biosample_candidate", "0", "")),
    (("error", X, "NCPPB 45"), ("review", "review_query_error", "0", "")),
    (("", X, "NCPPB 45"), ("review", "review_query_error", "0", "")),
    (("ok", X, "NCPPB 45 and NCPPB 46"), ("reject", "reject_conflicting_identifier", "100", "NCPPB 45")),
    (("ok", P, "strain ICMP 204"), ("review", "review_strong_identifier_non_target_organism", "90", "ICMP 204")),
    (("ok", P, "strain PC-5"), ("reject", "reject_weak_identifier_non_target_organism", "60", "PC 5")),
    (("ok", P, "nothing"), ("reject", "reject_non_target_taxon", "0", "")),
    (("ok", X, "NCPPB No. 045; ICMP 204"), ("accept", "confirmed_ncppb_identifier", "100", "NCPPB 45")),
    (("ok", "", "ICMP:204"), ("accept", "confirmed_equivalent_collection_identifier", "90", "ICMP 204")),
    (("ok", X, "PC 5"), ("review", "review_local_or_donor_identifier_only", "60", "PC 5")),
    (("ok", X, "nothing"), ("review", "review_taxon_only", "20", "")),
    (("ok", "", "AND 12, XICMP 204, ICMP 2045"), ("review", "review_no_organism_or_strain_identifier", "0", "")),
]


def test_cases(spark):
    rows = classify(spark, [("NCPPB 45", *given, str(i)) for i, (given, _) in enumerate(CASES)]).collect()
    got = {r.title: (r.evidence_decision, r.evidence_class, r.evidence_score, r.matched_identifier) for r in rows}
    for i, (given, want) in enumerate(CASES):
        assert got[str(i)] == want, given
    assert rows[0].asDict().keys() == dict.fromkeys(EVIDENCE).keys()
    conflict = next(r for r in rows if r.evidence_class == "reject_conflicting_identifier")
    assert conflict.reject_reason == "conflicting_ncppb_number:46"


def test_padded_number_conflicts_with_itself(spark):
    row = classify(spark, [("NCPPB 045", "ok", X, "NCPPB 045", "")]).first()
    assert row.evidence_class == "reject_conflicting_identifier"


def test_text_from_fields_and_without_number(spark):
    row = classify(spark, [("NCPPB 45", "ok", X, "", "ICMP 204 isolate")]).first()
    assert row.metadata_text == f"ICMP 204 isolate {X}" and row.evidence_decision == "accept"
    assert classify(spark, [("NCPPB 45", "ok", X, "NCPPB 45", "")], with_number=False).first().evidence_class == "review_taxon_only"


@pytest.mark.parametrize("text", ["NCPPB45", "ncppb#45", "NCPPB-45", "NCPPB number 45", "NCPPB_45"])
def test_number_separators(spark, text):
    assert classify(spark, [("NCPPB 45", "ok", X, text, "")]).first().evidence_score == "100"


def test_split_covers_all(spark):
    rows = classify(spark, [("NCPPB 45", *given, "") for given, _ in CASES])
    tally = report.rollup_counts(rows, "evidence_decision", "evidence_class")
    assert tally.where("level = 3").first().n == len(CASES)


# Class and named identifier of a part, by p_partkey % 11.
PARTS = [
    ("no_biosample_candidate", ""),
    ("review_query_error", ""),
    ("reject_conflicting_identifier", "NCPPB {k}"),
    ("review_strong_identifier_non_target_organism", "ICMP {k}"),
    ("reject_weak_identifier_non_target_organism", "B {size}"),
    ("reject_non_target_taxon", ""),
    ("confirmed_ncppb_identifier", "NCPPB {k}"),
    ("confirmed_equivalent_collection_identifier", "ICMP {k}"),
    ("review_local_or_donor_identifier_only", "B {size}"),
    ("review_taxon_only", ""),
    ("review_no_organism_or_strain_identifier", ""),
]


def test_strains_that_no_order_names(spark, tmp_path):
    """Every part's strain has its patterns, whichever strains the orders name; they aren't broadcast."""
    spark.range(295, 320).selectExpr("id AS p_partkey", "'a ring' AS p_name", "CAST(1 + id % 50 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(295, 297).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    found = plans.evidence_classes(spark, str(tmp_path))
    got = {r.ncppb_number: (r.evidence_class, r.matched_identifier) for r in found.collect()}
    want = {f"NCPPB {k}": (PARTS[k % 11][0], PARTS[k % 11][1].format(k=k, size=1 + k % 50)) for k in range(295, 320)}
    assert got == want
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
