"""The pattern index: the same best identifiers as trying every pattern, by fewer tries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from accessio.operators import evidence
from accessio.schema import EVIDENCE, IDENTIFIERS

VALUES = ["ICMP 204", "LMG 0673", "B 14", "ISPAVE-B 020", "XS/12 3.45", "A-B 12/34/5", "CFBP 12A34", "PD KM", "K 007", "NCPPB 45", "I 1", "S 2000000000000"]
SEPARATORS = ["", " ", "-", " : ", "_", "/", ".", "  ", "x", ", ", "0", "\n"]


def identifiers(spark, strains, seed):
    r = random.Random(seed)
    rows = []
    for s in strains:
        for at, v in enumerate(r.sample(VALUES, 6) + [r.choice(VALUES)]):
            rule, confidence = r.choice([("known_collection_prefix", "high"), ("general_code_candidate", "low"), ("uppercase_general_code", "medium")])
            rows.append({c: "" for c in IDENTIFIERS} | {"ncppb_number": s, "normalized_identifier": v, "rule_name": rule, "confidence": confidence, "include_for_search": r.choice(["yes", "yes", "no"]), "ord": len(rows) + at})
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in IDENTIFIERS) + ", ord int")


def texts(strains, n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(7)):
            parts = re.findall("[A-Za-z]+|[0-9]+", r.choice([*VALUES, *strains]))
            word = "".join(p + (r.choice(SEPARATORS) if r.random() < 0.8 else "") for p in parts)
            words.append(r.choice([str, str.lower, lambda x: x.replace("K", "K").replace("S", "ſ").replace("I", "ı"), lambda x: "00" + x, lambda x: "(" + x + ")"])(word))
        out.append((r.choice([*strains, "other"]), f"u{i}", " ".join(words), r.choice(["ok", "ok", "ok", "error", "no_hit"]), r.choice(["", "Xanthomonas", "Pseudomonas"])))
    return out + out[:20]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("with_number", [True, False])
def test_same_evidence(spark, seed, with_number):
    strains = ["NCPPB 45", "NCPPB 0204", "NCPPB 12", "unnumbered", "NCPPB ٤٥"]
    found = identifiers(spark, strains, seed)
    given = texts(strains, 1200, seed)
    rows = spark.createDataFrame(given, "ncppb_number string, ncbi_uid string, metadata_text string, status string, organism string")
    patterns, index = evidence.build_patterns(found, "ord", with_number), evidence.pattern_index(found, "ord", with_number)
    # every pattern of the strain tried on every text
    every = rows.withColumn("text", evidence.metadata_text(rows)).join(patterns, "ncppb_number").withColumn("p", F.explode("patterns"))
    tried = every.where("status = 'ok'").withColumn("i", F.col("p.ord"))
    plain = {(r.ncppb_number, r.ncbi_uid): r.v for r in tried.where(F.rlike("text", F.col("p.pattern"))).groupBy("ncppb_number", "ncbi_uid").agg(F.min_by("p.value", F.struct(-F.col("p.score"), "i")).alias("v")).collect()}
    assert len(plain) > 60
    by_index = sorted(map(tuple, evidence.classify_indexed(rows, index).select(*EVIDENCE).collect()))
    by_array = sorted(map(tuple, evidence.classify_rows(rows, patterns).select(*EVIDENCE).collect()))
    assert by_index == by_array
    named = {(r[0], r[2]): r[12] for r in by_index if r[12]}
    assert all(plain[k] == v for k, v in named.items())
    judged = evidence.classify_indexed(rows, index).where("evidence_class LIKE 'confirmed%' OR evidence_class LIKE '%identifier_only'")
    assert judged.count() > 20
    # each text meets fewer patterns than its strain has
    some = rows.where("status = 'ok'").select("ncppb_number", evidence.metadata_text(rows).alias("text"), "ncbi_uid")
    tries = evidence.pattern_candidates(some, index).count()
    assert len(plain) <= tries < 0.6 * tried.count()


def test_tokens(spark):
    df = spark.createDataFrame([("a 007b12/3,0 00", "XS/12 3.45"), ("", "PD KM"), ("x1", "A1B 2-3")], "t string, i string")
    got = [(r.a, r.b) for r in df.select(evidence.digit_tokens(F.col("t")).alias("a"), evidence.identifier_keys(F.col("i")).alias("b")).collect()]
    assert got == [(["7", "12", "3", "0", ""], ["12", "123", "12345"]), ([""], [""]), (["1", ""], ["1"])]
