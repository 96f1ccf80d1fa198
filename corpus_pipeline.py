"""A corpus pipeline: toxic documents and near-duplicates go, leaked benchmark
passages go, sources are mixed to their weights, and the rest is cut into shards.

STAGES lists the steps. Each takes (spark, docs, sf_dir) and returns the
documents that it keeps, in the columns of documents; the last adds its shards.
docs is a table as its files hold it, so its rows can be numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accessio.llm import decontamination, mixing, sharding, simhash, toxicity
from accessio.llm.base import forget, settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; learnt from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.learnt(docs, labels.where(~toxicity.held_out(labels["doc_id"])))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicated(docs, fixed=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), fixed=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs, fixed=True)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.shard_by_bytes(docs, fixed=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Learnt scores, fingerprint groups and draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result settled before the next reads it."""
    docs, held = table(spark, sf_dir, "documents"), []
    for number, (_, stage) in enumerate(STAGES):
        if number:
            docs = settled(docs)
            for done in held:  # read for the last time
                forget(done)
            held = [docs]
        docs = stage(spark, docs, sf_dir)
    return docs
