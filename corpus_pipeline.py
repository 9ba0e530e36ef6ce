"""A corpus pipeline from the operators of rimefield.llm.

Toxic documents go, one document of each group of near-duplicates stays, benchmark passages are cut out, secrets are
masked, and the sources are mixed to their target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rimefield.llm import decontaminate, mixing, secrets, simhash, toxicity
from rimefield.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score 0.5 or more go."""
    return toxicity.reject(docs, toxicity.learn(*toxicity.train_rows(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the document of the smallest id stays."""
    return simhash.deduplicate(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: hit spans are cut out; documents that are mostly benchmark go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: spans become a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents as often as the mix takes them."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: SQL can't express the learned lexicon; tests/llm/test_pipeline.py holds run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
