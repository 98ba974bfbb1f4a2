"""From raw documents to packed sequences: toxic documents go, exact copies go, of near-duplicates
one stays, secrets are masked, and what is left is packed.

Each stage reads all that its predecessor kept, as a Parquet table; its decisions take effect in
what it returns. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.common import written
from shelfwise.llm.exact_dedup import keep_first_copies
from shelfwise.llm.packing import packed_digests
from shelfwise.llm.secret_scans import redact_secrets
from shelfwise.llm.simhash_dedup import keep_representatives
from shelfwise.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null and empty texts score by the bias alone, long ones by all
    their words; repeated rows are scored alike; without labels or documents nothing is dropped."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without white space the longest stays, of equally long ones the one with
    the smallest id. A null text counts as empty; of rows that repeat id and text one stays."""
    return keep_first_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked the one with the smallest id stays. Texts without words
    share the fingerprint zero; rows that repeat the id that stays all stay; a row without an id goes if
    a linked one has an id."""
    return keep_representatives(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; every secret becomes ``[SECRET]``, and n_chars follows. Null and empty texts stay as
    they are; repeated rows are masked alike."""
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places. Null and empty texts are one piece that holds the end id; a text longer than
    a sequence is cut; repeated rows are documents of their own; no documents, no pieces."""
    return packed_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; the tests replay the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
