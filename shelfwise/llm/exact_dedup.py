"""Exact dedup by skew-safe combining (DataFrame functions only).

1. Locally: rows of one task with equal content collapse in the partial aggregate.
2. Salted groups: ``(digest, salt, content)`` is merged after the first shuffle, so a group that
   holds a third of all rows is spread over ``salts`` tasks.
3. Globally: at most ``salts`` winners of a content meet, whatever white space its copies have; the
   winner and the group size are found, and go back to the documents by ``(digest, salt)``, again spread.

The full normalised content is a grouping key at both shuffles, so two texts are equal only when
their content is. Should a digest be shared by different contents, the way back to the documents
compares the content too (``_assign``); else the digest alone is already proof.

Defined cases: a null text counts as empty; empty texts form a group like any other; a null
``doc_id`` sorts last among equals; rows that repeat both doc_id and length of the winner are all
kept (they cannot be told apart) and each counts in ``group_size``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACE_CLASS, salt, text_or_empty, written

SALTS = 16


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _digested(
    documents: DataFrame, salts: int, digest: Callable[[Column], Column], id_col: str, text_col: str
) -> DataFrame:
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("full_text")
    )
    rows = rows.select(
        "doc_id",
        F.length("full_text").cast("long").alias("n_chars"),
        F.regexp_replace("full_text", f"{SPACE_CLASS}+", "").alias("content"),
        salt(F.coalesce(F.col("doc_id"), F.lit(0)), salts).alias("salt"),
    )
    return rows.withColumn("digest", digest(F.col("content")))


def _combined(rows: DataFrame) -> DataFrame:
    """Per (digest, salt): the group's winner and size; ``variant`` numbers a digest's contents. Copies of
    different original lengths combine too, so a group has at most as many rows as there are salts."""
    # The least of these is the longest, then the smallest id; a null id comes last.
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    local = rows.groupBy("digest", "salt", "content").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    group = W.partitionBy("digest", "content")
    return (
        local.repartition("digest")
        .select(
            "digest",
            "salt",
            "content",
            F.min("best").over(group).alias("best"),
            F.sum("n").over(group).alias("group_size"),
            F.dense_rank().over(W.partitionBy("digest").orderBy("content")).alias("variant"),
        )
        .select("*", F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("keep_chars"))
        .drop("best")
    )


def _assign(rows: DataFrame, groups: DataFrame, clash: bool) -> DataFrame:
    keys = ["digest", "salt"] + (["content"] if clash else [])
    return rows.select("doc_id", "n_chars", *keys).join(groups.drop("variant"), keys)


def exact_dedup(
    documents: DataFrame,
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (the digest).

    Texts are equal when identical without ASCII white space. Of equal texts the longest original
    stays, then the smallest doc_id.
    """
    rows = _digested(documents, salts, digest, id_col, text_col)
    combined = _combined(rows)
    several = F.max("variant").over(W.partitionBy("digest")) > 1
    # The content is kept only for a digest that several contents share.
    groups = written(combined.withColumn("content", F.when(several, F.col("content"))), "exact-dedup")
    clash = not groups.filter("variant > 1").isEmpty()
    if clash:
        shared = groups.filter(F.col("content").isNotNull())
        plain = _assign(
            rows.join(shared.select("digest").distinct(), "digest", "left_anti"),
            groups.filter(F.col("content").isNull()).drop("content"),
            clash=False,
        )
        found = plain.unionByName(_assign(rows, shared, clash=True).drop("content"))
    else:
        found = _assign(rows, groups.drop("content"), clash=False)
    kept = F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("n_chars") == F.col("keep_chars"))
    return found.select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_first_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact_dedup keeps, one row each, with all their columns. Null, empty and long texts
    and ties are as there; of repeated rows one stays; an empty table stays empty."""
    key, digest = "__copy_key", "__copy_digest"
    content = F.regexp_replace(text_or_empty(text_col), f"{SPACE_CLASS}+", "")
    keyed = documents.withColumns({key: F.col(id_col).cast("long"), digest: sha256(content)})
    stay = exact_dedup(documents, id_col=id_col, text_col=text_col).filter("kept")
    stay = stay.select(F.col("doc_id").alias("__stay_key"), F.col("text_sha256").alias("__stay_digest"))
    same = (F.col(digest) == F.col("__stay_digest")) & F.col(key).eqNullSafe(F.col("__stay_key"))
    # The join leaves rows dealt by (digest, key), so rows that repeat meet in one task.
    return keyed.join(stay, same, "left_semi").dropDuplicates([digest, key]).drop(key, digest)


ORACLE_SQL = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY content ORDER BY n_chars DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY content ORDER BY n_chars DESC, doc_id NULLS LAST) AS kept,
       sha256(content) AS text_sha256
FROM normal
"""


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
