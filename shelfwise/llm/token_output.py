"""Token-id output: Parquet files with one list of ids per document, and their reading back.

File format (a folder of Parquet files, rows in ascending doc_id order over files and in a file):

* ``part`` int, ``row`` long: number of the file in order, and of the row in it;
* ``doc_id`` long, ``n_tokens`` long;
* ``ids`` list of int32: the document's ids with the end id.

``encoding="dictionary"`` keeps a dictionary per column chunk (bit-packed indexes);
``encoding="delta"`` writes version-2 pages with delta-packed integers. Row groups and pages have
set sizes, and the writer adds page indexes, so a filter on doc_id, or a read of the metadata
columns only, touches few pages. The writer is Spark's own, so files go to any store it reaches.

Defined cases: null and empty texts hold the end id only; null doc_ids come first; repeated rows
are documents of their own, in any order among themselves; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import in_small_batches, tidied
from shelfwise.llm.tokens import encoder
from shelfwise.session import fresh_path

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_1_0"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}
#: Texts are encoded together until they have so many characters.
GROUP_CHARS = 2 << 20
FILE_SCHEMA = "part int, row long, doc_id long, n_tokens long, ids array<int>"


def write_tokens(
    documents: DataFrame,
    path: str,
    tokenizer_path: str,
    kind: str = "byte",
    end_id: int = END_ID,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Range-partitions the documents by id (before encoding, so texts are encoded once), encodes
    them in order and writes one file per partition."""

    @tidied
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer_path, kind).encode_all
        end = np.array([end_id], dtype="<u4").tobytes()
        row = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts: list[str | None] = []
            size = at = 0
            for k, text in enumerate(batch.column(1), 1):
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size > GROUP_CHARS or k == len(batch):
                    yield _rows(row, doc_ids[at:k], [ids + end for ids in encode_all(texts)])
                    row, texts, size, at = row + k - at, [], 0, k

    def _rows(row: int, doc_ids: list, held: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(x) // 4 for x in held], dtype=np.int64)
        ids = np.frombuffer(b"".join(held), dtype="<u4").astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(row, row + len(held)), pa.int64()),
                pa.array(doc_ids, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
            ],
            names=["row", "doc_id", "n_tokens", "ids"],
        )

    ordered = (
        documents.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("full_text")
        )
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    encoded = in_small_batches(ordered).mapInArrow(encode, "row long, doc_id long, n_tokens long, ids array<int>")
    options = ENCODINGS[encoding] | {
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
    }
    out = encoded.select(F.spark_partition_id().alias("part"), "*")
    out.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def document_starts(files: DataFrame) -> DataFrame:
    """part, row, start: the ids of all documents before a document. Reads no ids. Totals of the
    files are summed in order (one row per file), then rows within their file."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    in_file = W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    rows = files.select(
        "part", "row", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)).alias("in_file")
    )
    return rows.join(bases, "part").select("part", "row", (F.col("base") + F.col("in_file")).alias("start"))


def file_digests(files: DataFrame) -> DataFrame:
    """part, row, doc_id, n_tokens and ids_crc32, from the ids as they were read."""

    @tidied
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("part"),
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["part", "row", "doc_id", "n_tokens", "ids_crc32"],
            )

    schema = "part int, row long, doc_id long, n_tokens long, ids_crc32 long"
    return files.select("part", "row", "doc_id", "ids").mapInArrow(digest, schema)


def op10_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "token-output")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_tokens(documents, path, public_tokenizers.path("byte_bpe_50k.json"))
    files = read_tokens(spark, path)
    return (
        file_digests(files)
        .join(document_starts(files), ["part", "row"])
        .select("doc_id", "start", "n_tokens", "ids_crc32")
    )
