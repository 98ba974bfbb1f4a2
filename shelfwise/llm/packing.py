"""Packing of token sequences by minimum bin slack.

Each document's ids (with an end id) are cut into full windows and one remainder. Only the
remainders need packing, and only their length matters, so the corpus is reduced to a histogram
with fewer than ``capacity`` entries whatever its size. On it, windows are planned one pattern at
a time: the longest remaining length is placed, a bitset subset-sum over the other remaining
lengths (each with its count, split into powers of two) finds the fill closest to the capacity,
the stages are walked back to the counts used, and the pattern is repeated as often as the counts
allow. A document then finds its place from its rank among the remainders of its length.

Ranks are taken in ``(length, bucket)`` groups, with the number of buckets following the number of
pieces, so a length that a third of all documents share is ranked by many tasks.

Defined cases: null and empty texts are one piece that holds the end id; repeated rows are
documents of their own; null doc_ids are carried along; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm.common import in_small_batches, tidied, written
from shelfwise.llm.tokens import ID_BYTES, encoder

CAPACITY = 2048
END_ID = 1
#: Pieces that one (length, bucket) group is meant to hold at most, on average.
BUCKET_PIECES = 200_000


def token_pieces(
    documents: DataFrame,
    tokenizer_path: str,
    kind: str = "word",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each document's ids, cut at every ``capacity``: doc_id, start, length, doc_tokens, and
    ``ids`` as little-endian unsigned 32-bit integers."""
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary"

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, kind).encode
        end = end_id.to_bytes(ID_BYTES, "little")
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // ID_BYTES
                for start in range(0, total, capacity):
                    piece = ids[start * ID_BYTES : (start + capacity) * ID_BYTES]
                    rows.append((doc_id, start, len(piece) // ID_BYTES, total, piece))
                held += len(ids)
                if held > 16 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "doc_tokens", "ids"]
        types = [pa.int64()] * 4 + [pa.binary()]
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    chosen = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("full_text")
    )
    return in_small_batches(chosen).mapInArrow(cut, schema)


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The lengths (with copies) of the fullest window that holds the longest remaining length."""
    longest = max(counts)
    used = {longest: 1}
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach = 1  # bit s: some multiset of the lengths seen so far sums to s
    stages: list[tuple[int, int, int]] = []  # reach before, length, copies
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        copies = 1
        while left > 0 and not reach >> room & 1:
            copies = min(copies, left)
            stages.append((reach, length, copies))
            reach |= reach << (length * copies) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for before, length, copies in reversed(stages):
        if not before >> total & 1:
            total -= length * copies
            used[length] = used.get(length, 0) + copies
    return used


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) with the number of windows made by each."""
    counts = {length: n for length, n in counts.items() if n > 0}
    plan = []
    while counts:
        used = fill_window(counts, capacity)
        times = min(counts[length] // copies for length, copies in used.items())
        plan.append((used, times))
        for length, copies in used.items():
            counts[length] -= copies * times
            if not counts[length]:
                del counts[length]
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, copies, first sequence, offset), by length and rank; the number
    of sequences. Bounded by the plan, which is bounded by the capacity."""
    rows, taken, sequence = [], {}, 0
    for used, times in plan:
        offset = 0
        for length, copies in sorted(used.items(), reverse=True):
            rank = taken.get(length, 0)
            rows.append((length, rank, copies, sequence, offset))
            taken[length] = rank + copies * times
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), sequence


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, start, length and any more columns) with sequence_id and offset.

    ``pieces`` is read three times: pass a table that is cheap to read again.
    """
    lengths = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # <= capacity rows
    counts = {int(r["length"]): int(r["n"]) for r in lengths}
    total = sum(counts.values())
    full = counts.pop(capacity, 0)
    places, sequences = _places(plan_windows(counts, capacity))
    buckets = max(16, -(-total // BUCKET_PIECES))
    bucket, rank_, base, count = (_free(pieces, x) for x in ("bucket", "rank", "base", "count"))
    bucketed = pieces.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    sizes = bucketed.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(count))
    before = W.partitionBy("length").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("length", bucket, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    in_bucket = W.partitionBy("length", bucket).orderBy("doc_id", "start")
    ranked = (
        bucketed.withColumn(rank_, F.row_number().over(in_bucket) - 1)
        .join(bases, ["length", bucket])
        .withColumn(rank_, F.col(rank_) + F.col(base))
        .select(*pieces.columns, rank_)
    )
    names = [*pieces.columns, "sequence_id", "offset"]
    shift = 1 << 44  # ranks are below it; lengths stay below 2^19
    keys = places[:, 0] * shift + places[:, 1]

    @tidied
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column(rank_).to_numpy()
            sequence, offset = sequences + rank, np.zeros(len(rank), dtype=np.int64)
            rest = length < capacity
            if rest.any():
                at = np.searchsorted(keys, length[rest] * shift + rank[rest], side="right") - 1
                _, first, copies, start, base = places[at].T
                nth = rank[rest] - first
                sequence[rest] = start + nth // copies
                offset[rest] = base + nth % copies * length[rest]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != rank_]
            kept += [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(kept, names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def packed_digests(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces with their place; of the ids, the crc32 only."""
    pieces = token_pieces(documents, tokenizer_path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"
    )
    return pack(written(pieces, "pieces"))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_digests(documents, public_tokenizers.path("word_bpe_49k.json"))
