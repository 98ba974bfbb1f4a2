"""Quality rules with compression bands.

zstandard ratios (compressed bytes by bytes) of the whole document, and of each fixed chunk of it,
must lie in a band that depends on the length: below it the text repeats itself, above it there
is no language in it. Short texts compress badly whatever they say, so the limits widen towards
short lengths and the shortest texts are not judged. A document is kept when it passes the base
rules, its whole ratio is in its band, and at most ``MAX_BAD_PERCENT`` of its chunks are outside
theirs (of fewer than 20 chunks, none). Every byte is in a chunk: a tail is
judged by the band of its own length, or shorter than ``MIN_CHUNK_BYTES`` with the chunk before it.

One row at a time on the executors: no shuffle, memory bounded by one batch of documents.

Defined cases: a null or empty text has no words and fails the base rules (ratios null); repeated
rows are documents of their own; a null doc_id is carried along; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACES
from shelfwise.llm.windows import repeated_in_text

#: (bytes from, lowest ratio, highest ratio); 9.0: no upper limit.
BANDS = (
    (0, 0.0, 9.0),
    (64, 0.33, 9.0),  # up to 127 bytes prose and noise compress alike
    (128, 0.33, 0.98),
    (160, 0.33, 0.93),
    (192, 0.33, 0.90),
    (256, 0.32, 0.85),
    (320, 0.32, 0.82),
    (384, 0.31, 0.80),
    (512, 0.30, 0.77),
    (768, 0.30, 0.76),
    (1024, 0.27, 0.76),
    (2048, 0.25, 0.72),
    (4096, 0.22, 0.70),
    (16384, 0.18, 0.68),
    (65536, 0.15, 0.68),
)
CHUNK_BYTES = 4096
MIN_CHUNK_BYTES = 512  # a shorter tail would say little by itself
MAX_BAD_PERCENT = 5  # of a document's chunks
LEVEL = 3
SYMBOLS = "#*$%&|<>"
REPEAT_WIDTH = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COLUMNS = (
    ("doc_id", pa.int64(), "long"),
    ("n_words", pa.int64(), "long"),
    ("word_chars", pa.int64(), "long"),
    ("n_symbols", pa.int64(), "long"),
    ("n_dup_lines", pa.int64(), "long"),
    ("n_repeat_words", pa.int64(), "long"),
    ("base_failed", pa.bool_(), "boolean"),
    ("kept", pa.bool_(), "boolean"),
    ("ratio", pa.float64(), "double"),
    ("n_chunks", pa.int64(), "long"),
    ("n_bad_chunks", pa.int64(), "long"),
)


def in_band(ratio: float, n_bytes: int) -> bool:
    _, low, high = next(b for b in reversed(BANDS) if n_bytes >= b[0])
    return low <= ratio <= high


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_in_text(words, REPEAT_WIDTH),
    )


def compression(text: str, compress) -> tuple[float | None, int, int]:
    """Whole ratio, chunks and chunks out of band."""
    data = text.encode()
    if not data:
        return None, 0, 0
    ratio = len(compress(data)) / len(data)
    starts = [*range(0, len(data), CHUNK_BYTES)]
    if len(starts) > 1 and len(data) - starts[-1] < MIN_CHUNK_BYTES:
        starts.pop()
    if len(starts) == 1:
        return ratio, 1, int(not in_band(ratio, len(data)))
    chunks = [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]
    bad = sum(not in_band(len(compress(c)) / len(c), len(c)) for c in chunks)
    return ratio, len(chunks), bad


def judge(doc_id: int | None, text: str | None, compress) -> tuple:
    text = text or ""
    counts = base_counts(text)
    n_words, n_repeat = counts[0], counts[4]
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    ratio, n_chunks, bad = compression(text, compress)
    kept = not failed and in_band(ratio, len(text.encode())) and 100 * bad <= MAX_BAD_PERCENT * n_chunks
    return (doc_id, *counts, failed, kept, ratio, n_chunks, bad)


def quality_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            rows = [
                judge(doc_id, text.as_py(), compress)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
            ]
            columns = list(zip(*rows)) or [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, t, _) in zip(columns, COLUMNS)], [n for n, _, _ in COLUMNS]
            )

    chosen = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("full_text"))
    return chosen.mapInArrow(measure, ", ".join(f"{n} {s}" for n, _, s in COLUMNS))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
