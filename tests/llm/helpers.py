"""Small documents tables for the operators' tests."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns whose names the operators use inside; they must not get in the way.
CLASHING = {
    "digest": "1", "salt": "2", "gram": "3", "kept": "true", "score": "0.5", "length": "7",
    "component_id": "8", "fingerprint": "'f'", "full_text": "'x'", "key": "'k'", "rank": "9", "rid": "4",
}


def documents(spark, rows):
    """rows: (doc_id, text); the other columns follow, and clashing ones are added."""
    full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    frame = spark.createDataFrame(full, DOC_SCHEMA).repartition(3)
    return frame.selectExpr("*", *[f"{value} as {name}" for name, value in CLASHING.items()])


#: Null id, null, empty and blank text, a very long word, repeated rows, ties.
ODD = [
    (None, None), (None, "a b c"), (1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, "x" * 5000),
    (5, "same row"), (5, "same row"), (6, "Same  row"), (7, "same row "), (8, "é ü 你好   z"),
]


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def by_id(df, *columns):
    rows = [tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect()]
    return sorted(rows, key=repr)
