from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from shelfwise.llm.periodic_runs import (
    digests,
    lag_bands,
    op11_periodic_runs,
    overlap,
    periodic_runs,
    periodic_runs_of,
    with_planted_period,
)
from tests.llm.helpers import ODD, by_id, documents

SF = "/root/testdata/sf0.001"


def brute(ids, min_length=6, min_exponent=4):
    """Every diagonal walked word by word; the smallest period is checked against all smaller ones."""
    runs = []
    for q in range(1, len(ids) // min_exponent + 1):
        i = 0
        while i < len(ids) - q:
            j = i
            while j < len(ids) - q and ids[j] == ids[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                run = ids[i : j + q]
                if not any(run[d:] == run[:-d] for d in range(1, q)):
                    runs.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(runs)


def contract_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    first = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    return (doc_id, len(runs), *first, sha(listed), sha(kept))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("min_length, min_exponent", [(6, 4), (1, 3), (4, 2), (30, 5)])
def test_runs_match_brute_force(min_length, min_exponent):
    rng = random.Random(min_length)
    for _ in range(400):
        v = rng.choice([1, 2, 3, 40])
        ids = [rng.randrange(v) for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.randrange(3)):
            block = [rng.randrange(v) for _ in range(rng.randrange(1, 25))]
            at = rng.randrange(len(ids) + 1)
            ids[at:at] = block * rng.randrange(2, 7) + block[: rng.randrange(len(block) + 1)]
        assert periodic_runs_of(np.array(ids), min_length, min_exponent) == brute(ids, min_length, min_exponent)


def test_bands_cover_every_lag_with_grams_that_are_guaranteed():
    bands = lag_bands(3000, 6, 4)
    assert [q for low, high, _ in bands for q in range(low, high + 1)] == list(range(1, 3001))
    for low, high, gram in bands:
        assert gram <= min(overlap(q, 6, 4) for q in range(low, high + 1))
        assert gram >= high - 1


def test_long_texts_of_one_word_and_of_one_long_block_take_a_moment():
    began = time.time()
    assert periodic_runs_of(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    assert periodic_runs_of(np.arange(300_000) % 60_000) == [(0, 300_000, 60_000)]
    assert time.time() - began < 20


def test_query_columns_match_brute_force(spark):
    rng = random.Random(5)
    rows = list(ODD) + [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(300 + i, "\n".join(["x  y\tz"] * i)) for i in range(9)] + [(400, "la " * 5000)]
    got = by_id(digests(periodic_runs(with_planted_period(documents(spark, rows)))), *COLUMNS)
    assert got == sorted((contract_row(i, t) for i, t in rows), key=repr)


def test_registered_query_matches_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in source if len(r.text or "") < 6000]
    got = {r[0]: r for r in by_id(op11_periodic_runs(spark, SF), *COLUMNS)}
    assert len(got) == len(source)
    assert [got[r.doc_id] for r in short] == [contract_row(r.doc_id, r.text) for r in short]
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_empty_table(spark):
    assert digests(periodic_runs(with_planted_period(documents(spark, [])))).count() == 0


def test_collapsed_text_and_runs_are_returned(spark):
    frame = spark.createDataFrame([(1, "say it again again again again again again now")], "key long, body string")
    row = periodic_runs(frame, "key", "body").first()
    assert row.collapsed == "say it again now" and [tuple(r) for r in row.runs] == [(2, 6, 1)]
