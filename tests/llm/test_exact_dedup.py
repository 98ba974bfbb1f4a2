from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shelfwise.llm.exact_dedup import _combined, _digested, exact_dedup, keep_first_copies, sha256
from tests.llm.helpers import ODD, by_id, documents


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    out = []
    for (i, t), n in zip(rows, norm):
        group = [(-len(u or ""), j is None, j or 0, j) for (j, u), m in zip(rows, norm) if m == n]
        best = min(group)
        kept = i == best[3] and len(t or "") == -best[0]
        out.append((i, best[3], len(group), kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = ODD + [(10 + i, "hot " * (1 + i % 3)) for i in range(60)] + [(99, "ho t" * 2)]
COLUMNS = ("keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("salts", [1, 16])
def test_matches_brute_force(spark, salts):
    assert by_id(exact_dedup(documents(spark, ROWS), salts=salts), *COLUMNS) == brute(ROWS)


def test_content_decides_where_digests_clash(spark):
    weak = lambda content: F.substring(sha256(content), 1, 1)
    got = by_id(exact_dedup(documents(spark, ROWS), digest=weak), *COLUMNS[:-1])
    assert got == sorted((r[:-1] for r in brute(ROWS)), key=repr)


def test_empty_table(spark):
    assert exact_dedup(documents(spark, [])).count() == 0


def test_kept_rows_keep_their_columns(spark):
    docs = documents(spark, ROWS)
    kept = keep_first_copies(docs)
    assert kept.columns == docs.columns
    want = {(r[0], r[4]) for r in brute(ROWS) if r[3]}
    got = [(r["doc_id"], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)  # a repeated row stays once


def test_copies_of_many_lengths_meet_in_as_many_rows_as_there_are_salts(spark):
    rows = [(i, "a" + " " * (i % 400) + "b") for i in range(2000)] + [(5000, "other")]
    digested = _digested(documents(spark, rows), 4, sha256, "doc_id", "text")
    groups = _combined(digested).collect()
    assert sorted(r["group_size"] for r in groups) == [1] + [2000] * 4
    assert {(r["keep_id"], r["keep_chars"]) for r in groups} == {(399, 401), (5000, 5)}
    assert by_id(exact_dedup(documents(spark, rows), salts=4), *COLUMNS) == brute(rows)
