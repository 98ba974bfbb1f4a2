"""The pipeline on sf0.01, each stage held against a brute-force version on its own input."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shelfwise.llm.toxicity import toxicity
from shelfwise.session import pinned
from tests.llm.test_packing import check_layout
from tests.llm.test_secret_scans import base
from tests.llm.test_simhash_dedup import brute as brute_components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = pinned(stage(spark, docs, SF), "test-stage")
        out.append((name, docs, result))
        docs = result
    return out


def test_empty_and_odd_documents_go_through(spark, scratch):
    """Null and blank texts, repeated rows, a long text, rows without an id; and no documents at all."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    texts = [(None, None), (1, None), (2, ""), (3, " \n"), (4, "same text here"), (4, "same text here"), (5, "same  text here"),
             (6, "token=abcdef123456 " * 9000), (7, "ordinary words in a row")]
    odd = [(i, t, "en", "src", None if t is None else len(t)) for i, t in texts]
    for name, documents in (("odd", odd), ("empty", [])):
        folder = os.path.join(scratch, name)
        spark.createDataFrame(documents, schema).repartition(2).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
        pieces = corpus_pipeline.run(spark, folder).collect()
        ids = {r["doc_id"] for r in pieces}
        if name == "empty":
            assert not pieces
        else:
            # Of texts that are equal without white space the longest original stays: of the blank ones that of
            # 3, and 5 of the others.
            assert {3, 5, 6, 7} <= ids and not ids & {1, 2, 4}


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_order_and_columns(steps):
    assert [n for n, _, _ in steps] == ["toxicity", "exact_dedup", "simhash_dedup", "secret_scans", "packing"]
    columns = steps[0][1].columns
    assert all(after.columns == columns for _, _, after in steps[:-1])


def test_toxicity_stage(spark, steps):
    _, before, after = steps[0]
    scores = toxicity(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(rows(after)) == {r["doc_id"] for r in scores if r["score"] < 0.5}
    assert len(rows(after)) > 0.6 * before.count()


def test_exact_stage(steps):
    _, before, after = steps[1]
    best = {}
    for i, t in rows(before).items():
        content = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[content] = min(best.get(content, (0, 0)) if content in best else (-len(t), i), (-len(t), i))
    assert set(rows(after)) == {i for _, i in best.values()}


def test_near_stage(steps):
    _, before, after = steps[2]
    assert set(rows(after)) == {c for *_, c in brute_components(sorted(rows(before).items()), 3)}


def test_secrets_stage(steps):
    _, before, after = steps[3]
    old, new = rows(before), rows(after)
    assert set(old) == set(new)
    assert any(base(t) for t in old.values()) and not any(base(t) for t in new.values())
    assert all(old[i] == new[i] for i in old if not base(old[i]) and "[SECRET]" not in new[i])


def test_packing_stage(steps):
    _, before, after = steps[4]
    got = after.collect()
    tokens, padding = check_layout(got, 2048)
    assert padding < 0.05 * tokens
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(rows(before))
    for i, text in rows(before).items():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
        for r in by[i]:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in by[i]) == len(ids)


def test_run_is_the_stages_in_a_row(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[-1][2].collect()))
