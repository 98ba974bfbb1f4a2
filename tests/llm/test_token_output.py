from __future__ import annotations

import glob
import os
import random
import string
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from shelfwise.llm.token_output import END_ID, document_starts, file_digests, read_tokens, write_tokens
from shelfwise.llm.tokens import ChunkEncoder
from tests.llm.helpers import ODD, documents, words

BYTE = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(17)
ROWS = ODD + [(1000 - i, " ".join(words(RNG, RNG.randrange(1, 400)))) for i in range(300)]


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [END_ID], dtype="<u4")


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_exact_round_trip(spark, scratch, encoding):
    path = os.path.join(scratch, "tokens")
    write_tokens(documents(spark, ROWS), path, BYTE, encoding=encoding, row_group_bytes=200_000, page_bytes=20_000)
    files = read_tokens(spark, path)
    got = file_digests(files).join(document_starts(files), ["part", "row"]).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(BYTE)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted(((i, len(x := ids_of(tokenizer, t)), zlib.crc32(x.tobytes())) for i, t in ROWS), key=repr)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == want


def test_files_have_the_set_layout(spark, scratch):
    for encoding, wanted in (("dictionary", "DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = os.path.join(scratch, encoding)
        write_tokens(documents(spark, ROWS), path, BYTE, encoding=encoding, row_group_bytes=100_000, page_bytes=10_000)
        metas = [pq.ParquetFile(f).metadata for f in glob.glob(os.path.join(path, "part-*.parquet"))]
        assert metas
        for meta in metas:
            for g in range(meta.num_row_groups):
                ids = meta.row_group(g).column(meta.row_group(g).num_columns - 1)
                assert any(wanted in e for e in ids.encodings), ids.encodings
                assert ids.has_column_index and ids.has_offset_index


def test_selective_read_prunes(spark, scratch):
    path = os.path.join(scratch, "tokens")
    write_tokens(documents(spark, ROWS), path, BYTE)
    some = read_tokens(spark, path).filter("doc_id between 800 and 805").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "GreaterThanOrEqual(doc_id,800)" in plan
    assert some.count() == 6


def test_empty_table(spark, scratch):
    path = os.path.join(scratch, "none")
    write_tokens(documents(spark, []), path, BYTE)
    assert file_digests(read_tokens(spark, path)).count() == 0


def lists_of(encoder, texts):
    return [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode_all(texts)]


def test_unseen_words_of_a_group_reach_the_library_together(monkeypatch):
    encoder, asked = ChunkEncoder(BYTE, "byte"), []
    plain = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda tokenizer, texts: asked.append(texts) or plain(tokenizer, texts))
    texts = [f"Groups of words, {'abcdefghij'[k % 10]}neword and klm{'nopq'[k % 4]}!! once." for k in range(200)]
    got, tokenizer = lists_of(encoder, texts), Tokenizer.from_file(BYTE)
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == 1 and sum(map(len, asked)) == 1
    assert lists_of(encoder, texts[::-1]) == got[::-1] and len(asked) == 1


@pytest.mark.parametrize("cache_chunks", [3, 1000])
def test_ids_of_groups_are_the_tokenizers(cache_chunks):
    encoder = ChunkEncoder(BYTE, "byte", cache_chunks=cache_chunks, added_tokens=True)
    texts = [
        *(t for _, t in ODD), "It's the dogs' day; they'll don't 'em, we've.", "a.\nb, c. d,\ne", "x-y_z 1,234.5 $$$ ab$$$ 9a a9",
        "ÿ ÿÿ þÿ.\nÿ", "(word). \"so\", he said", "a <|endoftext|> b", "a\u00a0b", "Élan élan!! été\u0301 ǅ ª", "", None, "one", "ab' ab's' ab'.",
    ]
    tokenizer = Tokenizer.from_file(BYTE)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert lists_of(encoder, texts) == want
    assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == want


def test_runs_of_letters_and_marks_are_the_librarys_pretokens():
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
    marks = [a + b for a in string.punctuation for b in string.punctuation]
    chunks = [f"a{c}a" for c in letters] + [f"ab{m}" for m in marks] + [f"é{m}" for m in marks]
    texts = [" ".join(["b", *chunks[k : k + 2000]]) for k in range(0, len(chunks), 2000)]
    tokenizer = Tokenizer.from_file(BYTE)
    for text, ids in zip(texts, lists_of(ChunkEncoder(BYTE, "byte"), texts)):
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
