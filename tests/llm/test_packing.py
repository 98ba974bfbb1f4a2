from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm.packing import END_ID, fill_window, pack, packed_digests, plan_windows, token_pieces
from shelfwise.llm.tokens import ChunkEncoder, encoder
from tests.llm.helpers import ODD, documents, words

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "a  b", "a   b", "a\n  b", "a\n \n b", " a", "a ", "", "  ", "\n", "a \nb", "a\n\n b", "don't  we'll", "x y z", "é ́a",
    "a<|endoftext|>b", "it's 'so 12.5", "tab\t x", "A\x0bB \x1cC", "ΣΑΣ. Çé! éa, İx", "a.. b!! c?!", "... !", "a.b c.. d.\ne.\n\nf",
    "x,\ny", "a\x00b c", "tail.", "É. é, É.\nÀ", "5. 6, _. x", "end.\n", "KK ﬁ., ½. ", "word. , x", "é. z",
]


@pytest.mark.parametrize("path,kind", [(WORD, "word"), (BYTE, "byte")])
def test_chunked_ids_are_the_tokenizers(path, kind):
    rng = random.Random(13)
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    encoder = ChunkEncoder(path, kind, cache_chunks=20)
    random_texts = ["".join(rng.choice("abÉ.,!  \n\t'1_-é") for _ in range(rng.randrange(20))) for _ in range(500)]
    for text in TEXTS + random_texts + [t for _, t in ODD if t]:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, repr(text)
    assert encoder.encode(None) == b""


@pytest.mark.parametrize("path,kind", [(WORD, "word"), (BYTE, "byte")])
def test_added_tokens_in_a_text_are_the_unmodified_tokenizers(path, kind):
    rng = random.Random(17)
    plain, ids_of = Tokenizer.from_file(path), encoder(path, kind).encode
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "a", "É.", " ", "\n", "b, "]
    texts = ["a <|endoftext|> b", "<|ENDOFTEXT|>", *TEXTS]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(500)]
    for text in texts:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids_of(text), "<u4").tolist() == want, repr(text)
    assert ids_of("a <|endoftext|> b") != ChunkEncoder(path, kind).encode("a <|endoftext|> b")


def test_added_tokens_reach_the_packed_digests(spark):
    ids = Tokenizer.from_file(WORD).encode("a <|endoftext|> b", add_special_tokens=False).ids + [END_ID]
    (row,) = packed_digests(documents(spark, [(1, "a <|endoftext|> b")]), WORD).collect()
    assert (row["length"], row["ids_crc32"]) == (4, zlib.crc32(np.array(ids, dtype="<u4").tobytes()))


def best_sum(counts, capacity):
    longest = max(counts)
    left = list(itertools.chain.from_iterable([x] * (n - (x == longest)) for x, n in counts.items()))
    sums = {longest}
    for x in left:
        sums |= {s + x for s in sums if s + x <= capacity}
    return max(sums)


def test_a_window_is_filled_as_far_as_any_choice_can():
    rng = random.Random(14)
    for _ in range(200):
        capacity = rng.randrange(8, 40)
        counts = {rng.randrange(1, capacity): rng.randrange(1, 5) for _ in range(rng.randrange(1, 6))}
        used = fill_window(counts, capacity)
        assert all(0 < n <= counts[x] for x, n in used.items()) and max(counts) in used
        assert sum(x * n for x, n in used.items()) == best_sum(counts, capacity)


def test_the_plan_uses_every_piece_once():
    rng = random.Random(15)
    counts = {rng.randrange(1, 2048): rng.randrange(1, 2000) for _ in range(300)}
    used = {}
    for pattern, times in plan_windows(dict(counts), 2048):
        assert sum(x * n for x, n in pattern.items()) <= 2048
        for x, n in pattern.items():
            used[x] = used.get(x, 0) + n * times
    assert used == counts and plan_windows({}, 2048) == []


def check_layout(rows, capacity):
    """Gapless sequences; returns tokens and padding."""
    tokens = padding = 0
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
        tokens += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return tokens, padding


def test_whole_documents_are_packed(spark):
    rng = random.Random(16)
    rows = ODD + [(100 + i, " ".join(words(rng, rng.randrange(1, 1500)))) for i in range(150)]
    rows += [(900 + i, "hot text of one length") for i in range(100)]
    got = packed_digests(documents(spark, rows), WORD).collect()
    plain = Tokenizer.from_file(WORD)
    want = []
    for i, t in rows:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [END_ID], dtype="<u4")
        for a in range(0, len(ids), 2048):
            piece = ids[a : a + 2048]
            want.append((i, a, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    key = lambda r: repr(tuple(r))
    assert sorted([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got], key=key) == sorted(want, key=key)
    tokens, padding = check_layout(got, 2048)
    assert tokens == sum(w[2] for w in want) and padding < 0.02 * tokens + 2048
    assert {r["sequence_id"] for r in got} == set(range(len({r["sequence_id"] for r in got})))


def test_pieces_carry_their_ids_and_other_columns(spark):
    pieces = token_pieces(documents(spark, ODD), WORD, capacity=16).withColumn("mine", F.lit("x"))
    packed = pack(pieces, capacity=16)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    rows = packed.collect()
    check_layout(rows, 16)
    assert all(len(r["ids"]) == 4 * r["length"] and r["mine"] == "x" for r in rows)


def test_empty_table(spark):
    assert packed_digests(documents(spark, []), WORD).count() == 0
