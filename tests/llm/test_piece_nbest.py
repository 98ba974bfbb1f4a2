from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest

from shelfwise.llm.piece_nbest import Pieces, _Path, decode_ids, encode_nbest
from tests.llm.helpers import ODD, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return Pieces(PATH, 4, cache_chunks=50)


def every_path(model, text):
    """All segmentations of the whole text's lattice, best first."""
    text, out = " " + text, []
    arcs = model.arcs(text)

    def back(at, score, ids):
        if not at:
            out.append((score, ids))
        for start, s, piece in arcs[at]:
            back(start, score + s, piece + ids)

    back(len(text), 0.0, ())
    return sorted(out, key=lambda x: (-x[0], x[1]))


TEXTS = ["the thing", "a  b", " x", "x ", "\n", "ab\ncd.", "é☃ x", "a▁b", "the the the", "Wo,w", "   ", "你好 q", "one\n\ntwo"]


@pytest.mark.parametrize("text", TEXTS)
def test_whole_lattice_by_brute_force(model, text):
    want = every_path(model, text)
    found = model.encode(text)
    assert [s for s, _ in found] == pytest.approx([s for s, _ in want[:4]])
    paths = {tuple(np.frombuffer(ids, "<u4").tolist()) for _, ids in found}
    assert len(paths) == len(found)  # distinct segmentations
    assert paths <= {ids for _, ids in want}
    assert all(model.decode(ids) == text for _, ids in found)


def test_random_chunks_by_brute_force(model):
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice("theandiong. \n") for _ in range(rng.randrange(1, 9)))
        want = every_path(model, text)[:4]
        assert [s for s, _ in model.encode(text)] == pytest.approx([s for s, _ in want]), text


def test_round_trip_of_odd_texts(spark):
    rows = ODD + [(20, "tabs\tand\r\nlines"), (21, "\x00 ▁ \U0001f600")]
    decoded = decode_ids(encode_nbest(documents(spark, rows), PATH), PATH).collect()
    texts = {}
    for r in decoded:
        texts.setdefault(r["doc_id"], set()).add(r["decoded"])
    want = {}
    for i, t in rows:
        want.setdefault(i, set()).add(t or "")
    assert texts == want
    both = encode_nbest(documents(spark, rows), PATH, decoded=True).collect()
    assert sorted(map(tuple, both), key=repr) == sorted(map(tuple, decoded), key=repr)
    ranks = [r["rank"] for r in decoded if r["doc_id"] == 8]
    assert sorted(ranks) == [1, 2, 3]
    assert [(r["score"], len(r["ids"])) for r in decoded if r["doc_id"] == 2] == [(0.0, 0)]


def test_empty_table(spark):
    assert encode_nbest(documents(spark, []), PATH).count() == 0


def test_decoding_ids_that_are_no_text(model):
    ids = np.array([model.bytes[0xE2], 1, model.ids[" the"][0]], dtype="<u4").tobytes()
    assert model.decode(ids) == "� the"


def test_cache_size_changes_nothing(model):
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(60))
    assert model.encode(text) == Pieces(PATH, 4).encode(text)


def test_chunk_summary_is_what_the_search_finds(model):
    rng = random.Random(10)
    for _ in range(300):
        text = " " + "".join(rng.choice("theandiongé☃.") for _ in range(rng.randrange(1, 14)))
        found = model.nbest(text, 2)
        ids, score, cost = model._search(text)
        assert (ids, score) == (model._pack(found[0][1]), found[0][0])
        assert cost == (found[0][0] - found[1][0] if len(found) > 1 else float("inf"))


def test_long_texts_without_spaces_take_seconds(model):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000))
    began = time.time()
    found = model.encode(text)
    assert time.time() - began < 20
    assert len(found) == 4 and all(model.decode(ids) == text for _, ids in found)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def test_equal_paths_are_ordered_by_their_ids_from_the_end():
    rng = random.Random(6)
    root = _Path((), None)
    paths, children = [root], set()
    while len(paths) < 400:
        after, arc = rng.choice(paths[-40:]), rng.randrange(3)
        if (id(after), arc) not in children:  # a search takes an arc once from a path
            children.add((id(after), arc))
            paths.append(_Path((arc,), after))
    for a, b in zip(rng.choices(paths, k=3000), rng.choices(paths, k=3000)):
        assert (a < b) == (a.ids() < b.ids())
    long = root
    for k in range(5000):
        long = _Path((k % 7,), long)
    left, right = _Path((1,), long), _Path((2,), long)
    for k in range(3000):
        left, right = _Path((9,), left), _Path((0,), right)
    assert left < right and not right < left and long < left and not left < long
