from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from shelfwise.llm.components import components
from shelfwise.llm.simhash_dedup import fingerprint, forest, keep_representatives, simhash_components
from tests.llm.helpers import ODD, by_id, documents, words


def brute_print(text, size=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [j for (j, _), g in zip(rows, group) if g == group[k] and j is not None]
        out.append((i, f"{prints[k]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    rows = list(ODD)
    for i in range(100, 108):
        base = words(rng, 300)
        for k in range(8):  # each a word or two away from the base
            copy = list(base)
            for _ in range(k % 4):
                copy[rng.randrange(300)] = "Changed"
            rows.append((i * 10 + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("distance", [3, 6])
def test_matches_brute_force(spark, distance):
    rows = corpus()
    want = brute(rows, distance)
    assert len({r[2] for r in want}) < len({r[1] for r in want})  # there are links to find
    found = simhash_components(documents(spark, rows), max_distance=distance)
    assert by_id(found, "fingerprint", "component_id") == want


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark, corpus())
    kept = keep_representatives(docs)
    want = {r[2] for r in brute(corpus(), 3) if r[2] is not None}
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == want


def test_empty_table(spark):
    assert simhash_components(documents(spark, [])).count() == 0


def test_fingerprint_is_the_majority():
    for _, text in corpus()[:40]:
        assert fingerprint(text) == brute_print(text)


def test_flipping_bits_finds_the_links_of_comparing_pairs():
    rng = np.random.default_rng(6)
    base = np.uint64(0xABCDEF0123456789)
    for distance in (1, 2, 3):
        # Members of a list share 8 - distance bytes: they differ in the others only.
        free = np.uint64(0x555555 & ((1 << 8 * distance) - 1))
        members = np.unique(base ^ rng.integers(0, 1 << 24, 600, dtype=np.uint64) & free)
        by_flips = forest(members, 8 - distance, distance, pair_list=1)
        assert (by_flips == forest(members, 8 - distance, distance)).all()
        for i, root in enumerate(by_flips):
            links = [m for m in members if int(m ^ members[i]).bit_count() <= distance]
            assert all(by_flips[np.searchsorted(members, m)] == root for m in links)
