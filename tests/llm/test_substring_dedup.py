from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from shelfwise.llm.substring_dedup import dedup_substrings, repeated_spans, word_hashes
from shelfwise.llm.windows import repeated_in_text, window_names
from tests.llm.helpers import ODD, by_id, documents, words


def brute(rows, width):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = set()
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] > 1:
                gone.update(range(s, s + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=repr)


def corpus(width):
    rng = random.Random(1)
    passage, second = words(rng, width + 20), words(rng, width)
    rows = list(ODD)
    for i in range(100, 140):
        body = words(rng, rng.randrange(0, 90))
        at = rng.randrange(len(body) + 1)
        kind = i % 5
        if kind == 0:
            body[at:at] = passage
        elif kind == 1:
            body[at:at] = passage[5 : 5 + width]
        elif kind == 2:
            body[at:at] = second[:-1]  # one word short of a repeat
        rows.append((i, "  ".join(body[:at]) + "\n" + "\t".join(body[at:])))
    rows += [(200, " ".join(["la"] * (3 * width))), (201, " ".join(["ab", "cd"] * width))]
    rows += [(202, rows[-5][1]), (203, rows[-5][1]), (204, "only " * (width - 1)), (None, rows[20][1])]
    return rows


@pytest.mark.parametrize("group_segments", [32_768, 1])
@pytest.mark.parametrize("width,prefix", [(35, 8), (6, 2)])
def test_matches_brute_force(spark, width, prefix, group_segments):
    rows = corpus(width)
    found = dedup_substrings(documents(spark, rows), width, prefix, group_segments=group_segments)
    assert by_id(found, "n_words", "n_removed", "kept_text") == brute(rows, width)


def test_empty_table(spark):
    assert dedup_substrings(documents(spark, [])).count() == 0


def test_windows_are_named_by_content():
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2])
    assert window_names(ids, 3).tolist()[0:3] == window_names(ids, 3).tolist()[3:6]
    assert len(window_names(ids, 9)) == 0
    assert repeated_in_text(b"a b c d e f g h i".split(), 8) == 0
    assert repeated_in_text([b"x"] * 9, 8) == 9
    assert repeated_spans([b"a b c d", b"z b c d", b"q"], 3) == [(0, 1, 4), (1, 1, 4)]


def test_word_hashes_follow_words_not_places():
    data = ("yes no  yes\t" + "long" * 40 + " " + "long" * 40).encode()
    hashes, starts = word_hashes(data)
    assert starts.tolist() == [0, 4, 8, 12, 173]
    assert hashes[0] == hashes[2] != hashes[1] and hashes[3] == hashes[4]
    assert len(word_hashes(b"")[0]) == 0
