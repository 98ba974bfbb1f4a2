from __future__ import annotations

import base64
import random
import re
from collections import Counter

from shelfwise.llm.quality_rules import BANDS, in_band, quality_rules
from tests.llm.helpers import ODD, by_id, documents, words

PROSE = [w for w in re.findall(r"\w+", __doc__ or "")] or [
    "the", "river", "ran", "past", "an", "old", "mill", "where", "children", "played", "after", "school",
    "and", "nobody", "knew", "why", "its", "wheel", "still", "turned", "each", "autumn", "morning", "slowly",
]


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {k for i, g in enumerate(grams) if g in twice for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_base_counts_match_brute_force(spark):
    rng = random.Random(3)
    rows = list(ODD)
    for i in range(20, 40):
        w = words(rng, 60, 30 if i % 2 else 4000)
        w[10:10] = w[:9] if i % 3 else []
        rows.append((i, "\n".join([" ".join(w), "a # line", " \t", "a # line", "<b>|"] * (1 + i % 2))))
    got = by_id(quality_rules(documents(spark, rows)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((i, *base(t)) for i, t in rows), key=repr)


def test_bands_keep_language_and_reject_the_rest(spark):
    rng = random.Random(4)
    noise = lambda n: base64.b64encode(rng.randbytes(n)).decode()  # noqa: E731  n a multiple of 3
    prose = " ".join(f"{rng.choice(PROSE)}{rng.choice(['', 's', 'ly', 'ing', ','])} {rng.choice(PROSE)}" for _ in range(3000))
    rows = [(n, prose[:n]) for n in (300, 700, 1500, 3000, 9000, 30000)]
    rows += [(100 + n, "\n".join(noise(57) for _ in range(n // 77))) for n in (3000, 30000)]
    rows += [(200, " ".join(f"{a} no" for a in range(10)) + " go" * 4000)]
    rows += [(201, prose[:9000] + "\n" + "\n".join(noise(57) for _ in range(400)))]  # most chunks are noise
    kept = {i for i, k in by_id(quality_rules(documents(spark, rows)), "kept") if k}
    assert kept == {300, 700, 1500, 3000, 9000, 30000}


def test_a_part_without_language_rejects_a_long_text(spark):
    rng = random.Random(5)
    noise = lambda n: "\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(n // 77))
    prose = lambda n: " ".join(words(rng, n // 5))[:n]
    few = " ".join(base64.b64encode(rng.randbytes(9)).decode()[:11] for _ in range(50))
    rows = [
        (1, prose(60_000)), (2, prose(60_000) + "\n" + noise(46_000)), (3, prose(20_000) + "\n" + noise(8_000)),
        (4, few), (5, prose(8192) + noise(1900)), (6, prose(200_000) + "\n" + noise(6_000)), (7, prose(8192 + 300)),
    ]
    got = {i: (k, n, bad) for i, k, n, bad in by_id(quality_rules(documents(spark, rows)), "kept", "n_chunks", "n_bad_chunks")}
    assert [i for i in got if got[i][0]] == [1, 6, 7]
    assert [got[i][1] for i in (4, 5, 7)] == [1, 3, 2]  # a tail is a chunk, or in the last one
    assert 0 < 20 * got[6][2] <= got[6][1] and got[2][2] * 2 <= got[2][1]


def test_bands_are_ordered():
    lows = [b[0] for b in BANDS]
    assert lows == sorted(lows) and all(x[1] >= y[1] for x, y in zip(BANDS[1:], BANDS[2:]))
    assert in_band(5.0, 10) and not in_band(0.05, 100_000)


def test_empty_table(spark):
    assert quality_rules(documents(spark, [])).count() == 0
