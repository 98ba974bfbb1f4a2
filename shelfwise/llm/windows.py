"""Exact naming of word windows: equal windows of a sequence get equal numbers.

Names are built by doubling: a window of 2n words is the pair of the names of its halves. Every
step compares content (through the names of shorter windows), so no hash can mislead.
"""

from __future__ import annotations

import numpy as np


def word_ids(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter(
        (numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words)
    )


def _paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    pairs = left * (int(right.max()) + 1) + right
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64).reshape(-1)


def window_names(ids: np.ndarray, width: int) -> np.ndarray:
    """Name of the window that starts at each position (len(ids) - width + 1 of them)."""
    if len(ids) < width:
        return np.empty(0, dtype=np.int64)
    names, size = ids, 1
    while size < width:
        step = min(size, width - size)
        names = _paired(names[: len(names) - step], names[step:])
        size += step
    return names


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins where ``starts`` is true."""
    edges = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return np.cumsum(edges[:-1]) > 0


def repeated_in_text(words: list[bytes], width: int) -> int:
    """Words in windows that are found twice or more in the text, the first included."""
    if len(words) <= width:
        return 0
    names = window_names(word_ids(words), width)
    counts = np.bincount(names)
    if counts.max() < 2:
        return 0
    return int(covered(counts[names] > 1, width, len(words)).sum())
