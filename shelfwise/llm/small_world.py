"""A hierarchical navigable small-world graph over unit vectors, as flat neighbour arrays.

Layer 0 holds every vector, each higher layer a random sixteenth of the one below. Layers are built
from the top down, each in batches that grow with the layer: a batch searches what stands so far
(descending through the finished layers above), adds its own members as candidates, and links each
member to a diverse choice of what it found. Links are made both ways; a list that overflows is
chosen anew by the same rule. All work on a batch is numpy over its members at once.

Nearness is the inner product of unit vectors in double precision (near copies differ too little for single).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links of a vector on the layers above 0; twice as many on layer 0.
LINKS = 16
#: Best vectors kept while a new one looks for its links.
BUILD_BEAM = 64
#: Best unexpanded vectors whose lists are read in one step.
WIDTH = 4
#: Vectors searched at once. Their marks take one byte for each vector of the layer.
BATCH = 512
FIRST_BATCH = 64
NONE = -1


@dataclass
class Layer:
    """``nodes``: which vectors stand here; ``neighbours``: one row of places in ``nodes`` for each, filled
    up with ``NONE``; ``entries``: places from which every place can be reached."""

    nodes: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray


def _by_row(rows: np.ndarray, n: int, width: int, *values: tuple[np.ndarray, float]) -> list[np.ndarray]:
    """Ragged values, sorted by their row, as matrices of ``n`` rows with what fills them up."""
    first = np.searchsorted(rows, np.arange(n))
    column = np.arange(len(rows)) - first[rows]
    out = []
    for x, fill in values:
        matrix = np.full((n, width), fill, dtype=x.dtype)
        matrix[rows, column] = x
        out.append(matrix)
    return out


def _best(ids: np.ndarray, scores: np.ndarray, marks: np.ndarray, keep: int):
    """The best ``keep`` of each row, unordered."""
    if ids.shape[1] <= keep:
        return ids, scores, marks
    at = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
    return tuple(np.take_along_axis(x, at, axis=1) for x in (ids, scores, marks))


def beam_search(
    points: np.ndarray, neighbours: np.ndarray, asked: np.ndarray, starts: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``asked`` the best ``beam`` places found and their scores, best first, filled up with
    ``NONE`` and -inf. ``starts``: a row of places for each (may hold ``NONE`` and repeats)."""
    n, size = len(asked), len(points)
    seen = np.zeros(n * size, dtype=bool)
    ids = np.full((n, 0), NONE, dtype=np.int64)
    scores = np.full((n, 0), -np.inf, dtype=np.float64)
    open_ = np.zeros((n, 0), dtype=bool)
    row = np.repeat(np.arange(n), starts.shape[1])
    place = starts.ravel().astype(np.int64)
    while True:
        real = place != NONE
        keys = row[real] * size + place[real]
        keys = np.unique(keys[~seen[keys]])
        seen[keys] = True
        row, place = keys // size, keys % size
        new = np.einsum("ij,ij->i", points[place], asked[row])
        if ids.shape[1] >= beam:
            better = new > scores.min(axis=1)[row]
            row, place, new = row[better], place[better], new[better]
        if len(row):
            width = int(np.bincount(row, minlength=n).max())
            more, values, fresh = _by_row(row, n, width, (place, NONE), (new, -np.inf), (np.ones(len(row), dtype=bool), False))
            ids, scores, open_ = _best(
                np.hstack([ids, more]), np.hstack([scores, values]), np.hstack([open_, fresh]), beam
            )
        waiting = np.where(open_, scores, -np.inf)
        width = min(WIDTH, waiting.shape[1])
        if not width or not open_.any():
            break
        at = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
        chosen = np.take_along_axis(open_, at, axis=1)
        np.put_along_axis(open_, at, False, axis=1)
        which, column = np.nonzero(chosen)
        lists = neighbours[ids[which, at[which, column]]]
        row, place = np.repeat(which, lists.shape[1]), lists.ravel().astype(np.int64)
    order = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def diverse(points: np.ndarray, candidates: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Per row the links to keep of its candidates (places or ``NONE``): from the nearest on, those that
    are nearer to the row's own vector than to any link kept so far; what is missing to ``most`` is
    filled up with the nearest of the others."""
    order = np.argsort(-scores, axis=1, kind="stable")
    candidates, scores = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(scores, order, axis=1)
    real = candidates != NONE
    vectors = points[candidates]
    between = vectors @ vectors.transpose(0, 2, 1)
    n, width = candidates.shape
    closest = np.full((n, width), -np.inf, dtype=np.float64)
    kept = np.zeros((n, width), dtype=bool)
    count = np.zeros(n, dtype=np.int64)
    for i in range(width):
        take = real[:, i] & (count < most) & (scores[:, i] > closest[:, i])
        kept[:, i] = take
        count += take
        np.maximum(closest, np.where(take[:, None], between[:, i], -np.inf), out=closest)
    # Kept first, then the others by nearness, the empty last.
    rank = np.where(kept, 0, np.where(real, 1, 2)) * width + np.arange(width)
    chosen = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(candidates, chosen, axis=1)
    if width < most:
        out = np.hstack([out, np.full((n, most - width), NONE, dtype=out.dtype)])
    return out


class _Growing:
    """A layer under construction."""

    def __init__(self, points: np.ndarray, most: int):
        self.points, self.most = points, most
        self.neighbours = np.full((len(points), most), NONE, dtype=np.int32)
        self.done = 0

    def add(self, upto: int, starts: np.ndarray) -> None:
        """Places done..upto join; ``starts``: where each begins to search."""
        new = np.arange(self.done, upto)
        asked = self.points[new]
        found = np.full((len(new), 0), NONE, dtype=np.int64)
        scores = np.full((len(new), 0), -np.inf, dtype=np.float64)
        if self.done:
            found, scores = beam_search(self.points[: self.done], self.neighbours[: self.done], asked, starts, BUILD_BEAM)
        own = asked @ asked.T
        np.fill_diagonal(own, -np.inf)
        width = min(self.most, len(new))
        at = np.argpartition(-own, width - 1, axis=1)[:, :width]
        mates, near = new[at], np.take_along_axis(own, at, axis=1)
        mates[near == -np.inf] = NONE
        links = diverse(self.points, np.hstack([found, mates]), np.hstack([scores, near]), self.most)
        self.neighbours[new] = links
        self.done = upto
        self._link_back(new, links)

    def _link_back(self, new: np.ndarray, links: np.ndarray) -> None:
        source, column = np.nonzero(links != NONE)
        target, source = links[source, column], new[source]
        known = (self.neighbours[target] == source[:, None]).any(axis=1)
        target, source = target[~known], source[~known]
        if not len(target):
            return
        scores = np.einsum("ij,ij->i", self.points[target], self.points[source])
        order = np.lexsort((-scores, target))
        target, source = target[order], source[order]
        lists, row = np.unique(target, return_inverse=True)
        # The nearest few of the newcomers: a list can take no more.
        column = np.arange(len(row)) - np.searchsorted(row, row)
        few = column < self.most
        row, source = row[few], source[few]
        width = int(np.bincount(row).max())
        for a in range(0, len(lists), 4 * BATCH):
            part = (row >= a) & (row < a + 4 * BATCH)
            owners = lists[a : a + 4 * BATCH]
            (more,) = _by_row(row[part] - a, len(owners), width, (source[part].astype(np.int32), NONE))
            self.neighbours[owners] = self._chosen(owners, np.hstack([self.neighbours[owners], more]))

    def _chosen(self, owners: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        order = np.argsort(candidates == NONE, axis=1, kind="stable")
        candidates = np.take_along_axis(candidates, order, axis=1)
        out = candidates[:, : self.most].copy()
        over = np.flatnonzero((candidates != NONE).sum(axis=1) > self.most)
        if len(over):
            full = candidates[over]
            scores = np.einsum("ijk,ik->ij", self.points[full], self.points[owners[over]])
            scores[full == NONE] = -np.inf
            out[over] = diverse(self.points, full, scores, self.most)
        return out


def _entries(neighbours: np.ndarray) -> np.ndarray:
    """Place 0, and one place of each part that cannot be reached from those before it."""
    reached = np.zeros(len(neighbours), dtype=bool)
    entries, first = [], 0
    while not reached.all():
        first += int(np.argmin(reached[first:]))
        entries.append(first)
        reached[first] = True
        edge = np.array([first])
        while len(edge):
            near = neighbours[edge].ravel()
            near = np.unique(near[near != NONE])
            edge = near[~reached[near]]
            reached[edge] = True
    return np.array(entries, dtype=np.int64)


def _descended(points: np.ndarray, layers: list[Layer], asked: np.ndarray, entries: np.ndarray | None = None) -> np.ndarray:
    """The vector nearest to each of ``asked`` that a greedy walk down the layers ends at."""
    at = None
    for layer in layers:
        starts = np.repeat(layer.entries[None, :], len(asked), axis=0)
        if at is not None:
            place = np.searchsorted(layer.nodes, at)
            starts = np.hstack([place[:, None], starts])
        found, _ = beam_search(points[layer.nodes], layer.neighbours, asked, starts, 1)
        at = layer.nodes[found[:, 0]]
    return at


def build(points: np.ndarray, seed: int = 0, links: int = LINKS) -> list[Layer]:
    """Layers from the top to layer 0. ``points``: unit vectors as rows, double precision."""
    n = len(points)
    draws = np.random.default_rng(seed).random(n)
    height = np.floor(-np.log(np.maximum(draws, 1e-12)) / np.log(links)).astype(np.int64)
    layers: list[Layer] = []
    for level in range(int(height.max(initial=0)), -1, -1):
        nodes = np.flatnonzero(height >= level)
        here = points[nodes]
        growing = _Growing(here, 2 * links if level == 0 else links)
        while growing.done < len(nodes):
            upto = min(len(nodes), growing.done + min(BATCH, max(FIRST_BATCH, growing.done)))
            growing.add(upto, _starts(points, layers, nodes, growing.done, here[growing.done : upto]))
        layers.append(Layer(nodes, growing.neighbours, _entries(growing.neighbours)))
    return layers


def _starts(points: np.ndarray, layers: list[Layer], nodes: np.ndarray, done: int, asked: np.ndarray) -> np.ndarray:
    """Where newcomers start on a layer of which ``done`` places stand: at the place the layers above lead
    to, if it stands already, and at place 0."""
    starts = np.zeros((len(asked), 2), dtype=np.int64)
    if layers:
        place = np.searchsorted(nodes, _descended(points, layers, asked))
        starts[:, 1] = np.where(place < done, place, NONE)
    return starts


def search(points: np.ndarray, layers: list[Layer], asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``asked`` the best ``beam`` vectors found (``NONE`` where there are fewer), best first."""
    found, scores = [], []
    for a in range(0, len(asked), BATCH):
        part = asked[a : a + BATCH]
        low = layers[-1]
        starts = np.repeat(low.entries[None, :], len(part), axis=0)
        if len(layers) > 1:
            starts = np.hstack([_descended(points, layers[:-1], part)[:, None], starts])
        ids, values = beam_search(points, low.neighbours, part, starts, beam)
        gap = ((0, 0), (0, beam - ids.shape[1]))
        found.append(np.pad(ids, gap, constant_values=NONE))
        scores.append(np.pad(values, gap, constant_values=-np.inf))
    return np.vstack(found), np.vstack(scores)
