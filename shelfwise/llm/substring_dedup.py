"""Substring dedup by prefix-partitioned windows of words, in place of suffix trees.

A word sequence of ``WIDTH`` words that starts at two or more places is a repeat; every word that
a repeat covers goes. Repeats are the nodes at depth ``WIDTH`` of the corpus's suffix tree that
have two or more leaves (maximal repeats are their unions). No tree is built, only
its nodes at that depth are found, as windows that occur twice:

1. Suffixes are put into groups by an anchor prefix: of the ``PREFIX``-word prefixes inside a
   window, the one with the smallest hash. Equal windows have the same anchor at the same place,
   so they meet in one group, and neighbouring suffixes share their anchor, so one stored segment
   serves about a dozen of them.
2. Anchor prefixes are counted over all documents. A prefix that occurs once heads no repeat, and
   its suffixes go no further; that leaves the repeated share of the corpus.
3. A prefix whose group is larger than ``GROUP_SEGMENTS`` is lengthened in one step
   to the full window, where each group is one node of the tree and only its count is needed
   (combined before the shuffle, so no hot passage gathers in a task).
4. The other groups are small. Their windows are named in the task that receives them, level by
   level (depths 1, 2, 4, ... ``WIDTH``): two suffixes share a node when their halves do, compared
   by content. Nodes at full depth with two leaves give the repeats.

Positions go back to their documents and the covered words are left out.

Defined cases: null and empty texts have no words; a document shorter than the window keeps all;
repeats inside one document count, overlapping ones too; repeated rows are documents of their own
(so each repeats the other); a null doc_id is carried along; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import written
from shelfwise.llm.windows import covered, window_names

WIDTH = 35
PREFIX = 8
GROUP_SEGMENTS = 32_768
SLICE_BYTES = 2 << 20
TREE_SEGMENTS = 30_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LONG_WORD = 48


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and byte start of each word. Hashes choose groups; they never decide equality."""
    octets = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[octets], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    hashes = lengths.astype(np.uint64)
    active = np.arange(len(starts))
    for j in range(int(min(lengths.max(initial=0), _LONG_WORD))):
        active = active[lengths[active] > j]
        hashes[active] = hashes[active] * np.uint64(0x100000001B3) + octets[starts[active] + j]
    for i in np.flatnonzero(lengths > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return _mixed(hashes), starts


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest (then leftmost) value in each run of ``width``."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at


def anchors_of(data: bytes, doc_starts: np.ndarray, width: int, prefix: int):
    """Documents lie one after the other in ``data`` at byte ``doc_starts``, with a space between.
    Returns doc (index), gram, anchor, first and last window start, in words of the document."""
    hashes, starts = word_hashes(data)
    none = np.empty(0, dtype=np.int64)
    if len(hashes) < width:
        return none, none, none, none, none
    doc = np.searchsorted(doc_starts, starts, side="right") - 1
    first_word = np.searchsorted(starts, doc_starts, side="left")
    grams = np.zeros(len(hashes) - prefix + 1, dtype=np.uint64)
    for j in range(prefix):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(grams) + j]
    grams = _mixed(grams)
    anchor = _least(grams, width - prefix + 1)
    window = np.arange(len(anchor))
    valid = doc[window] == doc[window + width - 1]
    window, anchor = window[valid], anchor[valid]
    if not len(window):
        return none, none, none, none, none
    # A run of windows with one anchor (an anchor lies inside its windows, so in their document).
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(window)) - 1
    of = doc[window[begin]]
    base = first_word[of]
    return of, grams[anchor[begin]], anchor[begin] - base, window[begin] - base, window[end] - base


def _slices(batches: Iterator[pa.RecordBatch]):
    """Runs of rows of about ``SLICE_BYTES`` of text: (row lists by column)."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(c for c in batch.columns)):
            text = row[-1].as_py() or ""
            if rows and held + len(text) > SLICE_BYTES:
                yield rows
                rows, held = [], 0
            rows.append((*(x.as_py() for x in row[:-1]), text))
            held += len(text)
    if rows:
        yield rows


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid (a hash of id and text), doc_id, full_text."""
    chosen = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("full_text"))
    return chosen.select(F.xxhash64("doc_id", "full_text").alias("rid"), "doc_id", "full_text")


def _anchors(keyed: DataFrame, width: int, prefix: int) -> DataFrame:
    """rid, gram, place: anchor, windows before it and number of further windows, in one long."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            texts = [text.encode() for _, text in rows]
            sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
            doc_starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            of, gram, at, first, last = anchors_of(b" ".join(texts), doc_starts, width, prefix)
            rid = np.array([r for r, _ in rows], dtype=np.int64)[of]
            place = (at << 16) + ((at - first) << 8) + (last - first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(gram.astype(np.uint64).view(np.int64)), pa.array(place, pa.int64())],
                names=["rid", "gram", "place"],
            )

    return keyed.select("rid", "full_text").mapInArrow(find, "rid long, gram long, place long")


_SEGMENT = "gram long, d1 long, d2 long, doc_id long, rid long, first long, words binary"


def _segments(hits: DataFrame, width: int, heavy: bool) -> DataFrame:
    """Of each document with places: a row per segment whose prefix is not heavy, or (``heavy``) a
    row per window of those whose prefix is (``words`` null, d1 and d2 its digest)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for rid, doc_id, text, places in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            ):
                words = (text.as_py() or "").encode().split()
                for place in places.as_py():
                    if place["heavy"] != heavy:
                        continue
                    code = place["place"]
                    first = (code >> 16) - (code >> 8 & 0xFF)
                    n = (code & 0xFF) + 1
                    if first < 0 or first + n + width - 1 > len(words):
                        continue  # another text with the same rid
                    if not heavy:
                        segment = b" ".join(words[first : first + n + width - 1])
                        out.append((place["gram"], None, None, doc_id, rid, first, segment))
                        held += len(segment)
                        continue
                    for at in range(first, first + n):
                        digest = hashlib.blake2b(b" ".join(words[at : at + width]), digest_size=16).digest()
                        d1, d2 = np.frombuffer(digest, dtype="<i8").tolist()
                        out.append((place["gram"], d1, d2, doc_id, rid, at, None))
                    held += 64 * n
                if held > SLICE_BYTES:
                    yield _rows(out)
                    out, held = [], 0
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        names = ["gram", "d1", "d2", "doc_id", "rid", "first", "words"]
        types = [pa.int64()] * 6 + [pa.binary()]
        columns = list(zip(*out)) or [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return hits.mapInArrow(cut, _SEGMENT)


def repeated_spans(segments: list[bytes], width: int) -> list[tuple[int, int, int]]:
    """(segment, first word, end) of the runs of words that repeats among the segments cover."""
    numbers: dict[bytes, int] = {}
    ids: list[int] = []
    sizes = []
    for segment in segments:
        words = segment.split(b" ")
        sizes.append(len(words))
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
    sizes = np.array(sizes, dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    names = window_names(np.array(ids, dtype=np.int64), width)
    inside = owner[: len(names)] == owner[width - 1 :]
    counts = np.bincount(names[inside], minlength=int(names.max(initial=0)) + 1)
    starts = np.zeros(len(ids), dtype=bool)
    starts[: len(names)] = inside & (counts[names] > 1)
    gone = covered(starts, width, len(ids))
    edge = np.ones(len(ids), dtype=bool)
    edge[1:] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(ids))
    keep = gone[begin]
    begin, end = begin[keep], end[keep]
    base = (np.cumsum(sizes) - sizes)[owner[begin]]
    return list(zip(owner[begin].tolist(), (begin - base).tolist(), (end - base).tolist()))


def _tree_spans(segments: DataFrame, width: int) -> DataFrame:
    """doc_id, rid, first, last of covered words, from groups sorted by prefix. Whole groups are
    taken until there are ``TREE_SEGMENTS`` segments; a group has at most ``GROUP_SEGMENTS``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                if sum(map(len, held)) < TREE_SEGMENTS:
                    continue
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            grams = table.column("gram").to_numpy()
            cut = len(grams)
            if batch is not None:
                cut = int(np.flatnonzero(grams != grams[-1])[-1]) + 1 if (grams != grams[-1]).any() else 0
            held = table.slice(cut).to_batches()
            table = table.slice(0, cut)
            if not cut:
                continue
            found = repeated_spans(table.column("words").to_pylist(), width)
            at = np.array([f for f, _, _ in found], dtype=np.int64)
            first = table.column("first").to_numpy()[at] if len(at) else at
            taken = table.select(["doc_id", "rid"]).take(pa.array(at, pa.int64()))
            yield from pa.table(
                {
                    "doc_id": taken.column("doc_id"),
                    "rid": taken.column("rid"),
                    "first": pa.array(first + np.array([a for _, a, _ in found], dtype=np.int64)),
                    "last": pa.array(first + np.array([b for _, _, b in found], dtype=np.int64)),
                }
            ).combine_chunks().to_batches()

    ordered = segments.select("gram", "doc_id", "rid", "first", "words")
    ordered = ordered.repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(build, "doc_id long, rid long, first long, last long")


def dedup_substrings(
    documents: DataFrame,
    width: int = WIDTH,
    prefix: int = PREFIX,
    group_segments: int = GROUP_SEGMENTS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space)."""
    if not prefix <= width <= 255:
        raise ValueError("needs prefix <= width <= 255")
    keyed = _keyed(documents, id_col, text_col)
    anchors = _anchors(keyed, width, prefix)
    repeated = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    is_heavy = F.col("n") > group_segments
    places = written(
        anchors.join(repeated, "gram")
        .groupBy("rid")
        .agg(
            F.collect_set(F.struct("gram", "place", is_heavy.alias("heavy"))).alias("places"),
            F.max(is_heavy).alias("any_heavy"),
        ),
        "places",
    )

    def cut(heavy: bool) -> DataFrame:
        some = places.filter("any_heavy") if heavy else places
        hits = keyed.join(some, "rid").select("rid", "doc_id", "full_text", "places")
        return _segments(hits, width, heavy)

    found = _tree_spans(cut(heavy=False), width)
    if not places.filter("any_heavy").isEmpty():
        windows = cut(heavy=True).select("d1", "d2", "doc_id", "rid", "first")
        nodes = windows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = found.unionByName(
            windows.join(nodes, ["d1", "d2"]).select(
                "doc_id", "rid", "first", (F.col("first") + width).alias("last")
            )
        )
    # Joined on rid alone, as the places were, so the texts dealt out for them serve again.
    spans = found.groupBy("rid").agg(F.collect_set(F.struct("doc_id", "first", "last")).alias("spans"))
    marked = keyed.join(spans, "rid", "left").select("doc_id", "full_text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, spans_of in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for span in spans_of.as_py() or ():
                    if span["doc_id"] == doc_id:
                        gone[span["first"]] += 1
                        gone[span["last"]] -= 1
                stays = np.cumsum(gone[:-1]) == 0
                kept = list(itertools.compress(words, stays.tolist()))
                out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            columns = list(zip(*out)) or [[]] * 4
            types = [pa.int64()] * 3 + [pa.string()]
            names = ["doc_id", "n_words", "n_removed", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return marked.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_text string")


ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), word AS (
  SELECT row_no, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts
), spot AS (
  SELECT row_no, words, unnest(range(1, len(words) - 33)) AS i FROM texts WHERE len(words) >= 35
), sequence AS (
  SELECT row_no, i, array_to_string(words[i:i + 34], ' ') AS words FROM spot
), repeat AS (
  SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY words) AS n FROM sequence) WHERE n > 1
), judged AS (
  SELECT row_no, i, word,
         max(repeat.i) OVER (PARTITION BY row_no ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW)
           IS NOT NULL AS gone
  FROM word LEFT JOIN repeat USING (row_no, i)
), kept AS (
  SELECT row_no, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept_text
  FROM judged GROUP BY row_no
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (row_no)
"""


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
