"""SimHash near-dedup with a byte-position inverted index and count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most d bits share at
least 8 - d of them at their positions, so that is the guaranteed number of matches. The index is
keyed by every choice of that many positional bytes (56 for d = 3): exactly the pairs that reach
the guaranteed number meet in a posting list, and no list can hold more fingerprints than its free
bytes have values. This replaces an index of single bytes, whose lists would hold nearly all pairs:
the count filter is met by construction (``near`` still tallies, but drops no pair of a list), and
pairs are verified by their bit distance. Only a spanning forest of
the links found leaves a list, never all pairs.

Postings are of distinct fingerprints, so copies of a document cost nothing, and lists stream
through a task one after the other. A list beyond ``PAIR_LIST`` members is searched by flipping
the free bits of each member instead of comparing pairs: the same links.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; texts
shorter than a shingle have one shingle of all their words; a null doc_id is never the smallest
unless all are null; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import in_small_batches, tidied, written
from shelfwise.llm.components import components

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
BYTES = 8
PAIR_LIST = 1024
#: Postings that one task makes.
TASK_POSTINGS = 2_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """Bit by bit, the majority of the shingles' XXH64 values."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    lasts = (ends - 1).tolist()[min(size, len(words)) - 1 :]
    counts, n = np.zeros(64, dtype=np.int64), len(lasts)
    for at in range(0, n, 65536):
        hashes = [
            xxhash.xxh64_intdigest(joined[a:b], SEED)
            for a, b in zip(starts[at : at + 65536], lasts[at : at + 65536])
        ]
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(documents: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, fingerprint (as a signed long)."""

    @tidied
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"]
            )

    chosen = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("full_text"))
    return in_small_batches(chosen).mapInArrow(compute, "doc_id long, fingerprint long")


def _posting_keys(print_: Column, matches: int) -> list[Column]:
    """One key per choice of ``matches`` byte positions: the choice's number, then its bytes."""
    keys = []
    for number, choice in enumerate(itertools.combinations(range(BYTES), matches)):
        mask = sum(0xFF << (8 * position) for position in choice)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.struct(F.lit(number).alias("choice"), print_.bitwiseAND(F.lit(mask)).alias("octets")))
    return keys


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def near(x: np.ndarray, matches: int, distance: int) -> np.ndarray:
    """Of XORed fingerprints: enough shared positional bytes, then the bit distance."""
    tally = (x[..., None] >> (8 * np.arange(BYTES, dtype=np.uint64)) & np.uint64(0xFF) == 0).sum(axis=-1)
    return (tally >= matches) & (_popcount(x) <= distance)


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]; the label is the smallest index of a component."""
    while True:
        la, lb = label[a], label[b]
        if not (la != lb).any():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != label[label]).any():
            label = label[label]


def forest(members: np.ndarray, matches: int, distance: int, pair_list: int = PAIR_LIST) -> np.ndarray:
    """Per member of a posting list (distinct, sorted), the smallest one it is linked to in it."""
    n = len(members)
    label = np.arange(n)
    if n <= pair_list:
        linked = near(members[:, None] ^ members[None, :], matches, distance)
        return members[_merged(label, *np.nonzero(np.triu(linked, 1)))]
    spread = np.bitwise_or.reduce(members ^ members[0])
    free = [np.uint64(1) << np.uint64(i) for i in range(64) if int(spread) >> i & 1]
    for flips in range(1, distance + 1):
        for chosen in itertools.combinations(free, flips):
            wanted = members ^ np.bitwise_or.reduce(np.array(chosen, dtype=np.uint64))
            at = np.minimum(np.searchsorted(members, wanted), n - 1)
            hit = members[at] == wanted
            label = _merged(label, np.flatnonzero(hit), at[hit])
    return members[label]


def _links(postings: DataFrame, matches: int, distance: int) -> DataFrame:
    """u, v of the forests of all posting lists; ``postings`` come sorted by key."""

    @tidied
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.int64)] * 3
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                columns = [batch.column(i).to_numpy() for i in range(3)]
                held = [np.concatenate(pair) for pair in zip(held, columns)]
            choice, octets, prints = held
            new = np.ones(len(prints), dtype=bool)
            new[1:] = (choice[1:] != choice[:-1]) | (octets[1:] != octets[:-1])
            starts = np.flatnonzero(new)
            if batch is not None:
                # The last list may go on in the next batch.
                last = starts[-1] if len(starts) else 0
                held = [x[last:] for x in held]
                starts, end = starts[:-1], last
            else:
                end = len(prints)
            sizes = np.diff(np.append(starts, end))
            prints = prints.view(np.uint64)
            two = starts[sizes == 2]
            linked = two[near(prints[two] ^ prints[two + 1], matches, distance)]
            us, vs = [prints[linked]], [prints[linked + 1]]
            for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
                members = np.sort(prints[start : start + size])
                roots = forest(members, matches, distance)
                us.append(members[roots != members])
                vs.append(roots[roots != members])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"]
            )

    return postings.mapInArrow(search, "u long, v long")


def simhash_components(
    documents: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of at
    most ``max_distance`` differing bits; below 8)."""
    if not 0 <= max_distance < BYTES:
        raise ValueError("max_distance must be 0 to 7")
    matches = BYTES - max_distance
    rows = written(fingerprints(documents, shingle_words, id_col, text_col), "fingerprints")
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    # Each fingerprint becomes a posting per choice of bytes: dealt out first, by their number.
    n_postings = rows.count() * math.comb(BYTES, matches)
    postings = (
        classes.repartition(max(1, -(-n_postings // TASK_POSTINGS)))
        .select("fingerprint", F.explode(F.array(*_posting_keys(F.col("fingerprint"), matches))).alias("key"))
        .select("key.choice", "key.octets", "fingerprint")
        .repartition("choice", "octets")
        .sortWithinPartitions("choice", "octets")
    )
    roots = components(_links(postings, matches, max_distance))
    rooted = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(rooted.join(ids, "root").select("fingerprint", "component_id"), "components")
    return rows.join(named, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_representatives(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns.
    Rows without doc_id are left out only if their component has a document with one."""
    found = simhash_components(documents, id_col=id_col, text_col=text_col)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.xxhash64("doc_id").alias("__stays"), F.col("doc_id").alias("__stays_id")
    )
    own = F.col(id_col).cast("long")
    same = (F.xxhash64(own) == F.col("__stays")) & own.eqNullSafe(F.col("__stays_id"))
    return documents.join(stay, same, "left_semi")


def op4_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
