"""Ranked lexical search: MaxScore over a sharded inverted index, with joint bounds of term pairs.

The documents are indexed in shards of at most ``SHARD_DOCS``; a shard is one row of flat arrays, built
where the documents are read, and nothing of a text is shuffled. Two tables are written:

1. counts: per shard the postings (document, occurrences) of every term the queries use, and the
   documents' lengths. N, L and the document frequencies are sums over all its rows.
2. impacts: postings carry their exact score part, each term its maximum in the shard; and for the
   *pairs* of terms that the queries hold next to each other in order of document frequency, the
   intersection of the two lists with the joint impact of every document in it, and its maximum.

A query is a set of units: its pairs, and a single term if it has an odd number. A unit adds to a score
at most max(joint maximum, either term's own maximum), which is less than the sum of the two maxima
whenever no document holds both at their best. The search of a shard starts with a threshold: the
tenth best score so far, raised by the full scores of the documents that lead on the strongest units. In
ascending order of their bounds, units are non-essential as long as their bounds together stay below
the threshold: a document that holds no term of any other unit cannot enter. Only documents in
essential lists are scored; then the non-essential units are added from the strongest down, and a
document is dropped as soon as what it has and the bounds that are left stay below the threshold. A
unit is looked up in the intersection list first; a document outside it is held against the larger of
the two single maxima, which drops most before either list is read. Bounds are exact integers and a
document equal to the threshold is never dropped, so the ten best are those of full scoring.

Shards are merged per task (each carries its threshold on) and then per item. The queries are worked off
in blocks of at most ``BLOCK_TERMS`` terms, so what is sent to the tasks is bounded; each block indexes
the terms it uses.

Defined cases: a null text has no terms, nor has an empty one or one of separators only; such
documents do not count in N. A document without an id counts in N, L and the frequencies but is never
listed. Repeated ids are documents of their own, each listed. Equal scores rank by ascending id. Items
of the same id (or a null id) are one item with the terms of all their rows; an item without a term
that any document holds has no rows. An empty table on either side gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import in_small_batches, tidied, written

TOP = 10
#: Documents and words of a shard. Only speed and memory depend on them.
SHARD_DOCS = 2048
SHARD_WORDS = 4_000_000
#: (item, term) rows that one block of queries sends to the tasks (about 40 bytes each).
BLOCK_TERMS = 200_000
#: Documents scored in full to raise a shard's threshold.
LEADERS = 32

#: Stands for a missing id; such a document has no impacts, so it is never listed.
NO_ID = -(1 << 63)

#: Fixed values of the score: weights in thousandths, saturation and length normalisation in percent.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, SATURATION, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 8, 90

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"

#: Flat arrays are stored as bytes: 16-bit places (a shard's documents), 32-bit term and pair numbers,
#: 64-bit ids, counts and impacts.
_TYPES = {
    "doc_ids": "<i8", "lengths": "<i8", "terms": "<i4", "ends": "<i8", "places": "<u2", "tfs": "<i8", "impacts": "<i8",
    "maxima": "<i8", "pairs": "<i4", "pair_ends": "<i8", "pair_places": "<u2", "pair_impacts": "<i8", "pair_maxima": "<i8",
}
_BYTES = pa.binary()
COUNTS = pa.schema(
    [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("df", pa.map_(pa.int32(), pa.int64()))]
    + [(c, _BYTES) for c in ("doc_ids", "lengths", "terms", "ends", "places", "tfs")]
)
IMPACTS = pa.schema([(c, _BYTES) for c in _TYPES if c not in ("lengths", "tfs")])
BEST = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {_BYTES: "binary", pa.map_(pa.int32(), pa.int64()): "map<int, long>", pa.int32(): "int", pa.int64(): "long"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _fold() -> bytes:
    """Byte table: letters A-Z to lower case, ASCII other than letters and digits to a space."""
    keep = lambda b: b >= 0x80 or chr(b).isalnum()
    return bytes(ord(chr(b).lower()) if b < 0x80 and keep(b) else b if keep(b) else 0x20 for b in range(256))


FOLD = _fold()


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term), each pair once."""
    folded = F.translate(F.col(text_col), UPPER, LOWER)
    found = F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(1)))
    return items.select(F.col(id_col).alias("item_id"), found.alias("term")).distinct()


class _Shard:
    """Postings of the documents gathered so far."""

    def __init__(self):
        self.ids, self.lengths, self.held, self.codes, self.tfs = [], [], [], [], []
        self.words = 0

    def add(self, doc_id, text, vocabulary: dict[bytes, int]) -> None:
        words = terms_of(text)
        counts = Counter(words)
        hits = counts.keys() & vocabulary.keys()
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.held.append(len(hits))
        self.codes += map(vocabulary.__getitem__, hits)
        self.tfs += map(counts.__getitem__, hits)
        self.words += len(words)

    def row(self) -> pa.RecordBatch:
        codes = np.array(self.codes, dtype=np.int32)
        places = np.repeat(np.arange(len(self.ids)), self.held)
        order = np.argsort(codes, kind="stable")
        terms, counts = np.unique(codes, return_counts=True)
        # A document without an id keeps its place under NO_ID.
        ids = [NO_ID if x is None else x for x in self.ids]
        tfs = np.array(self.tfs, dtype=np.int64)
        arrays = [ids, self.lengths, terms, np.cumsum(counts), places[order], tfs[order]]
        totals = [sum(map(bool, self.lengths)), sum(self.lengths), list(zip(terms.tolist(), counts.tolist()))]
        return _one_row([*totals, *arrays], COUNTS)


def _one_row(values: list, schema: pa.Schema) -> pa.RecordBatch:
    flat = [
        np.asarray(x, dtype=_TYPES[f.name]).tobytes() if f.type == _BYTES else x for x, f in zip(values, schema)
    ]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(flat, schema)], schema=schema)


def _arrays(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    names = [x for x in batch.schema.names if x in _TYPES]
    return {x: np.frombuffer(batch.column(x)[i].as_buffer(), dtype=_TYPES[x]) for x in names}


def _slices(keys: np.ndarray, ends: np.ndarray) -> dict[int, slice]:
    starts = np.concatenate([[0], ends[:-1]])
    return {int(k): slice(int(a), int(b)) for k, a, b in zip(keys, starts, ends)}


def count_postings(
    documents: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str, shard_docs: int = SHARD_DOCS
) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    @tidied
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard = sent.value, _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, text.as_py(), known)
                if len(shard.ids) >= shard_docs or shard.words >= SHARD_WORDS:
                    yield shard.row()
                    shard = _Shard()
        if shard.ids:
            yield shard.row()

    chosen = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("full_text"))
    return in_small_batches(chosen).mapInArrow(index, _ddl(COUNTS))


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_units(terms: list[int], df: dict[int, int]) -> list[tuple[int, ...]]:
    """A query's terms, most frequent first, in pairs; a last one may stay alone. Terms that no document
    holds are left out."""
    order = sorted((t for t in terms if df.get(t)), key=lambda t: (-df[t], t))
    return [tuple(sorted(order[i : i + 2])) for i in range(0, len(order), 2)]


def with_impacts(counts: DataFrame, n_docs: int, n_terms: int, weights: dict[int, int], pairs: list) -> DataFrame:
    """The counts table with impacts, maxima and the lists of the numbered ``pairs``."""
    sent = counts.sparkSession.sparkContext.broadcast((weights, pairs))

    @tidied
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_weights, known_pairs = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                yield _weighed(_arrays(batch, i), n_docs, n_terms, known_weights, known_pairs)

    return counts.mapInArrow(weigh, _ddl(IMPACTS))


def _weighed(row: dict[str, np.ndarray], n_docs: int, n_terms: int, weights: dict[int, int], pairs: list) -> pa.RecordBatch:
    terms, ends, places, tfs = row["terms"], row["ends"], row["places"], row["tfs"]
    base = 100 - LENGTH_SHARE + (LENGTH_SHARE * row["lengths"] * n_docs) // max(n_terms, 1)
    weight = np.repeat(np.array([weights[int(t)] for t in terms], dtype=np.int64), np.diff(ends, prepend=0))
    impacts = weight * ((IMPACT_SCALE * tfs) // (TF_SCALE * tfs + SATURATION * base[places]))
    impacts[(row["doc_ids"] == NO_ID)[places]] = 0
    own = _slices(terms, ends)
    maxima = [int(impacts[own[int(t)]].max()) for t in terms]
    here, pair_places, pair_impacts = [], [], []
    for number, (a, b) in enumerate(pairs):
        if a in own and b in own:
            found, joint = _intersection(places[own[a]], impacts[own[a]], places[own[b]], impacts[own[b]])
            if len(found):
                here.append(number)
                pair_places.append(found)
                pair_impacts.append(joint)
    none = [np.empty(0, dtype=np.int64)]
    pair_ends, pair_maxima = np.cumsum([len(x) for x in pair_places]), [int(x.max()) for x in pair_impacts]
    joined = np.concatenate(pair_places or none), np.concatenate(pair_impacts or none)
    return _one_row([row["doc_ids"], terms, ends, places, impacts, maxima, here, pair_ends, *joined, pair_maxima], IMPACTS)


def _lookup(places: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are in the sorted ``places``, and where."""
    at = np.searchsorted(places, wanted)
    held = at < len(places)
    held[held] = places[at[held]] == wanted[held]
    return held, at[held]


def _intersection(places_a, impacts_a, places_b, impacts_b) -> tuple[np.ndarray, np.ndarray]:
    if len(places_a) > len(places_b):
        places_a, impacts_a, places_b, impacts_b = places_b, impacts_b, places_a, impacts_a
    held, at = _lookup(places_b, places_a)
    return places_a[held], impacts_a[held] + impacts_b[at]


class _Lists:
    """One shard's impact table."""

    def __init__(self, row: dict[str, np.ndarray]):
        self.ids, self.places, self.impacts = row["doc_ids"], row["places"], row["impacts"]
        self.pair_places, self.pair_impacts = row["pair_places"], row["pair_impacts"]
        self.own, self.joint = _slices(row["terms"], row["ends"]), _slices(row["pairs"], row["pair_ends"])
        self.maxima = dict(zip(row["terms"].tolist(), row["maxima"].tolist()))
        self.pair_maxima = dict(zip(row["pairs"].tolist(), row["pair_maxima"].tolist()))
        self.score = np.zeros(len(self.ids), dtype=np.int64)

    def term(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.places[self.own[t]], self.impacts[self.own[t]]

    def pair(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        return self.pair_places[self.joint[number]], self.pair_impacts[self.joint[number]]

    def bound(self, unit: tuple[int, tuple[int, ...]]) -> tuple[int, int]:
        """The most the unit can add: to any document, and to one outside the intersection list."""
        number, terms = unit
        alone = max((self.maxima.get(t, 0) for t in terms), default=0)
        return max(alone, self.pair_maxima.get(number, 0)), alone


def _add_unit(lists: _Lists, unit, docs: np.ndarray, scores: np.ndarray, least: int, alone: int):
    """Adds a unit to the scores of ``docs``. Documents outside the intersection that cannot reach
    ``least`` with the larger single maximum are dropped."""
    number, terms = unit
    joint = np.zeros(len(docs), dtype=bool)
    if number in lists.joint:
        places, impacts = lists.pair(number)
        joint, at = _lookup(places, docs)
        scores[joint] += impacts[at]
    keep = joint | (scores + alone >= least)
    if not keep.all():
        docs, scores, joint = docs[keep], scores[keep], joint[keep]
    rest = np.flatnonzero(~joint)
    for t in terms:
        if t in lists.own and len(rest):
            places, impacts = lists.term(t)
            held, at = _lookup(places, docs[rest])
            scores[rest[held]] += impacts[at]
            rest = rest[~held]
    return docs, scores


def _completed(lists: _Lists, units, docs: np.ndarray, scores: np.ndarray, least: int):
    """Adds the units, strongest first, dropping what cannot reach ``least``. units: (bound, alone, unit)
    in ascending order of the bound."""
    left = sum(bound for bound, _, _ in units)
    for bound, alone, unit in reversed(units):
        keep = scores + left >= least
        if not keep.all():
            docs, scores = docs[keep], scores[keep]
        if not len(docs):
            break
        left -= bound
        docs, scores = _add_unit(lists, unit, docs, scores, least - left, alone)
    keep = scores >= least
    return docs[keep], scores[keep]


def search_shard(lists: _Lists, query: list[tuple[int, tuple[int, ...]]], best: list, top: int) -> dict:
    """Puts the shard's documents that belong among the ``top`` into the heap ``best`` of
    (score, -doc_id). Returns how many units were essential and how many documents were scored."""
    units = sorted((*lists.bound(u), u) for u in query)
    units = [u for u in units if u[0] > 0]
    if not units:
        return {"essential": 0, "scored": 0}
    least = best[0][0] if len(best) == top else 1
    if sum(u[0] for u in units) < least:
        return {"essential": 0, "scored": 0}
    least = max(least, _raised(lists, units, top))
    below, essential = 0, 0
    while essential < len(units) and below + units[essential][0] < least:
        below += units[essential][0]
        essential += 1
    docs, scores = _gathered(lists, units[essential:])
    n = len(docs)
    docs, scores = _completed(lists, units[:essential], docs, scores, least)
    for score, doc_id in zip(scores.tolist(), lists.ids[docs].tolist()):
        entry = (score, -doc_id)
        if len(best) < top:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
    return {"essential": len(units) - essential, "scored": n}


def _gathered(lists: _Lists, units) -> tuple[np.ndarray, np.ndarray]:
    """Documents of any list of the units, with the sum of their impacts there."""
    held = [lists.term(t) for _, _, (_, terms) in units for t in terms if t in lists.own]
    if not held:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for places, impacts in held:
        lists.score[places] += impacts
    docs = np.flatnonzero(lists.score)
    scores = lists.score[docs]
    lists.score[docs] = 0
    return docs, scores


def _raised(lists: _Lists, units, top: int) -> int:
    """A score that ``top`` documents of the shard reach: full scores of the leaders on the strongest
    units. 1 if there are not as many."""
    k = len(units)
    docs = np.empty(0, dtype=np.int64)
    while k and len(docs) < top:
        k = max(0, k - 3)
        docs, scores = _gathered(lists, units[k:])
    if len(docs) < top:
        return 1
    if len(docs) > LEADERS:
        lead = np.argpartition(-scores, LEADERS)[:LEADERS]
        docs, scores = docs[lead], scores[lead]
    order = np.argsort(docs)
    _, scores = _completed(lists, units[:k], docs[order], scores[order], 0)
    return int(np.partition(scores, len(scores) - top)[len(scores) - top])


def best_in_tasks(index: DataFrame, queries: list, top: int) -> DataFrame:
    """(item, doc_id, score): per task and query the best ``top`` of its shards."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    @tidied
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best: list[list] = [[] for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                lists = _Lists(_arrays(batch, i))
                for query, heap in zip(asked, best):
                    search_shard(lists, query, heap, top)
        rows = [(item, -negative, score) for item, heap in enumerate(best) for score, negative in heap]
        columns = list(zip(*rows)) or [[]] * len(BEST)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, BEST)], schema=BEST)

    return index.mapInArrow(search, _ddl(BEST))


def _block_best(
    documents: DataFrame, block: list, top: int, id_col: str, text_col: str, shard_docs: int
) -> tuple[list, DataFrame]:
    """A block's item ids and its rows (item, doc_id, score, rank)."""
    words = sorted({row.term for row in block})
    vocabulary = {word.encode(): i for i, word in enumerate(words)}
    asked: dict = {}
    for row in block:
        asked.setdefault(row.item_id, []).append(vocabulary[row.term.encode()])
    counts = written(count_postings(documents, vocabulary, id_col, text_col, shard_docs), "postings")
    totals = counts.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    held = counts.select(F.explode("df").alias("term", "held")).groupBy("term").agg(F.sum("held").alias("df"))
    df = {r.term: r.df for r in held.collect()}
    n_docs, n_terms = totals.n or 0, totals.l or 0
    units = [query_units(terms, df) for terms in asked.values()]
    pairs = sorted({u for query in units for u in query if len(u) == 2})
    number = {u: i for i, u in enumerate(pairs)}
    queries = [[(number.get(u, -1), u) for u in query] for query in units]
    weights = {t: term_weight(n_docs, n) for t, n in df.items()}
    index = written(with_impacts(counts, n_docs, n_terms, weights, pairs), "impacts")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = best_in_tasks(index, queries, top).withColumn("rank", F.row_number().over(order))
    return list(asked), ranked.filter(F.col("rank") <= top)


def ranked_search(
    documents: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` best documents of each item."""
    spark = documents.sparkSession
    asked = written(item_terms(items, item_col, item_text_col), "query-terms")
    blocks = max(1, math.ceil(asked.count() / BLOCK_TERMS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    kind = asked.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for number in range(blocks):
        block = asked.filter(F.col("block") == number).select("item_id", "term").collect()
        if block:
            block.sort(key=lambda r: (r.item_id is not None, r))
            names, rows = _block_best(documents, block, top, id_col, text_col, shard_docs)
            named = spark.createDataFrame(list(enumerate(names)), f"number int, item_id {kind}")
            found = rows.join(F.broadcast(named), rows["item"] == named["number"])
            result = result.union(found.select("item_id", "rank", "doc_id", "score"))
    return result


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


ORACLE_SQL = rf"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM[1:-1]}')) AS term FROM documents
), held AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
    SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), totals AS (
    SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM[1:-1]}')) AS term FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, totals GROUP BY term, docs
), scored AS (
    SELECT item_id, held.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths ON lengths.doc_id = held.doc_id, totals
    GROUP BY item_id, held.doc_id
), ranked AS (
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
