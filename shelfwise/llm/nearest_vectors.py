"""Approximate nearest neighbours: a small-world graph per shard, shard results merged.

Every distinct vector goes to a shard by a hash of its components, so shards of at most about
``shard_vectors`` are even whatever the vectors are. A shard's graph (:mod:`shelfwise.llm.small_world`) is
built in one task and written as one row of flat arrays: vectors, ids, and for each layer its nodes and
neighbour lists. Every vector is in the index; nothing is sampled.

Copies of a vector are one node. It carries the smallest ``k + 1`` of their ids, enough for any query,
and a hot vector is cut to them per task before the shuffle (rank limit). The queries are
worked off in blocks of at most about ``QUERY_BLOCK``, which bounds what is sent to the tasks: each task
searches its shards for a block, scores what it finds in double precision on the original vectors, and
keeps the best ``k`` of each query over its shards; a rank over the tasks' rows gives the result.

Nearness: cosine, a.b / (|a| |b|) in double precision. Each vector is first scaled by a power of two,
which changes no cosine and keeps sums of squares finite. Ties go to the smaller id.

Defined cases: rows with a null id, and vectors that are null, empty, all zero or hold a null or
non-finite component take no part, neither as query nor as candidate. A query's own row is every row
of its id; a repeated query id is asked once for each distinct vector of its rows. Vectors are compared
with those of the same length only. Fewer than ``k`` candidates give fewer rows. An empty table gives an
empty result. Other columns are ignored.

Recall: the beam is a parameter; see the README for measured figures and the tests for a check
against brute force.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm import small_world
from shelfwise.llm.common import in_small_batches, written

NEAREST = 5
QUERY_EVERY = 50
#: Vectors of a shard, on average. Larger shards cost a query less in all; a graph is built in one task.
SHARD_VECTORS = 16_384
#: Best vectors kept while a shard is searched.
BEAM = 128
#: Queries sent to the tasks at once (a vector of 64 components takes 512 bytes).
QUERY_BLOCK = 16_384

GRAPH_DDL = (
    "shard int, dim int, vectors binary, ids array<long>, id_ends array<long>, "
    "layers array<struct<nodes: binary, neighbours: binary, entries: binary>>"
)
_LAYER = pa.struct([("nodes", pa.binary()), ("neighbours", pa.binary()), ("entries", pa.binary())])
GRAPH = pa.schema(
    [("shard", pa.int32()), ("dim", pa.int32()), ("vectors", pa.binary()), ("ids", pa.list_(pa.int64())),
     ("id_ends", pa.list_(pa.int64())), ("layers", pa.list_(_LAYER))]
)
NEAR = pa.schema([("number", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part; components as doubles."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    vector = F.col(vector_col).cast("array<double>")
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    return chosen.filter(
        F.col("vec_id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    )


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, the largest component between 1/2 and 1."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def cosines(vectors: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``vectors`` with the vector ``asked``."""
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors)) * np.sqrt(asked @ asked)
    return np.einsum("ij,j->i", vectors, asked) / lengths


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _graph_of(table: pa.Table) -> pa.Table:
    """One shard's rows (shard, dim, vec_id, vector) as its graph."""
    shard, dim = table["shard"][0].as_py(), table["dim"][0].as_py()
    rows, ids = _matrix(table["vector"], dim), table["vec_id"].to_numpy()
    # Equal vectors side by side, their ids ascending.
    order = np.lexsort((ids, *rows.T[::-1]))
    rows, ids = rows[order], ids[order]
    first = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
    vectors = scaled(rows[first])
    layers = small_world.build(_units(vectors), seed=shard)
    flat = [
        {"nodes": x.nodes.astype(np.int32).tobytes(), "neighbours": x.neighbours.tobytes(), "entries": x.entries.astype(np.int32).tobytes()}
        for x in layers
    ]
    ends = np.append(np.flatnonzero(first)[1:], len(ids))
    row = [[shard], [dim], [vectors.tobytes()], [ids], [ends], [flat]]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(row, GRAPH)], schema=GRAPH)


def build_index(
    vectors: DataFrame, k: int, shard_vectors: int = SHARD_VECTORS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The written graph table: one row per shard and vector length."""
    rows = usable(vectors, id_col, vector_col).withColumn("dim", F.size("vector"))
    copies = Window.partitionBy("vector").orderBy("vec_id")
    rows = rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    total = usable(vectors, id_col, vector_col).count()
    shards = max(1, math.ceil(total / shard_vectors))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    graphs = dealt.repartitionByRange(shards, "shard").groupBy("shard", "dim").applyInArrow(_graph_of, GRAPH_DDL)
    return written(graphs, "graphs")


class _Graph:
    def __init__(self, batch: pa.RecordBatch, i: int):
        value = lambda name: batch.column(name)[i]
        self.dim = value("dim").as_py()
        self.vectors = np.frombuffer(value("vectors").as_buffer(), dtype=np.float64).reshape(-1, self.dim)
        self.ids = value("ids").values.to_numpy()
        self.ends = value("id_ends").values.to_numpy()
        self.points = _units(self.vectors)
        self.layers = []
        for layer in value("layers").as_py():
            nodes, entries = (np.frombuffer(layer[x], dtype=np.int32).astype(np.int64) for x in ("nodes", "entries"))
            neighbours = np.frombuffer(layer["neighbours"], dtype=np.int32).reshape(len(nodes), -1)
            self.layers.append(small_world.Layer(nodes, neighbours, entries))

    def nearest(self, ids: np.ndarray, asked: np.ndarray, k: int, beam: int) -> Iterator[list[tuple[float, int]]]:
        """Per query its nearest here as (score, -vec_id), its own id left out."""
        found, _ = small_world.search(self.points, self.layers, _units(asked), max(beam, k + 1))
        for own, vector, nodes in zip(ids.tolist(), asked, found):
            nodes = nodes[nodes != small_world.NONE]
            scores = cosines(self.vectors[nodes], vector)
            rows = []
            for score, node in zip(scores.tolist(), nodes.tolist()):
                start = self.ends[node - 1] if node else 0
                rows += [(score, -x) for x in self.ids[start : self.ends[node]].tolist() if x != own]
            yield heapq.nlargest(k, rows)


def search_blocks(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries``: (vec_id, vector), usable ones."""
    spark = index.sparkSession
    asked = written(queries.distinct(), "vector-queries")
    blocks = max(1, math.ceil(2 * asked.count() / block))
    part = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks))
    found = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for number in range(blocks):
        rows = asked.filter(part == number).orderBy("vec_id", "vector").toArrow()
        if rows.num_rows:
            near = in_small_batches(index).mapInArrow(_searcher(spark, rows, k, beam), "number int, query_id long, vec_id long, score double")
            order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
            ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            found = found.union(ranked.select("query_id", "rank", "vec_id", "score"))
    return found


def _searcher(spark, rows: pa.Table, k: int, beam: int) -> Callable:
    ids, lists = rows["vec_id"].to_numpy(), rows["vector"].combine_chunks()
    dims = np.diff(lists.offsets.to_numpy())
    groups = []
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        groups.append((dim, at, ids[at], scaled(_matrix(lists.take(pa.array(at)), dim))))
    sent = spark.sparkContext.broadcast(groups)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, list]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                graph = _Graph(batch, i)
                for dim, numbers, own, asked in sent.value:
                    if dim == graph.dim:
                        for number, query, near in zip(numbers.tolist(), own.tolist(), graph.nearest(own, asked, k, beam)):
                            before = best.get(number, (query, []))[1]
                            best[number] = (query, heapq.nlargest(k, before + near))
        flat = [(number, query, -x, score) for number, (query, near) in best.items() for score, x in near]
        columns = list(zip(*flat)) or [[]] * len(NEAR)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NEAR)], schema=NEAR)

    return search


def nearest_vectors(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEAREST,
    beam: int = BEAM,
    shard_vectors: int = SHARD_VECTORS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: for every usable row where ``is_query`` holds, its ``k`` nearest
    other rows as the index finds them."""
    index = build_index(vectors, k, shard_vectors, id_col, vector_col)
    return search_blocks(index, usable(vectors.filter(is_query), id_col, vector_col), k, beam)


def op13_nearest_vectors(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_vectors(vectors, F.col("vec_id") % QUERY_EVERY == 0)
