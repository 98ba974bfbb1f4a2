from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import small_world
from shelfwise.llm.nearest_vectors import nearest_vectors, op13_nearest_vectors

SF = "/root/testdata/sf0.1"

def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def brute(rows, k=5):
    """{query id: [(vec_id, score)]}; query ids occur once."""
    rows = [(i, v) for i, v in rows if i is not None and usable(v)]
    out = {}
    for q, v in rows:
        if q % 50 == 0:
            near = [(-cosine(v, w), i) for i, w in rows if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def table(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return frame.selectExpr("*", "1 as shard", "2 as dim", "'x' as vector", "3 as rank", "4 as copy", "5 as number")


def agreement(got, want):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in near}) for q, near in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("shard_vectors", [16_384, 150])
def test_recall_against_brute_force_on_the_table(spark, shard_vectors):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = found(op13_nearest_vectors(spark, SF) if shard_vectors > 150 else nearest_vectors(frame, F.col("vec_id") % 50 == 0, shard_vectors=shard_vectors))
    want = brute(rows)
    assert len(got) == len(want) == 40 and all(len(x) == 5 for x in got.values())
    assert agreement(got, want) >= 0.95
    vectors = dict(rows)
    for q, near in got.items():
        for i, score in near:
            assert score == pytest.approx(cosine(vectors[q], vectors[i]), abs=1e-12)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_small_tables_are_exact_and_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(60)]  # another length
    rows += [(2000, None), (2001, []), (2002, [0.0] * 6), (2050, [1.0, None] * 3), (2100, [math.nan] * 6), (2150, [math.inf] + [0.0] * 5)]
    rows += [(None, [1.0] * 6), (3000, [1e300] * 6), (3050, [1e-300, 0.0, 0.0, 0.0, 0.0, 1e-300]), (4000, [5.0])]
    got, want = found(nearest_vectors(table(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows)
    assert {q: [i for i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items() if near}
    for q, near in got.items():
        assert [s for _, s in near] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_copies_of_one_vector_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8).tolist()
    rows = [(i, hot if i % 3 else rng.normal(size=8).tolist()) for i in range(1, 400)] + [(500, hot), (550, [2 * x for x in hot])]
    got = found(nearest_vectors(table(spark, rows), F.col("vec_id") % 50 == 0, shard_vectors=60))
    copies = [i for i, v in rows if v is hot]
    for q in (50, 100, 200, 250, 350, 500):
        near = [i for i in copies if i != q][:5]
        assert [i for i, _ in got[q]] == near and all(s == pytest.approx(1.0) for _, s in got[q])
    assert {i for i, _ in got[550]} <= set(copies)


def test_repeated_rows_of_a_query_and_fewer_candidates(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [1.0, 1.0]), (8, [0.0, 1.0])]
    got = found(nearest_vectors(table(spark, rows), F.col("vec_id") % 50 == 0))
    assert [i for i, _ in got[0]] == [7, 8]


def test_graph_is_layered_reachable_and_finds_clustered_vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    points = np.vstack([c + 1e-3 * rng.normal(size=(250, 16)) for c in centres])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    layers = small_world.build(points)
    assert len(layers) > 1 and len(layers[-1].nodes) == len(points)
    for above, below in zip(layers, layers[1:]):
        assert set(above.nodes) <= set(below.nodes)
    for layer in layers:
        assert layer.neighbours.max() < len(layer.nodes)
        reached, edge = set(layer.entries.tolist()), layer.entries.tolist()
        while edge:
            edge = list({x for p in edge for x in layer.neighbours[p].tolist() if x >= 0} - reached)
            reached |= set(edge)
        assert len(reached) == len(layer.nodes)
    asked = points[::25]
    ids, _ = small_world.search(points, layers, asked, 64)
    want = np.argsort(-(asked @ points.T), axis=1, kind="stable")[:, :5]
    assert np.mean([len(set(a[:5]) & set(b)) for a, b in zip(ids, want)]) / 5 > 0.9
