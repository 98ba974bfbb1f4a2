from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfwise.llm import ranked_search as rs
from shelfwise.llm.ranked_search import op12_ranked_search, ranked_search
from tests.llm.helpers import ODD, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top=10):
    """Every document scored in full for every item."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    rows = []
    for item, wanted in asked.items():
        scored = []
        for doc_id, bag in bags:
            if doc_id is None:
                continue
            m = 100 - 90 + (90 * sum(bag.values()) * n_docs) // max(total, 1)
            score = 0
            for t in wanted & bag.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id))
        rows += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(rows, key=repr)


def found(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items(spark, rows):
    frame = spark.createDataFrame(rows, "item_id long, text string")
    return frame.selectExpr("*", "'x' as term", "1 as rank", "2 as item", "3L as doc_id", "4L as score", "0 as block")


def corpus(rng, n, vocabulary=300):
    weights = [1 / (k + 1) for k in range(vocabulary)]
    rows = []
    for i in range(n):
        if i % 7 == 3:
            rows.append((i, rows[-1][1]))  # copies: equal scores
            continue
        w = rng.choices(range(vocabulary), weights, k=rng.randrange(1, 90))
        rows.append((i, " ".join(f"W{k}" if rng.random() < 0.2 else f"w{k}" for k in w) + rng.choice(["", " é-ü", "\x00Ünï 7"])))
    return rows


@pytest.mark.parametrize("shard_docs", [1, 40, 2048])
def test_equal_to_full_scoring(spark, shard_docs):
    rng = random.Random(shard_docs)
    docs = corpus(rng, 150 if shard_docs == 1 else 700) + ODD
    asked = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 40)))) for k in range(40)]
    asked += [(100, None), (101, ""), (102, "... --"), (103, "nowhere"), (104, "a"), (104, "b c"), (None, "same row")]
    got = found(ranked_search(documents(spark, docs), items(spark, asked), shard_docs=shard_docs))
    assert got == brute(docs, asked)


def test_blocks_of_queries_and_other_tops(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_TERMS", 20)
    rng = random.Random(2)
    docs = corpus(rng, 80)
    asked = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(12))) for k in range(9)]
    assert found(ranked_search(documents(spark, docs), items(spark, asked), top=3)) == brute(docs, asked, 3)


def shard(docs):
    """An impact table of one shard, its lists and the numbers needed to ask it."""
    known = sorted({t for _, text in docs for t in terms(text)})
    vocabulary = {t.encode(): i for i, t in enumerate(known)}
    gathered = rs._Shard()
    for doc_id, text in docs:
        gathered.add(doc_id, text, vocabulary)
    df = dict(Counter(vocabulary[t.encode()] for _, text in docs for t in set(terms(text))))
    n, total = sum(bool(x) for x in gathered.lengths), sum(gathered.lengths)
    return gathered, vocabulary, df, n, total


def test_pair_bounds_hold_and_skip_more_than_single_maxima():
    rng = random.Random(4)
    docs = corpus(rng, 2000, 60)
    gathered, vocabulary, df, n, total = shard(docs)
    asked = [[vocabulary[f"w{k}".encode()] for k in rng.sample(range(60), 14)] for _ in range(30)]
    units = [rs.query_units(q, df) for q in asked]
    pairs = sorted({u for q in units for u in q if len(u) == 2})
    number = {u: i for i, u in enumerate(pairs)}
    weights = {t: rs.term_weight(n, c) for t, c in df.items()}
    weighed = rs._weighed(rs._arrays(gathered.row(), 0), n, total, weights, pairs)
    lists = rs._Lists(rs._arrays(weighed, 0))
    paired = single = 0
    for query in units:
        for unit in query:
            bound, alone = lists.bound((number.get(unit, -1), unit))
            whole = np.zeros(len(docs), dtype=np.int64)
            for t in unit:
                places, impacts = lists.term(t)
                whole[places] += impacts
            assert whole.max() == bound <= sum(lists.maxima[t] for t in unit)
            assert alone == max(lists.maxima[t] for t in unit)
        paired += rs.search_shard(lists, [(number.get(u, -1), u) for u in query], [], 10)["scored"]
        single += rs.search_shard(lists, [(-1, (t,)) for u in query for t in u], [], 10)["scored"]
    assert paired < single < 30 * len(docs)


def test_registered_query_matches_brute_force(spark):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()]
    want = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert found(op12_ranked_search(spark, SF)) == want and len(want) == 400
