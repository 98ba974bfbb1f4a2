from __future__ import annotations

import random
import zlib

import numpy as np

from shelfwise.llm.toxicity import drop_toxic, features_of, fit_toxicity, toxicity, train
from tests.llm.helpers import ODD, by_id, documents, words

BAD = ["vile", "rotten", "stinker", "dolt"]


def corpus(n=400):
    rng = random.Random(7)
    rows, labels = list(ODD), []
    for i in range(100, 100 + n):
        toxic = i % 6 == 0
        body = words(rng, rng.randrange(30, 120), 800)
        for bad in rng.sample(BAD, 3) if toxic else []:
            body[rng.randrange(len(body))] = rng.choice([bad, bad.upper() + "!!", bad + ","])
        rows.append((i, " ".join(body)))
        if i % 3 or toxic:
            labels.append((i, int(toxic)))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    # Wrong labels of held-out rows must not matter: they are not learnt from.
    flipped = [(i, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, t in labels]
    flipped += [(None, 1), (100, None)]
    got = {r["doc_id"]: r for r in toxicity(documents(spark, rows), table(spark, flipped)).collect() if r["doc_id"]}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held)
    assert sum(got[i]["predicted"] == t for i, t in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert len(got) == len({i for i, _ in rows if i})


def test_a_rare_but_telling_word_gets_weight():
    rng = np.random.default_rng(8)
    row = lambda *more: np.unique([*rng.integers(0, 500, 30), *more]).astype(np.int32)
    positive = [row(1000) if i >= 15 else row(2000) for i in range(1000)]  # 2000: 1.5% of them
    weights, _ = train(positive, [row() for _ in range(2000)], 0.1, members=1)
    assert weights[2000] > 1 and weights[1000] > 1


def test_rejected_rows_go_and_the_rest_keep_their_columns(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    kept = drop_toxic(docs, table(spark, labels))
    scores = toxicity(docs, table(spark, labels))
    assert kept.columns == docs.columns
    assert by_id(kept) == sorted(((r["doc_id"],) for r in scores.collect() if r["score"] < 0.5), key=repr)


def test_without_examples_nothing_is_toxic(spark):
    docs = documents(spark, ODD)
    assert {r[1] for r in by_id(toxicity(docs, table(spark, [])), "score")} == {0.0}
    assert toxicity(documents(spark, []), table(spark, [])).count() == 0


def test_sample_bound(spark):
    rows, labels = corpus()
    weights, bias = fit_toxicity(documents(spark, rows), table(spark, labels), max_positive=20, max_unlabelled=50)
    assert weights.shape == (1 << 18,) and bias < 0


def test_prior_is_corrected_for():
    rng = random.Random(8)
    make = lambda bad: features_of(" ".join(words(rng, 40, 300) + (["vile", "dolt"] if bad else [])))
    import numpy as np

    positive = [np.array(make(True)) for _ in range(80)]
    unlabelled = [np.array(make(k % 5 == 0)) for k in range(600)]  # a fifth of them toxic
    weights, bias = train(positive, unlabelled, prior=0.2)
    judged = [weights[f].sum() + bias > 0 for f in unlabelled]
    assert sum(j == (k % 5 == 0) for k, j in enumerate(judged)) >= 0.97 * len(judged)
