"""Toxicity by non-negative positive-unlabelled (PU) learning, with numpy classifiers.

Confirmed toxic examples (P) and unlabelled text (U) train logistic classifiers on the
class-prior-corrected risk ``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``. When the second
part falls below zero the step climbs it back, which keeps a flexible model from fitting the
toxic documents inside U as if they were clean. Several classifiers, each on a bootstrap of P and
U, are averaged in their logits.

Features are the distinct lower-cased words of a whole text without punctuation, hashed to
``BUCKETS``; a bucket counts only if P documents have it
clearly more often than U documents do. Nothing but the text is a
feature. Labels are used of rows with ``crc32(doc_id) mod 5 <> 0`` only: which rows are P, and
the prior (share of toxic among those labelled rows, over all of them).

The fit reads a bounded sample, by hash of the doc_id: about ``MAX_POSITIVE`` P rows and
``MAX_UNLABELLED`` U rows (feature ids only, at most ``BUCKETS`` per row). Scoring reads every
document in place: no shuffle, a fixed array of weights goes to the tasks.

Defined cases: null and empty texts have no features and score by the bias alone; a null doc_id
is not held out and never a training row; a doc_id labelled twice counts as toxic if any label
says so; without any positive example every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import in_small_batches, tidied

MAX_POSITIVE = 5_000
MAX_UNLABELLED = 20_000
BUCKETS = 1 << 18
MEMBERS = 5
EPOCHS = 150
L2 = 2e-4
RATE = 0.15
MIN_EXCESS = 4.0  # standard deviations
MIN_SEEN = 3  # P documents
FOLDS = 5

_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def tokens_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().translate(_TO_SPACE).split())


def features_of(text: str | None) -> list[int]:
    return sorted({zlib.crc32(w) % BUCKETS for w in tokens_of(text)})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


class Sparse:
    """Binary rows as index lists, for products with a weight vector and back."""

    def __init__(self, rows: list[np.ndarray], columns: int):
        self.n, self.columns = len(rows), columns
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.at = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, dtype=np.int64)
        self.row = np.repeat(np.arange(self.n), self.sizes)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row], minlength=self.columns)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit_nnpu(
    positive: Sparse, unlabelled: Sparse, p_weight: np.ndarray, u_weight: np.ndarray, prior: float
) -> tuple[np.ndarray, float]:
    """Weights and bias. ``*_weight``: row weights (a bootstrap), each summing to one."""
    w, b = np.zeros(positive.columns), float(np.log(prior / (1 - prior)))
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, EPOCHS + 1):
        zp, zu = positive.dot(w) + b, unlabelled.dot(w) + b
        negative = u_weight @ _softplus(zu) - prior * (p_weight @ _softplus(zp))
        up, uu = _sigmoid(zp), _sigmoid(zu)
        # Gradients of the two parts with respect to the logits.
        neg_p, neg_u = -prior * p_weight * up, u_weight * uu
        if negative >= 0:
            gp, gu = -prior * p_weight * (1 - up) + neg_p, neg_u
        else:
            gp, gu = -neg_p, -neg_u
        grad = np.append(positive.back(gp) + unlabelled.back(gu) + L2 * w, gp.sum() + gu.sum())
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _distinct(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Copies of a document count once."""
    return list({r.tobytes(): r for r in rows}.values())


def _telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features that P documents have more often than U's frequency explains."""
    seen = np.bincount(np.concatenate(positive).astype(np.int64), minlength=BUCKETS)
    usual = np.bincount(np.concatenate(unlabelled).astype(np.int64), minlength=BUCKETS)
    n = len(positive)
    rate = (usual + 1) / (len(unlabelled) + 2)
    excess = (seen - n * rate) / np.sqrt(n * rate * (1 - rate))
    return np.flatnonzero((excess >= MIN_EXCESS) & (seen >= MIN_SEEN))


def train(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, members: int = MEMBERS
) -> tuple[np.ndarray, float]:
    """Averaged weights over ``BUCKETS`` and the averaged bias."""
    weights = np.zeros(BUCKETS)
    if not positive or not unlabelled:
        return weights, -np.inf if not positive else 0.0
    prior = min(max(prior, 1e-4), 0.9)
    positive, unlabelled = _distinct(positive), _distinct(unlabelled)
    kept = _telling(positive, unlabelled)
    slot = np.full(BUCKETS, -1)
    slot[kept] = np.arange(len(kept))

    def sparse(rows: list[np.ndarray]) -> Sparse:
        return Sparse([s[s >= 0] for s in (slot[r] for r in rows)], len(kept))

    p, u, bias = sparse(positive), sparse(unlabelled), 0.0
    for member in range(members):
        rng = np.random.default_rng(member)
        pw = np.bincount(rng.integers(0, p.n, p.n), minlength=p.n) / p.n
        uw = np.bincount(rng.integers(0, u.n, u.n), minlength=u.n) / u.n
        w, b = fit_nnpu(p, u, pw, uw, prior)
        weights[kept] += w / members
        bias += b / members
    return weights, bias


def _feature_rows(documents: DataFrame) -> list[np.ndarray]:
    """Feature ids of a bounded sample, computed on the executors."""

    @tidied
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features_of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "features"]
            )

    rows = in_small_batches(documents).mapInArrow(extract, "doc_id long, features array<int>").toArrow()
    lists = rows.sort_by("doc_id").column("features").combine_chunks()
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    max_positive: int = MAX_POSITIVE,
    max_unlabelled: int = MAX_UNLABELLED,
) -> tuple[np.ndarray, float]:
    doc_id = F.col("doc_id")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("toxic"))
        .filter("doc_id is not null and toxic is not null")
        .filter(~held_out(doc_id))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    totals = known.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("p"))
    n, n_positive = totals.first()
    if not n_positive:
        return train([], [], 0.0)
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("full_text")
    ).filter(doc_id.isNotNull() & ~held_out(doc_id))
    n_texts = documents.count()

    def share(most: int, of: int) -> Column:
        # A hash threshold: the sample follows the ids, not the order or place of the rows.
        return F.pmod(F.xxhash64(doc_id, F.lit("sample")), F.lit(1 << 30)) < int(
            (1 << 30) * min(1.0, most / max(of, 1))
        )

    toxic = known.filter("toxic = 1").filter(share(max_positive, n_positive)).select("doc_id")
    # About max_positive ids whatever the corpus: they go to the texts, which are not shuffled.
    positive = _feature_rows(texts.join(F.broadcast(toxic), "doc_id", "left_semi"))
    unlabelled = _feature_rows(texts.filter(share(max_unlabelled, n_texts)))
    return train(positive, unlabelled, n_positive / n)


def score_text(text: str | None, weights: list[float], bias: float) -> float:
    """``weights``: one per bucket. A bucket counts once, however many words share it."""
    buckets = {zlib.crc32(w) % BUCKETS for w in tokens_of(text)}
    total = sum(sorted(filter(None, map(weights.__getitem__, buckets)))) + bias
    return float(_sigmoid(np.float64(total))) if np.isfinite(total) else 0.0


def score_texts(texts: Column, weights: np.ndarray, bias: float) -> Column:
    """The scores of a text column. Only the texts go to the Python workers, a number comes back."""
    at = np.flatnonzero(weights)
    values = weights[at]

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(score_batches)(batches)

    def score_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        full = np.zeros(BUCKETS)
        full[at] = values
        table = full.tolist()
        for batch in batches:
            yield pa.array([score_text(t.as_py(), table, bias) for t in batch], pa.float64())

    return score(texts)


def score_documents(documents: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score of every row."""
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("full_text"))
    return in_small_batches(chosen).select("doc_id", score_texts(F.col("full_text"), weights, bias).alias("score"))


def drop_toxic(documents: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that score below 0.5, with all their columns."""
    weights, bias = fit_toxicity(documents, labels)
    return in_small_batches(documents).filter(score_texts(F.col(text_col), weights, bias) < 0.5)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_documents(documents, *fit_toxicity(documents, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
