"""Periodic runs of words: stretches that repeat one block of words over and over.

Method: seed and extend on diagonals. Words q apart lie on diagonal q. A run of period q that is long
enough keeps matching on its diagonal for at least ``overlap(q)`` words, so any k-gram with
k <= overlap(q) at its start occurs again q words on. Lags are taken in bands; a band's k is the
smallest overlap its lags guarantee. The document's k-grams are named exactly, by pairing the names of
shorter grams, and each occurrence is paired with the *next* one of the same gram only: if a gram of
q - 1 or more words inside a run of smallest period q came back sooner, the run would have a smaller
period (Fine and Wilf). So no pair is lost, and a gram with m occurrences gives m - 1 pairs. A pair is
a seed on the diagonal of its lag. Per lag a table holds how far the diagonal is covered; a seed
inside what is covered is passed over, the others are extended both ways to the maximal stretch.

By the same argument the lag of a seed is the smallest period of the stretch it extends to. Grams that
occur once are dropped before longer ones are named, so a text without repeats costs one pass.

Defined cases: a null or empty text, or one of spaces only, has no words and no runs. A null id is
carried as it is. Rows are judged one by one, so repeated rows and ids give repeated results. Words
are compared by content (numbered per text), never by hash. An empty table gives an empty table. Other
columns of the input are ignored. A text is one row in one task; the work on it is of order
n log n in its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACE_CLASS, in_small_batches, tidied
from shelfwise.llm.windows import word_ids

MIN_LENGTH = 6
MIN_EXPONENT = 4

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())]
)
DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def overlap(lag: int, min_length: int, min_exponent: int) -> int:
    """Words that surely match on diagonal ``lag`` within a run of that period."""
    return max(min_length, min_exponent * lag) - lag


def lag_bands(longest: int, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(smallest lag, largest lag, gram) of each band up to ``longest``: the gram is no longer than any
    of its lags guarantees, and at least one short of the largest."""
    bands, low = [], 1
    while low <= longest:
        gram = overlap(low, min_length, min_exponent)
        high = low
        while high < longest and min(gram, overlap(high + 1, min_length, min_exponent)) >= high:
            high += 1
            gram = min(gram, overlap(high, min_length, min_exponent))
            if high > min_length:  # from here on the overlap only grows
                high = max(high, min(longest, gram + 1))
                break
        bands.append((low, high, gram))
        low = high + 1
    return bands


def _repeated(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of the pairs (left[i], right[i]); -1 where a part is -1 or the pair occurs once."""
    names = np.full(len(left), -1, dtype=np.int64)
    at = np.flatnonzero((left >= 0) & (right >= 0))
    if len(at):
        pairs = left[at] * (int(right[at].max()) + 1) + right[at]
        _, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        names[at] = np.where(counts[which] > 1, which, -1)
    return names


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """Leading places at which a and b agree, read in pieces of growing size."""
    done, size, most = 0, 64, min(len(a), len(b))
    while done < most:
        upto = min(most, done + size)
        differ = np.flatnonzero(a[done:upto] != b[done:upto])
        if len(differ):
            return done + int(differ[0])
        done, size = upto, size * 2
    return most


def periodic_runs_of(
    ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start, then period."""
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    names, size, runs = ids, 1, []
    for low, high, gram in lag_bands(len(ids) // min_exponent, min_length, min_exponent):
        if gram >= len(ids):
            break
        while size < gram:
            step = min(size, gram - size)
            names, size = _repeated(names[: len(names) - step], names[step:]), size + step
        at = np.flatnonzero(names >= 0)
        if not len(at):
            break
        order = at[np.argsort(names[at], kind="stable")]
        lags = np.diff(order)
        seed = (names[order[1:]] == names[order[:-1]]) & (lags >= low) & (lags <= high)
        runs += _extended(ids, order[:-1][seed], lags[seed], gram, min_length, min_exponent)
    return sorted(runs)


def _extended(ids, places, lags, gram: int, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    order = np.lexsort((places, lags))
    places, lags = places[order], lags[order]
    covered: dict[int, int] = {}
    runs = []
    i = 0
    while i < len(places):
        at, lag = int(places[i]), int(lags[i])
        end = at + gram + _matching(ids[at + gram :], ids[at + gram + lag :])
        start = at - _matching(ids[:at][::-1], ids[lag : at + lag][::-1])
        covered[lag] = end
        if end + lag - start >= max(min_length, min_exponent * lag):
            runs.append((start, end + lag - start, lag))
        # The next seed of this lag beyond what is covered, else the first of the next lag.
        last = np.searchsorted(lags, lag, side="right")
        i += int(np.searchsorted(places[i:last], covered[lag]))
    return runs


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that repeat a run's first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def periodic_runs(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period in words) and the text with every run cut
    to its first period, words joined by one space."""

    @tidied
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ends, found, texts = [], [0], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                runs = []
                if len(words) >= min_length:
                    runs = periodic_runs_of(word_ids(words), min_length, min_exponent)
                counts.append(len(words))
                found += runs
                ends.append(len(found))
                texts.append(b" ".join(collapsed(words, runs)))
            flat = np.array(found, dtype=np.int64).reshape(-1, 3)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                schema=SCHEMA,
            )

    chosen = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("full_text"))
    return in_small_batches(chosen).mapInArrow(search, DDL)


def with_planted_period(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's input: in every tenth document (by crc32 of the decimal id) the words from a on
    repeat the p words there. Returns doc_id, text; a null id is left as it is."""
    doc_id = F.col(id_col).cast("long")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        word = lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.transform(words, word), " ")).otherwise(F.col(text_col))

    # One-element array: the words are split once and bound to a name.
    words = F.array(F.filter(F.split(F.col(text_col), SPACE_CLASS + "+"), lambda w: w != ""))
    chosen = F.when((h % 10 == 0) & F.col(text_col).isNotNull(), F.get(F.transform(words, planted), F.lit(0)))
    return documents.select(doc_id.alias("doc_id"), chosen.otherwise(F.col(text_col)).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from what :func:`periodic_runs` returns."""
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select("*", longest.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.expr("(1000 * best.length) div (-best.q)").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_planted_period(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
