"""Distributed exact quantiles against numpy; sink rounding modes."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwise.functions.quantiles import _binned, _bracketed, _known_ranks, exact_quantiles
from shelfwise.functions.rounding import round_numeric, round_value

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _check(spark, groups, parts):
    data = [(g, float(v)) for g, vals in groups.items() for v in vals]
    df = spark.createDataFrame(data, "g string, v double") if data else spark.createDataFrame([], "g string, v double")
    out = {r["g"]: r for r in exact_quantiles(df.repartition(parts), "v", PROBS, by=["g"]).collect()}
    for g, vals in groups.items():
        vals = [v for v in vals if v is not None]
        if not vals:
            assert g not in out
            continue
        want = np.percentile(np.array(vals, dtype=float), [p * 100 for p in PROBS], method="linear")
        got = [out[g][c] for c in out[g].asDict() if c.startswith("q")]
        assert out[g]["n"] == len(vals)
        assert got == pytest.approx(list(want), rel=1e-12, abs=1e-9)


def test_hot_group_spans_many_partitions(spark):
    rng = np.random.default_rng(7)
    groups = {
        "hot": list(rng.integers(0, 500, 20000)),  # a third+ of the rows, heavy duplicates
        "a": list(rng.normal(size=301)),
        "b": [5.0],
        "c": [1.0, 1.0, 1.0, 2.0],
    }
    _check(spark, groups, parts=13)


def test_global_quantiles_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,), (10.0,)], "v double")
    r = exact_quantiles(df, "v", [0.25, 0.5, 0.75], names=["q1", "med", "q3"]).first()
    assert (r["n"], r["q1"], r["med"], r["q3"]) == (4, 1.75, 2.5, 4.75)
    empty = exact_quantiles(df.filter("v > 100"), "v", [0.5], names=["med"]).first()
    assert empty["med"] is None


@settings(max_examples=8, deadline=None)
@given(
    st.dictionaries(
        st.sampled_from(["x", "y", "z"]),
        st.lists(st.integers(-50, 50), min_size=1, max_size=40),
        min_size=1,
    ),
    st.integers(1, 9),
)
def test_matches_numpy_property(spark, groups, parts):
    _check(spark, groups, parts)


def test_rounding_modes(spark):
    df = spark.createDataFrame([(0.125, 2.5, -0.125, 7, "a")], "a double, b double, c double, i int, s string")
    up = round_numeric(df, 2, "half_up").first()
    even = round_numeric(df, 2, "half_even").first()
    assert (up["a"], up["b"], up["c"]) == (0.13, 2.5, -0.13)
    assert (even["a"], even["b"], even["c"]) == (0.12, 2.5, -0.12)
    assert (up["i"], up["s"]) == (7, "a")
    z = round_numeric(spark.createDataFrame([(2.5,), (3.5,)], "v double"), 0, "half_even")
    assert sorted(r["v"] for r in z.collect()) == [2.0, 4.0]
    near = spark.createDataFrame([(0.12499999999996,), (2.67499999999997,), (1.00499999999996,)], "v double")
    assert [r["v"] for r in round_numeric(near, 2).collect()] == [0.12, 2.67, 1.0]
    # Only the form that compares engines takes summation noise out first.
    noisy = spark.createDataFrame([(38633.274999999998,), (2.674999999999999,), (None,), (3e10 + 0.004,)], "v double")
    assert [r["v"] for r in round_numeric(noisy, 2, comparable=True).collect()] == [38633.28, 2.68, None, 3e10]


def nearest_by_fractions(x: float, digits: int) -> float:
    """The nearer double of the two decimal neighbours, in exact arithmetic; ties to the even digit."""
    unit = Fraction(1, 10**digits)
    low = abs(Fraction(x)) // unit
    below, above = float(low * unit), float((low + 1) * unit)
    if Fraction(below) == abs(Fraction(x)):
        return x
    down, up = abs(Fraction(x)) - Fraction(below), Fraction(above) - abs(Fraction(x))
    size = below if down < up or (down == up and low % 2 == 0) else above
    return -size if x < 0 and size else size


@pytest.mark.parametrize(
    "value, digits, want",
    [
        (0.15, 1, 0.1), (2.675, 2, 2.67), (1.005, 2, 1.0), (0.285, 2, 0.28), (0.125, 2, 0.12), (0.375, 2, 0.38),
        (-2.675, 2, -2.67), (-0.001, 2, 0.0), (2.5, 0, 2.0), (3.5, 0, 4.0), (-0.5, 0, 0.0), (1250.0, -2, 1200.0),
        (1350.0, -2, 1400.0), (1e300, 2, 1e300), (123456789012345.67, 2, 123456789012345.67), (1e15 + 0.5, 0, 1e15 + 0.5),
        (0.0, 2, 0.0), (7.0, 2, 7.0), (9.995, 2, 9.99), (float("inf"), 2, float("inf")),
    ],
)
def test_nearest_rounds_the_stored_double(spark, value, digits, want):
    df = spark.createDataFrame([(value, None)], "v double, n double")
    got = round_numeric(df, digits, "nearest").first()
    assert got["v"] == want and np.signbit(got["v"]) == (want < 0) and got["n"] is None


def test_nearest_matches_exact_arithmetic(spark):
    rng = np.random.default_rng(8)
    values = [*(rng.integers(-200_000, 200_000, 600) / 1000), *rng.normal(scale=50, size=600), *(rng.integers(0, 4000, 300) / 200)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["v"]: r["r"] for r in df.select("v", round_value(F.col("v"), 2, "nearest").alias("r")).collect()}
    assert got == {v: nearest_by_fractions(v, 2) for v in got}


def test_nearest_leaves_nan_floats_and_decimals_as_they_should_be(spark):
    df = spark.sql("SELECT double('NaN') AS a, CAST(1.235 AS DECIMAL(10,3)) AS d, CAST(2.25 AS FLOAT) AS f, 3 AS i")
    row = round_numeric(df, 1, "nearest").first()
    assert np.isnan(row["a"]) and float(row["d"]) == 1.2 and row["f"] == 2.2 and row["i"] == 3
    with pytest.raises(ValueError):
        round_numeric(df, 1, "up")


@pytest.mark.parametrize("accuracy", [10, 100, 100_000])
def test_brackets_hold_whatever_the_sketch(spark, accuracy):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.integers(0, 5, 999)])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    got = exact_quantiles(frame, "v", PROBS, mean_name="m", accuracy=accuracy).first()
    want = np.percentile(values, [p * 100 for p in PROBS], method="linear")
    assert [got[c] for c in got.asDict() if c.startswith("q")] == pytest.approx(list(want), abs=1e-12)
    assert got["n"] == len(values) and got["m"] == pytest.approx(values.mean())


@pytest.mark.parametrize("splits", [2, 7, 64])
def test_bins_hold_whatever_the_second_sketch(spark, splits):
    rng = np.random.default_rng(splits)
    groups = {"a": rng.normal(size=4000), "b": rng.integers(0, 3, 900).astype(float), "c": np.array([4.0])}
    data = [(g, float(v)) for g, vals in groups.items() for v in vals]
    frame = spark.createDataFrame(data, "g string, v double").repartition(5)
    out = {r["g"]: r for r in exact_quantiles(frame, "v", PROBS, by=["g"], accuracy=10, splits=splits).collect()}
    for g, vals in groups.items():
        want = np.percentile(vals, [p * 100 for p in PROBS], method="linear")
        assert [out[g][c] for c in out[g].asDict() if c.startswith("q")] == pytest.approx(list(want), abs=1e-12)


def test_sorted_partitions_are_bounded_however_wide_the_bracket(spark):
    # A coarse first sketch leaves most of 30,000 values in the bracket; the windows still see shares of it.
    rows = [(1, float(v)) for v in np.random.default_rng(1).normal(size=30_000)]
    values = spark.createDataFrame(rows, "_k0 int, _v double").repartition(6)
    binned = _binned(_bracketed(values, ["_k0"], [0.5], 10, True), ["_k0"], 100).cache()
    sizes = {r["_bin"]: r["count"] for r in binned.groupBy("_bin").count().collect()}
    inside = sum(n for b, n in sizes.items() if 0 <= b < 100)
    assert inside > 10_000 and max(sizes.values()) < 2 * inside / 100
    assert sizes[-1] == sizes[100] == 1
    known = _known_ranks(binned, ["_k0"], [0.5])
    assert known.count() < 5 * inside / 100


def test_groups_without_values_can_be_kept(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, None)], "g string, v double")
    got = {r["g"]: (r["n"], r["m"], r["q"]) for r in exact_quantiles(df, "v", [0.5], ["g"], ["q"], "m", keep_empty=True).collect()}
    assert got == {"a": (1, 1.0, 1.0), "b": (0, None, None), None: (0, None, None)}


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", 7.0), ("a", None)], "g string, v double")
    out = {r["g"]: (r["n"], r["med"]) for r in exact_quantiles(df, "v", [0.5], by=["g"], names=["med"]).collect()}
    assert out == {None: (2, 2.0), "a": (2, 6.0)}


def test_approx_method_same_shape(spark):
    from shelfwise.functions.quantiles import quantiles

    df = spark.createDataFrame([(g, float(v)) for g in ("a", "b") for v in range(101)], "g string, v double")
    exact = {r["g"]: r for r in quantiles(df, "v", [0.5, 0.9], by=["g"], names=["m", "p90"]).collect()}
    approx = {r["g"]: r for r in quantiles(df, "v", [0.5, 0.9], by=["g"], names=["m", "p90"], method="approx").collect()}
    assert set(exact) == set(approx) == {"a", "b"}
    for g in exact:
        assert exact[g]["n"] == approx[g]["n"] == 101
        assert abs(exact[g]["m"] - approx[g]["m"]) <= 1 and abs(exact[g]["p90"] - approx[g]["p90"]) <= 1
