"""Student-t tail probabilities and critical values as Arrow-batched column functions.

Spark SQL has no t distribution, so this is the one place the library leaves the JVM. The
functions are applied to *aggregated* rows (one per test / per group fit), never to fact rows,
so the Python cost does not grow with the data.

Math: for T with ``nu`` degrees of freedom, ``P(|T| > t) = I_x(nu/2, 1/2)`` with
``x = nu / (nu + t^2)``, where ``I`` is the regularised incomplete beta function, evaluated
by its continued fraction (modified Lentz iteration), vectorised with numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_EPS = 1e-15
_MAX_TERMS = 500

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_cf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (converges for x < (a+1)/(a+b+2))."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = np.where(np.abs(d) < _TINY, _TINY, d)
    d = 1.0 / d
    out = d.copy()
    done = np.zeros(x.shape, dtype=bool)
    for m in range(1, _MAX_TERMS + 1):
        two_m = 2.0 * m
        for coef in (
            m * (b - m) * x / ((a + two_m - 1.0) * (a + two_m)),
            -(a + m) * (a + b + m) * x / ((a + two_m) * (a + two_m + 1.0)),
        ):
            d = 1.0 + coef * d
            d = np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + coef / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            d = 1.0 / d
            step = c * d
            out = np.where(done, out, out * step)
        done |= np.abs(step - 1.0) < _EPS
        if done.all():
            break
    return out


def regularized_beta(a, b, x) -> np.ndarray:
    """``I_x(a, b)`` for arrays of equal shape (NaN where inputs are invalid)."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    valid = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    a_, b_ = np.where(valid, a, 1.0), np.where(valid, b, 1.0)
    x_ = np.clip(np.where(valid, x, 0.5), 0.0, 1.0)
    inner = (x_ > 0) & (x_ < 1)
    xs = np.where(inner, x_, 0.5)
    log_front = (
        _lgamma(a_ + b_) - _lgamma(a_) - _lgamma(b_) + a_ * np.log(xs) + b_ * np.log1p(-xs)
    )
    front = np.exp(log_front)
    direct = xs < (a_ + 1.0) / (a_ + b_ + 2.0)
    lower = front * _beta_cf(a_, b_, xs) / a_
    upper = 1.0 - front * _beta_cf(b_, a_, 1.0 - xs) / b_
    res = np.where(direct, lower, upper)
    res = np.where(x_ <= 0, 0.0, np.where(x_ >= 1, 1.0, res))
    return np.where(valid, res, np.nan)


def t_two_sided_p(t, nu) -> np.ndarray:
    """``P(|T_nu| > |t|)``; NaN for nu <= 0 or missing input."""
    t, nu = np.asarray(t, dtype=float), np.asarray(nu, dtype=float)
    x = nu / (nu + t * t)
    return regularized_beta(nu / 2.0, np.full_like(nu, 0.5), x)


def t_density(t, nu) -> np.ndarray:
    """Student-t density."""
    t, nu = np.asarray(t, dtype=float), np.asarray(nu, dtype=float)
    log_c = _lgamma((nu + 1.0) / 2.0) - _lgamma(nu / 2.0) - 0.5 * np.log(nu * np.pi)
    return np.exp(log_c - (nu + 1.0) / 2.0 * np.log1p(t * t / nu))


def t_critical(conf, nu, tol: float = 1e-12, max_iter: int = 100) -> np.ndarray:
    """Two-sided critical value ``q`` with ``P(|T_nu| > q) = 1 - conf``.

    Newton steps on ``P(|T| > q) - alpha`` (derivative ``-2 f(q)``), kept inside a bracket
    that starts at [0, 1], doubles until it contains the root (t_{0.9995, 1} ~ 636) and
    shrinks with every evaluation; a step leaving the bracket is replaced by bisection.
    """
    conf, nu = np.asarray(conf, dtype=float), np.asarray(nu, dtype=float)
    alpha = 1.0 - conf
    ok = (nu > 0) & (alpha > 0) & (alpha < 1)
    nu_, alpha_ = np.where(ok, nu, 1.0), np.where(ok, alpha, 0.5)
    lo, hi = np.zeros_like(nu_), np.ones_like(nu_)
    for _ in range(64):
        grow = t_two_sided_p(hi, nu_) > alpha_
        if not grow.any():
            break
        lo = np.where(grow, hi, lo)
        hi = np.where(grow, hi * 2.0, hi)
    q = 0.5 * (lo + hi)
    for _ in range(max_iter):
        g = t_two_sided_p(q, nu_) - alpha_
        lo, hi = np.where(g > 0, q, lo), np.where(g > 0, hi, q)
        step = g / (2.0 * t_density(q, nu_))
        nxt = q + step
        nxt = np.where((nxt > lo) & (nxt < hi) & np.isfinite(nxt), nxt, 0.5 * (lo + hi))
        done = np.abs(nxt - q) <= tol * np.maximum(q, 1.0)
        q = nxt
        if done.all():
            break
    return np.where(ok, q, np.nan)


def _to_series(values: np.ndarray, index) -> pd.Series:
    s = pd.Series(values, index=index, dtype="float64")
    return s.where(np.isfinite(s), None)


@F.pandas_udf(T.DoubleType())
def _t_pvalue_udf(t: pd.Series, nu: pd.Series) -> pd.Series:
    return _to_series(t_two_sided_p(t.to_numpy(dtype=float, na_value=np.nan),
                                    nu.to_numpy(dtype=float, na_value=np.nan)), t.index)


@F.pandas_udf(T.DoubleType())
def _t_critical_udf(conf: pd.Series, nu: pd.Series) -> pd.Series:
    return _to_series(t_critical(conf.to_numpy(dtype=float, na_value=np.nan),
                                 nu.to_numpy(dtype=float, na_value=np.nan)), conf.index)


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value column; NULL when t or df is NULL or df <= 0."""
    return _t_pvalue_udf(t.cast("double"), df.cast("double"))


def t_quantile(conf: Column | float, df: Column) -> Column:
    """Two-sided critical value column for confidence ``conf`` (e.g. 0.95 -> t_{0.975, df})."""
    conf_col = conf if isinstance(conf, Column) else F.lit(float(conf))
    return _t_critical_udf(conf_col.cast("double"), df.cast("double"))
