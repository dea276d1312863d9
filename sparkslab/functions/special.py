"""Incomplete gamma and beta functions, vectorised in NumPy, and their distributions' inverses."""

from __future__ import annotations

import math

import numpy as np

_TINY, _STEPS = 1e-300, 500


def gamma_cdf(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function P(a, x); nan stays nan, x below 0 gives 0."""
    x = np.asarray(x, float)
    out = np.where(np.isnan(x), np.nan, 0.0)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(np.maximum(x, _TINY)) - x - math.lgamma(a))
        low = (x > 0) & (x < a + 1)
        if low.any():  # series
            v = x[low]
            term = total = np.full(v.shape, 1 / a)
            for k in range(1, _STEPS):
                term = term * v / (a + k)
                total = total + term
                if np.all(term < 1e-17 * total):
                    break
            out[low] = front[low] * total
        high = (x >= a + 1) & np.isfinite(x)
        if high.any():  # continued fraction of the rest, from its end
            v = x[high]
            b = v + 1 - a
            c, d = np.full(v.shape, 1 / _TINY), 1 / b
            h = d
            for k in range(1, _STEPS):
                an = -k * (k - a)
                b = b + 2
                d = 1 / np.where(np.abs(an * d + b) < _TINY, _TINY, an * d + b)
                c = np.where(np.abs(b + an / c) < _TINY, _TINY, b + an / c)
                h = h * c * d
                if np.all(np.abs(c * d - 1) < 1e-16):
                    break
            out[high] = 1 - front[high] * h
    out[x == np.inf] = 1.0
    return out


def beta_cdf(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b); nan stays nan, x is held within 0..1."""
    x = np.clip(np.asarray(x, float), 0, 1)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(np.maximum(x, _TINY)) + b * np.log(np.maximum(1 - x, _TINY)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        turned = x > (a + 1) / (a + b + 2)
        value = np.where(turned, _beta_fraction(b, a, 1 - x) / b, _beta_fraction(a, b, x) / a) * front
    out = np.where(turned, 1 - value, value)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def _beta_fraction(a: float, b: float, x: np.ndarray) -> np.ndarray:
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < _TINY, _TINY, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, _STEPS):
        before = h
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + top * d) < _TINY, _TINY, 1 + top * d)
            c = np.where(np.abs(1 + top / c) < _TINY, _TINY, 1 + top / c)
            h = h * c * d
        if not np.any(np.abs(h - before) > 1e-16 * np.abs(h)):
            break
    return h


def inverse(cdf, u: np.ndarray, low: float, high: float, steps: int = 200) -> np.ndarray:
    """x with cdf(x) = u by halving [low, high], an end of which may be infinite (it is sought by doubling)."""
    u = np.asarray(u, float)
    a, b = np.full(u.shape, -1.0 if math.isinf(low) else low), np.full(u.shape, max(low, 0.0) + 1.0 if math.isinf(high) else high)
    for _ in range(1000):
        more = (cdf(b) < u) if math.isinf(high) else np.zeros(u.shape, bool)
        less = (cdf(a) > u) if math.isinf(low) else np.zeros(u.shape, bool)
        if not (more.any() or less.any()):
            break
        b, a = np.where(more, b * 2, b), np.where(less, a * 2, a)
    for _ in range(steps):
        mid = (a + b) / 2
        under = cdf(mid) < u
        a, b = np.where(under, mid, a), np.where(under, b, mid)
        if np.all(b - a <= 1e-15 * np.maximum(np.abs(a), np.abs(b))):
            break
    return np.where(np.isnan(u), np.nan, (a + b) / 2)
