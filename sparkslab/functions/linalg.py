"""Driver-side linear algebra and samplers on p- or p-by-p-sized objects (NumPy)."""

from __future__ import annotations

import math

import numpy as np


def effective_rank(r: np.ndarray, rel_tol: float = 1e-6) -> int:
    """Eigenvalues above ``rel_tol`` times the largest."""
    e = np.linalg.eigvalsh(r)
    return int((e > rel_tol * e.max()).sum())


class EigenSurrogate:
    """Rank-l form of a correlation matrix: U diag(e) U'."""

    def __init__(self, r: np.ndarray, rank: int) -> None:
        e, u = np.linalg.eigh(r)
        top = np.argsort(e)[::-1][:rank]
        self.e, self.u, self.full = np.maximum(e[top], 0), u[:, top], r

    def matrix(self) -> np.ndarray:
        """The reconstruction."""
        return (self.u * self.e) @ self.u.T

    def project(self, v: np.ndarray) -> np.ndarray:
        """A vector's part in the kept space; marginal coefficients must be projected along with R."""
        return self.u @ (self.u.T @ v)

    def relative_error(self) -> float:
        """Frobenius norm of what is lost, relative to the matrix."""
        return float(np.linalg.norm(self.full - self.matrix()) / np.linalg.norm(self.full))

    def factor(self, weight: float, n: float) -> np.ndarray:
        """S with S'S = weight * n * (rank-l R)."""
        return np.sqrt(weight * n * self.e)[:, None] * self.u.T


def woodbury_solve(s: np.ndarray, diag: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(S'S + diag(1 / diag))^-1 v through an l-by-l system."""
    ds = diag[:, None] * s.T
    return diag * v - ds @ np.linalg.solve(np.eye(len(s)) + s @ ds, s @ (diag * v))


def woodbury_draw(s: np.ndarray, diag: np.ndarray, c: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Mean of N((S'S + D^-1)^-1 c, (S'S + D^-1)^-1) and an exact draw from it, l by l."""
    mean = woodbury_solve(s, diag, c)
    u = np.sqrt(diag) * rng.standard_normal(len(diag))
    d = s @ u + rng.standard_normal(len(s))
    return mean, mean + u - diag * (s.T @ np.linalg.solve(np.eye(len(s)) + (s * diag) @ s.T, d))


def exact_draw(gram: np.ndarray, diag: np.ndarray, c: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The same with the full precision matrix gram + diag(1 / diag)."""
    chol = np.linalg.cholesky(gram + np.diag(1 / diag))
    mean = np.linalg.solve(chol.T, np.linalg.solve(chol, c))
    return mean, mean + np.linalg.solve(chol.T, rng.standard_normal(len(c)))


def rank1_loglik(cov: np.ndarray, n: float, w: np.ndarray, sigma2: np.ndarray) -> float:
    """Log-likelihood of n centred rows with (biased) covariance ``cov`` under w w' + diag(sigma2)."""
    a = w / sigma2
    k = 1 + w @ a
    quad = np.sum(np.diag(cov) / sigma2) - a @ cov @ a / k
    return float(-0.5 * n * (len(w) * math.log(2 * math.pi) + np.log(sigma2).sum() + math.log(k) + quad))


def minimize(f, low: float, high: float, tol: float = 1e-6, steps: int = 200) -> float:
    """The least of a function of one variable in an interval, by golden section after a coarse scan."""
    grid = np.linspace(low, high, 25)
    k = int(np.argmin([f(x) for x in grid]))
    a, b = grid[max(0, k - 1)], grid[min(24, k + 1)]
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if b - a < tol:
            break
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def solve_lyapunov(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """P = A P A' + Q by doubling."""
    p = q.copy()
    for _ in range(60):
        step = a @ p @ a.T
        p, a = p + step, a @ a
        if np.abs(step).max() < 1e-14 * max(1.0, np.abs(p).max()):
            break
    return p


#: Where the two forms of the alternating series meet; sums of PG(1, c) are drawn for whole b up to WHOLE.
_MEET, WHOLE = 0.64, 16

_erfc = np.frompyfunc(math.erfc, 1, 1)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Of the standard normal distribution."""
    return 0.5 * _erfc(-x / math.sqrt(2)).astype(float)


def _inverse_gaussian_below(z: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draws from the inverse Gaussian with mean 1 / z and shape 1, given that they are below ``_MEET``."""
    out, left = np.zeros(len(z)), np.arange(len(z))
    while len(left):
        zz = z[left]
        x = np.full(len(left), np.inf)
        small = zz < 1 / _MEET
        k = int(small.sum())
        # a mean above the bound: the z = 0 law below the bound, tilted by rejection
        e, f = rng.exponential(size=k), rng.exponential(size=k)
        tried = np.where(e * e <= 2 * f / _MEET, _MEET / (1 + _MEET * e) ** 2, np.inf)
        tried[~(rng.random(k) <= np.exp(-0.5 * zz[small] ** 2 * np.where(np.isfinite(tried), tried, 0)))] = np.inf
        x[small] = tried
        # else the law itself, by its root
        mu = 1 / zz[~small]
        y = rng.standard_normal(len(mu)) ** 2
        root = mu + 0.5 * mu * mu * y - 0.5 * mu * np.sqrt(4 * mu * y + (mu * y) ** 2)
        x[~small] = np.where(rng.random(len(mu)) > mu / (mu + root), mu * mu / root, root)
        good = x < _MEET
        out[left[good]] = x[good]
        left = left[~good]
    return out


def _series_term(n: int, x: np.ndarray) -> np.ndarray:
    h = math.pi * (n + 0.5)
    return np.where(x > _MEET, h * np.exp(-0.5 * h * h * x), h * (2 / (math.pi * x)) ** 1.5 * np.exp(-2 * (n + 0.5) ** 2 / x))


def polya_gamma_one(c: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Exact draws from PG(1, c): a two-piece proposal, accepted by bounds of the density's alternating series."""
    z = np.abs(np.asarray(c, float)).ravel() / 2
    rate = math.pi**2 / 8 + z * z / 2
    above = math.pi / (2 * rate) * np.exp(-rate * _MEET)
    root, zz = math.sqrt(1 / _MEET), np.minimum(z, 300.0)
    below = 2 * (np.exp(-z) * normal_cdf(root * (_MEET * z - 1)) + np.exp(zz) * normal_cdf(-root * (_MEET * zz + 1)))
    share = above / (above + below)
    out, left = np.zeros(len(z)), np.arange(len(z))
    while len(left):
        far = rng.random(len(left)) < share[left]
        x = np.empty(len(left))
        x[far] = _MEET + rng.exponential(size=int(far.sum())) / rate[left[far]]
        x[~far] = _inverse_gaussian_below(z[left[~far]], rng)
        total = _series_term(0, x)
        bar = rng.random(len(left)) * total
        accepted, undecided, n = np.zeros(len(left), bool), np.ones(len(left), bool), 0
        while undecided.any():
            n += 1
            total = total + (-1) ** n * _series_term(n, x)
            if n % 2:
                accepted |= undecided & (bar <= total)
                undecided &= bar > total
            else:
                undecided &= bar <= total
        out[left[accepted]] = x[accepted] / 4
        left = left[~accepted]
    return out.reshape(np.shape(c))


def _polya_gamma_series(b: np.ndarray, c: np.ndarray, rng: np.random.Generator, terms: int) -> np.ndarray:
    """The first terms of the series of gamma variables; the rest is one gamma variable of its mean and variance."""
    a = np.abs(c) / (2 * math.pi)
    k = np.arange(1, terms + 1) - 0.5
    draw = (rng.gamma(np.maximum(b, 1e-12)[..., None], 1.0, (*b.shape, terms)) / (k**2 + a[..., None] ** 2)).sum(-1)
    # sums over the terms left out are integrals by the midpoint rule, with its first correction
    t, q = float(terms), (a / terms) ** 2
    safe = np.maximum(a, 1e-9)
    turn = np.arctan(safe / t)
    series = [sum((-1) ** j * w(j) * q**j for j in range(16)) for w in (lambda j: 1 / (2 * j + 1), lambda j: (j + 1) / (2 * j + 3))]
    one = np.where(q < 0.1, series[0] / t, turn / safe)
    two = np.where(q < 0.1, series[1] / t**3, (turn - safe * t / (t * t + safe**2)) / (2 * safe**3))
    mean = b * (one - t / 12 / (t * t + a * a) ** 2)
    var = b * (two - t / 6 / (t * t + a * a) ** 3)
    return (draw + rng.gamma(np.maximum(mean * mean / var, 1e-12)) * var / mean) / (2 * math.pi**2)


def polya_gamma(b: np.ndarray, c: np.ndarray, rng: np.random.Generator, terms: int = 64) -> np.ndarray:
    """Draws from PG(b, c), b > 0.

    Whole b up to ``WHOLE`` are sums of exact PG(1, c) draws.  For any other b
    the series of gamma variables is drawn for ``terms`` terms, and what is left
    of it, a share of about 1e-5 of the variance, as a gamma variable with its
    very mean and variance.
    """
    b, c = np.broadcast_arrays(np.asarray(b, float), np.asarray(c, float))
    whole = (b == np.floor(b)) & (b <= WHOLE) & (b > 0)
    out = np.zeros(b.shape)
    for n in np.unique(b[whole]).astype(int):
        at = whole & (b == n)
        out[at] = polya_gamma_one(np.repeat(c[at], n), rng).reshape(-1, n).sum(1)
    if not whole.all():
        out[~whole] = _polya_gamma_series(b[~whole], c[~whole], rng, terms)
    return out
