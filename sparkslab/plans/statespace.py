"""Long trajectories: filter, smoother and EM of state-space factors by an associative scan over range buckets of time.

A trajectory's rows are dealt into buckets of consecutive times.  What a bucket
does to any state before it is one small element: the filter, run from a known
start, ends at A start + b with covariance C, and the bucket's rows say about
the start a precision J and a vector eta.  Elements are applied one after the
other, a few numbers a bucket; then every bucket filters its own rows from the
state that reaches it.  The smoother does the same backwards: a bucket's first
smoothed state is E (the next bucket's first) + g, with covariance L.

No task holds more than a bucket's rows, however long a trajectory is, and
trajectories of one bucket take one pass.  Without coupling the covariances
stay diagonal, so states are then vectors of independent chains.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkslab.functions.linalg import solve_lyapunov
from sparkslab.operators.factor import covariance
from sparkslab.operators.suffstats import moments, whole_rows
from sparkslab.plans.dynamic import Dynamic, Second, innovations, loadings_of, principal_start, transition

#: Rows of a bucket, about.
ROWS = 20_000
#: Ends of buckets, of all trajectories, up to which they are broadcast (4 MB).
BROADCAST_ENDS = 500_000

_LOG_2PI = math.log(2 * math.pi)


# ---- one bucket, in NumPy


class _Coupled:
    """States with full covariances."""

    def __init__(self, f: Dynamic) -> None:
        self.k, self.phi, self.q = len(f.q), f.phi, np.diag(f.q)
        self.shape = (self.k, self.k)
        self.eye, self.mul, self.turn = np.eye(self.k), np.matmul, np.transpose

    def stationary(self) -> np.ndarray:
        return solve_lyapunov(self.phi, self.q)

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a b^-1, also of stacks."""
        return np.swapaxes(np.linalg.solve(np.swapaxes(b, -1, -2), np.swapaxes(a, -1, -2)), -1, -2)

    def variances(self, p: np.ndarray) -> np.ndarray:
        return np.diagonal(p, axis1=1, axis2=2)

    def outer(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a[:, :, None] * b[:, None, :]

    def update(self, z, p, m, v, told=None):
        """State and log-likelihood after one row; ``told`` (A, eta, J) follows what the innovations owe to the start."""
        ll = 0.0
        for i in np.flatnonzero(np.isfinite(v)):
            f = p[i, i] + v[i]
            gain, e = p[:, i] / f, m[i] - z[i]
            if told is not None:
                g = told[0][i].copy()
                told[1][:] += g * (e / f)
                told[2][:] += np.outer(g, g) / f
                told[0][:] -= np.outer(gain, g)
            ll -= 0.5 * (_LOG_2PI + math.log(f) + e * e / f)
            z, p = z + gain * e, p - np.outer(gain, p[i])
        return z, p, ll


class _Chains:
    """Independent states: a matrix is its diagonal."""

    def __init__(self, f: Dynamic) -> None:
        self.k, self.phi, self.q = len(f.q), np.diag(f.phi), f.q
        self.shape = (self.k,)
        self.eye, self.mul, self.turn, self.over = np.ones(self.k), np.multiply, lambda a: a, np.divide

    def stationary(self) -> np.ndarray:
        return self.q / np.maximum(1 - self.phi**2, 1e-12)

    def variances(self, p: np.ndarray) -> np.ndarray:
        return p

    def outer(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * b

    def update(self, z, p, m, v, told=None):
        f = p + v  # infinite where nothing is seen: no gain
        gain, e = p / f, m - z
        if told is not None:
            g = told[0].copy()
            told[1][:] += g * e / f
            told[2][:] += g * g / f
            told[0][:] -= gain * g
        seen = np.isfinite(f)
        ll = -0.5 * float(np.sum(_LOG_2PI + np.log(f[seen]) + e[seen] ** 2 / f[seen]))
        return z + gain * e, p - gain * p, ll


def _kind(f: Dynamic, coupled: bool = False) -> _Coupled | _Chains:
    return _Coupled(f) if coupled or np.any(f.phi - np.diag(np.diag(f.phi))) else _Chains(f)


def condense(x: np.ndarray, f: Dynamic) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members (nan: missing) as one observation of each state: value, variance (infinite without members), and the rest of each row's log-likelihood."""
    here = ~np.isnan(x)
    xc = np.where(here, x - f.mean, 0.0)
    own = np.zeros((len(f.owner), len(f.q)))
    own[np.arange(len(f.owner)), f.owner] = 1.0
    d = here @ (own * (f.loadings**2 / f.noise)[:, None])
    h = xc @ (own * (f.loadings / f.noise)[:, None])
    seen = d > 0
    safe = np.where(seen, d, 1.0)
    rest = -0.5 * (here @ (_LOG_2PI + np.log(f.noise)) + (xc * xc) @ (1 / f.noise)) + 0.5 * np.where(seen, h * h / safe + _LOG_2PI - np.log(safe), 0.0).sum(1)
    return np.where(seen, h / safe, 0.0), np.where(seen, 1 / safe, np.inf), rest


class Bucket:
    """Consecutive rows of a trajectory; ``z`` and ``p`` below are the state of the row before the first."""

    def __init__(self, x: np.ndarray, f: Dynamic, of: _Coupled | _Chains | None = None) -> None:
        self.x, self.f, self.of = x, f, of or _kind(f)
        self.m, self.v, self.rest = condense(x, f)

    def _ahead(self, z: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o = self.of
        return o.mul(o.phi, z), o.mul(o.mul(o.phi, p), o.turn(o.phi)) + o.q

    def element(self) -> np.ndarray:
        """A, b, C, eta and J, flat."""
        o = self.of
        if o.shape == (1,):
            return self._element_of_one()
        a, b, c, eta, j = o.eye.copy(), np.zeros(o.k), np.zeros(o.shape), np.zeros(o.k), np.zeros(o.shape)
        for m, v in zip(self.m, self.v, strict=True):
            a = o.mul(o.phi, a)
            b, c = self._ahead(b, c)
            b, c, _ = o.update(b, c, m, v, (a, eta, j))
        return np.concatenate([x.ravel() for x in (a, b, c, eta, j)])

    def _element_of_one(self) -> np.ndarray:
        """The same for one chain, in plain numbers."""
        phi, q, a, b, c, eta, j = float(self.of.phi[0]), float(self.of.q[0]), 1.0, 0.0, 0.0, 0.0, 0.0
        for m, v in zip(self.m[:, 0].tolist(), self.v[:, 0].tolist(), strict=True):
            a, b, c = phi * a, phi * b, phi * phi * c + q
            if v != math.inf:
                f, e = c + v, m - b
                gain = c / f
                eta, j = eta + a * e / f, j + a * a / f
                a, b, c = a - gain * a, b + gain * e, c - gain * c
        return np.array([a, b, c, eta, j])

    def _filter_of_one(self, z: float, p: float):
        phi, q, more, rows = float(self.of.phi[0]), float(self.of.q[0]), 0.0, []
        z, p = phi * z, phi * phi * p + q
        for m, v in zip(self.m[:, 0].tolist(), self.v[:, 0].tolist(), strict=True):
            if v != math.inf:
                f, e = p + v, m - z
                gain = p / f
                z, p, more = z + gain * e, p - gain * p, more + _LOG_2PI + math.log(f) + e * e / f
            at = z, p
            z, p = phi * z, phi * phi * p + q
            rows.append((*at, z, p))
        return (*(c[:, None] for c in np.array(rows).reshape(-1, 4).T.copy()), float(self.rest.sum()) - 0.5 * more)

    def filter(self, z: np.ndarray, p: np.ndarray):
        """Filtered states and covariances, each row's prediction of the next, and the log-likelihood."""
        n, o = len(self.m), self.of
        if o.shape == (1,):
            return self._filter_of_one(float(z[0]), float(p[0]))
        zf, pf, za, pa, ll = np.zeros((n, o.k)), np.zeros((n, *o.shape)), np.zeros((n, o.k)), np.zeros((n, *o.shape)), float(self.rest.sum())
        z, p = self._ahead(z, p)
        for s in range(n):
            z, p, more = o.update(z, p, self.m[s], self.v[s])
            zf[s], pf[s], ll = z, p, ll + more
            z, p = self._ahead(z, p)
            za[s], pa[s] = z, p
        return zf, pf, za, pa, ll

    def _gains(self, pf: np.ndarray, pa: np.ndarray) -> np.ndarray:
        return self.of.over(self.of.mul(pf, self.of.turn(self.of.phi)), pa)

    def backward(self, z: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """E, g and L, flat; and what the last row predicts, from which a trajectory's last bucket starts backwards."""
        o = self.of
        zf, pf, za, pa, _ = self.filter(z, p)
        e, g, c = o.eye.copy(), np.zeros(o.k), np.zeros(o.shape)
        gains = self._gains(pf, pa)
        for s in range(len(zf) - 1, -1, -1):
            j = gains[s]
            e, g, c = o.mul(j, e), zf[s] + o.mul(j, g - za[s]), pf[s] + o.mul(o.mul(j, c - pa[s]), o.turn(j))
        return np.concatenate([x.ravel() for x in (e, g, c)]), za[-1], pa[-1]

    def smooth(self, z: np.ndarray, p: np.ndarray, after: tuple[np.ndarray, np.ndarray] | None):
        """Smoothed states and covariances, covariances of each row with the next, and the log-likelihood; ``after`` is the next bucket's first row."""
        o = self.of
        zf, pf, za, pa, ll = self.filter(z, p)
        gains, lag = self._gains(pf, pa), np.zeros_like(pf)
        for s in range(len(zf) - 1, -1, -1):
            if after is not None:
                j = gains[s]
                zf[s], pf[s], lag[s] = zf[s] + o.mul(j, after[0] - za[s]), pf[s] + o.mul(o.mul(j, after[1] - pa[s]), o.turn(j)), o.mul(j, after[1])
            after = zf[s], pf[s]
        return zf, pf, lag, ll


def _parts(flat, *shapes: tuple) -> list[np.ndarray]:
    cut = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return [x.reshape(s) for x, s in zip(np.split(np.asarray(flat, float), cut), shapes, strict=True)]


def advance(o, z: np.ndarray, p: np.ndarray, element) -> tuple[np.ndarray, np.ndarray]:
    """The state at a bucket's end, from the state before it."""
    a, b, c, eta, j = _parts(element, o.shape, (o.k,), o.shape, (o.k,), o.shape)
    told = o.over(a, o.eye + o.mul(p, j))
    end = o.mul(o.mul(told, p), o.turn(a)) + c
    return o.mul(told, z + o.mul(p, eta)) + b, (end + o.turn(end)) / 2


# ---- all buckets, in Spark


def dealt(rows: DataFrame, by: list[str], time: str, per_bucket: int = ROWS) -> tuple[DataFrame, int]:
    """``rows`` with _g (the trajectory as text), _bucket and _tie, and the number of buckets of the longest.

    Null times come first; rows of one time are in the order of a hash of the row.
    """
    rows = rows.withColumns({"_tie": F.xxhash64(*rows.columns), "_g": F.to_json(F.struct(*by)) if by else F.lit("{}")})
    longest, groups = rows.groupBy("_g").count().agg(F.max("count"), F.count("*")).first()
    n = max(1, math.ceil((longest or 0) / per_bucket))
    if n == 1:
        return rows.withColumn("_bucket", F.lit(0)), 1
    ends = rows.groupBy("_g").agg(F.percentile_approx(time, [k / n for k in range(1, n)], max(1_000, 16 * n)).alias("_ends"))
    # a row's bucket is found by ends of ends, so that its search grows with the root of their number
    hop = math.isqrt(n) + 1
    ends = ends.withColumn("_hops", F.filter("_ends", lambda _, k: (k + 1) % hop == 0))
    if groups * n <= BROADCAST_ENDS:  # else a shuffle by trajectory comes first
        ends = F.broadcast(ends)
    passed = lambda c: F.coalesce(F.size(F.filter(c, lambda b: b < F.col(time))), F.lit(0))
    rows = rows.join(ends, "_g", "left").withColumn("_skipped", passed("_hops") * hop)
    rows = rows.withColumn("_bucket", F.col("_skipped") + passed(F.slice("_ends", F.col("_skipped") + 1, F.lit(hop))))
    return rows.drop("_ends", "_hops", "_skipped").repartition("_g", "_bucket"), n  # the join would leave a trajectory in one task


_STATE = "_g string, _bucket int, z array<double>, p array<double>"


def _one(pdf: pd.DataFrame, **values) -> pd.DataFrame:
    return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "_bucket": [pdf["_bucket"].iloc[0]], **{k: [v.ravel()] for k, v in values.items()}})


class Scan:
    """Passes over rows that are dealt once; ``f`` may change between passes."""

    def __init__(self, rows: DataFrame, f: Dynamic, by: list[str] | None = None, time: str = "t", per_bucket: int = ROWS, start: tuple[np.ndarray, np.ndarray] | None = None, coupled: bool = False) -> None:
        """``start``: state and covariance of the row before the first; else trajectories start from the stationary state.

        ``coupled`` keeps full covariances even where the transition has no coupling yet.
        """
        self.f, self.time, self.start, self.coupled = f, time, start, coupled
        self.rows, self.buckets = dealt(rows, by or [], time, per_bucket)

    def _tools(self):
        """What the passes' functions need, without the session; only parameters of the model."""
        f, time, o = replace(self.f, z=np.zeros((0, 0)), z_var=np.zeros((0, 0)), loglik=[]), self.time, _kind(self.f, self.coupled)
        start = (np.zeros(o.k), o.stationary()) if self.start is None else (np.asarray(self.start[0], float), np.asarray(self.start[1], float))
        if start[1].shape != o.shape:
            start = start[0], np.diagonal(start[1]).copy()

        def bucket(pdf: pd.DataFrame) -> tuple[pd.DataFrame, Bucket]:
            pdf = pdf.sort_values([time, "_tie"], na_position="first", kind="stable")
            missing = [np.nan] * len(f.owner)
            return pdf, Bucket(np.array([missing if x is None else x for x in pdf["x"]], float), f, o)

        def state(carried: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            return np.asarray(carried["z"].iloc[0], float), np.asarray(carried["p"].iloc[0], float).reshape(o.shape)

        return o, start, bucket, state

    def forward(self) -> DataFrame | None:
        """(_g, _bucket, z, p): the state before each bucket; None where every trajectory is one bucket."""
        if self.buckets == 1:
            return None
        o, start, bucket, _ = self._tools()

        def element(pdf: pd.DataFrame) -> pd.DataFrame:
            return _one(pdf, e=bucket(pdf)[1].element())

        def carry(pdf: pd.DataFrame) -> pd.DataFrame:
            (z, p), out = start, []
            for g, b, e in pdf.sort_values("_bucket").itertuples(index=False):
                out.append((g, b, z, p.ravel()))
                z, p = advance(o, z, p, e)
            return pd.DataFrame(out, columns=["_g", "_bucket", "z", "p"])

        return self.rows.groupBy("_g", "_bucket").applyInPandas(element, "_g string, _bucket int, e array<double>").groupBy("_g").applyInPandas(carry, _STATE)

    def backward(self, before: DataFrame | None) -> DataFrame | None:
        """(_g, _bucket, z, p): the smoothed state of the first row after each bucket that has one."""
        if before is None:
            return None
        o, _, bucket, state = self._tools()

        def element(pdf: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
            e, z, p = bucket(pdf)[1].backward(*state(carried))
            return _one(pdf, e=e, z=z, p=p)

        def carry(pdf: pd.DataFrame) -> pd.DataFrame:
            after, out = None, []
            for g, b, e, z, p in pdf.sort_values("_bucket", ascending=False).itertuples(index=False):
                if after is None:
                    after = np.asarray(z), np.asarray(p).reshape(o.shape)
                else:
                    out.append((g, b, after[0], after[1].ravel()))
                gain, offset, c = _parts(e, o.shape, (o.k,), o.shape)
                after = o.mul(gain, after[0]) + offset, o.mul(o.mul(gain, after[1]), o.turn(gain)) + c
            return pd.DataFrame(out, columns=["_g", "_bucket", "z", "p"])

        made = self.rows.groupBy("_g", "_bucket").cogroup(before.groupBy("_g", "_bucket")).applyInPandas(element, "_g string, _bucket int, e array<double>, z array<double>, p array<double>")
        return made.groupBy("_g").applyInPandas(carry, _STATE)

    def each(self, run, schema: str, smooth: bool = False) -> DataFrame:
        """``run`` (sorted rows, bucket, state before, state after or None) of every bucket."""
        before = self.forward()
        _, start, bucket, state = self._tools()
        if before is None:
            return self.rows.groupBy("_g", "_bucket").applyInPandas(lambda pdf: run(*bucket(pdf), start, None), schema)
        carried = before.withColumn("ahead", F.lit(False))
        if smooth:
            carried = carried.unionByName(self.backward(before).withColumn("ahead", F.lit(True)))

        def met(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            ahead = known[known["ahead"]]
            return run(*bucket(pdf), state(known[~known["ahead"]]), state(ahead) if len(ahead) else None)

        return self.rows.groupBy("_g", "_bucket").cogroup(carried.groupBy("_g", "_bucket")).applyInPandas(met, schema)


def states(rows: DataFrame, f: Dynamic, by: list[str] | None = None, time: str = "t", keep: list[str] | None = None, smooth: bool = False, per_bucket: int = ROWS, start: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The ``keep`` columns of ``rows`` (unless given, all but x) with z and z_var, arrays over the states of ``f``.

    ``rows`` has ``time``, x (array of members; a null is missing) and the ``by``
    columns that tell trajectories apart.  A trajectory's rows are its steps, in
    the order of time, null times first.
    """
    scan = Scan(rows, f, by, time, per_bucket, start)
    names = [c for c in rows.columns if c != "x"] if keep is None else keep
    of = _kind(f)

    def run(pdf: pd.DataFrame, b: Bucket, before, after) -> pd.DataFrame:
        z, p = (b.smooth(*before, after) if smooth else b.filter(*before))[:2]
        return pdf[names].assign(z=list(z), z_var=list(of.variances(p)))

    types = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in names)
    return scan.each(run, f"{types}z array<double>, z_var array<double>", smooth)


def joined(fits: list[Dynamic], members: list[np.ndarray]) -> Dynamic:
    """Independent factors as one model of chains; ``members`` has each factor's places in x."""
    p = sum(len(m) for m in members)
    loadings, noise, mean, owner = np.zeros(p), np.ones(p), np.zeros(p), np.zeros(p, int)
    for b, (f, at) in enumerate(zip(fits, members, strict=True)):
        loadings[at], noise[at], mean[at], owner[at] = f.loadings, f.noise, f.mean, b
    return Dynamic(loadings, noise, owner, np.diag([f.phi[0, 0] for f in fits]), np.array([f.q[0] for f in fits]), mean, np.zeros((0, len(fits))), np.zeros((0, len(fits))), [], (0.0, 0.0))


# ---- EM


class _Sums:
    """What the M-step needs of all rows."""

    def __init__(self, scan: Scan) -> None:
        o, p = _kind(scan.f, scan.coupled), len(scan.f.owner)

        def run(pdf: pd.DataFrame, b: Bucket, before, after) -> pd.DataFrame:
            z, cov, lag, ll = b.smooth(*before, after)
            each = o.outer(z, z) + cov
            following = z[1:] if after is None else np.concatenate([z[1:], after[0][None]])
            n = len(following)
            cross = o.outer(following, z[:n]).sum(0) + o.turn(lag[:n].sum(0))
            xc = b.x - b.f.mean
            parts = [[len(z), ll], z.sum(0), (z * z).sum(0), each.sum(0), each[0], each[-1], cross, np.einsum("tj,tj->j", xc, z[:, b.f.owner]), (xc * xc).sum(0)]
            return _one(pdf, v=np.concatenate([np.ravel(x) for x in parts]))

        shapes = ((2,), (o.k,), (o.k,), o.shape, o.shape, o.shape, o.shape, (p,), (p,))
        found = sorted((r[1], r[2]) for r in scan.each(run, "_g string, _bucket int, v array<double>", True).collect())
        head, total, squared, every, _, _, cross, self.shared, self.squares = _parts(np.sum([v for _, v in found], axis=0), *shapes)
        first, last = _parts(found[0][1], *shapes)[4], _parts(found[-1][1], *shapes)[5]
        self.n, self.loglik = int(head[0]), float(head[1])
        self.spread = squared / self.n - (total / self.n) ** 2
        full = np.diag if len(o.shape) == 1 else np.asarray
        self.second = Second(full(every), full(every - last), full(every - first), full(cross))

    def of(self, b: int) -> Second:
        """Of one state by itself."""
        return Second(*[m[b : b + 1, b : b + 1] for m in (self.second.every, self.second.past, self.second.now, self.second.cross)])


def fit_states(rows: DataFrame, owner: np.ndarray, w: np.ndarray | None = None, time: str = "t", n_iter: int = 200, tol: float = 1e-4, rho: tuple[float, float] = (0.5, 0.0), per_bucket: int = ROWS) -> list[Dynamic]:
    """The fits of ``dynamic.fit_dynamic`` to one trajectory (time, x) of any length: with ``w`` one of coupled factors, else one AR(1) factor for each block of ``owner``.

    An iteration is one set of passes for all factors; those that are settled
    keep their parameters.  The driver holds a few numbers a bucket.  Rows with
    a null among the members are left out.  The states aren't kept: ``states``
    gives them.
    """
    rows = whole_rows(rows.select(F.col(time), "x").withColumn("y", F.lit(0.0)))
    owner = np.asarray(owner)
    mean, cov = covariance(moments(rows))
    k, coupling = int(owner.max()) + 1, None if w is None else np.asarray(w, float)
    loadings, noise = principal_start(cov, owner)
    blocks = [np.arange(len(owner))] if coupling is not None else [np.flatnonzero(owner == b) for b in range(k)]
    rhos, q, traces = [rho] * len(blocks), np.full(k, 1 - rho[0] ** 2), [[] for _ in blocks]
    settled, done = [False] * len(blocks), [False] * len(blocks)

    def phi() -> np.ndarray:
        return np.diag([r[0] for r in rhos]) if coupling is None else rhos[0][0] * np.eye(k) + rhos[0][1] * coupling

    scan = Scan(rows, Dynamic(loadings, noise, owner, phi(), q, mean, np.zeros((0, k)), np.zeros((0, k)), [], rho), None, time, per_bucket, coupled=coupling is not None)
    scan.rows = scan.rows.drop("y").persist()
    while True:
        scan.f = replace(scan.f, loadings=loadings.copy(), noise=noise.copy(), q=q.copy(), phi=phi())
        s = _Sums(scan)
        for b, at in enumerate(blocks):
            if done[b]:
                continue
            traces[b].append(s.loglik)
            if settled[b] or len(traces[b]) > n_iter:
                done[b] = True
                continue
            m = s.second if coupling is not None else s.of(b)
            states_of = slice(None) if coupling is not None else slice(b, b + 1)
            own = owner if coupling is not None else np.zeros(len(at), int)
            before = np.concatenate([loadings[at], noise[at], rhos[b]])
            rhos[b] = transition(m, coupling)
            new_q = innovations(m, phi() if coupling is not None else np.array([[rhos[b][0]]]), s.n - 1)
            new_loadings, noise[at] = loadings_of(s.shared[at], s.squares[at], s.n, own, m)
            if coupling is None:
                unit = np.sqrt(new_q / (1 - rhos[b][0] ** 2))
                new_loadings, new_q = new_loadings * unit, new_q / unit**2
            loadings[at], q[states_of] = new_loadings, new_q
            after = np.concatenate([loadings[at], noise[at], rhos[b]])
            settled[b] = np.linalg.norm(after - before) < tol * np.linalg.norm(before)
        if all(done):
            break
    scan.rows.unpersist()
    scale = 1.0 if coupling is None else float(np.sqrt(s.spread.mean())) or 1.0
    out = []
    for b, at in enumerate(blocks):
        own = owner if coupling is not None else np.zeros(len(at), int)
        sign = 1 if np.mean([loadings[at][own == c].mean() for c in range(own.max() + 1)]) >= 0 else -1
        own_q, matrix = (q, phi()) if coupling is not None else (q[b : b + 1], np.array([[rhos[b][0]]]))
        out.append(Dynamic(sign * loadings[at] * scale, noise[at], own, matrix, own_q / scale**2, mean[at], np.zeros((0, len(own_q))), np.zeros((0, len(own_q))), traces[b], rhos[b]))
    return out
