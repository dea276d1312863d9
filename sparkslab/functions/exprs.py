"""Scalar functions as native Columns: no UDF, all inside code generation.

Each has a twin that renders the same formula as SQL text for DuckDB, so that
results can be compared to the last digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numerator and denominator of Hart's rational approximation of the
# normal distribution function, highest power first (West 2005).
NDTR_N = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NDTR_D = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Wichura's AS241 coefficients (central, middle and far ranges), highest power first.
NDTRI_A = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
NDTRI_B = (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
NDTRI_C = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
NDTRI_D = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
NDTRI_E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772)
NDTRI_F = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)
# Lanczos' series for the gamma function, g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)

def _horner_sql(coefficients: tuple[float, ...], x: str) -> str:
    """A polynomial as SQL text; both engines read it."""
    return reduce(lambda acc, c: f"({acc})*({x})+{c!r}", coefficients[1:], repr(coefficients[0]))

def ndtr_sql(x: str) -> str:
    """Normal distribution function as SQL text (for either engine); ``x`` is repeated, so pass a column name."""
    a = f"abs({x})"
    tail = f"exp(-{a}*{a}/2)"
    middle = f"{tail}*({_horner_sql(NDTR_N, a)})/({_horner_sql(NDTR_D, a)})"
    far = f"{tail}/({a}+1/({a}+2/({a}+3/({a}+4/({a}+0.65)))))/2.506628274631"
    low = f"CASE WHEN {a} > 37 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {middle} ELSE {far} END"
    return f"(CASE WHEN {x} > 0 THEN 1 - ({low}) ELSE ({low}) END)"

def ndtri_sql(p: str) -> str:
    """Inverse normal distribution function as SQL text; null outside (0, 1)."""
    q = f"({p} - 0.5e0)"
    r = f"(0.180625e0 - {q}*{q})"
    centre = f"{q}*({_horner_sql(NDTRI_A, r)})/({_horner_sql(NDTRI_B, r)})"
    t = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1 - {p} END))"
    m, f = f"({t} - 1.6e0)", f"({t} - 5e0)"
    tail = f"CASE WHEN {t} <= 5 THEN ({_horner_sql(NDTRI_C, m)})/({_horner_sql(NDTRI_D, m)}) ELSE ({_horner_sql(NDTRI_E, f)})/({_horner_sql(NDTRI_F, f)}) END"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({q}) <= 0.425e0 THEN {centre} ELSE (CASE WHEN {q} < 0 THEN -1 ELSE 1 END)*({tail}) END)"

def expit_sql(x: str) -> str:
    """Logistic function as SQL text."""
    return f"(1/(1+exp(-({x}))))"

def theta_local_sql(beta: str, sigma2: str, kappa: str, xi0: str, xi1: str, wr: str) -> str:
    """Inclusion probability under the local spike and slab, as SQL text."""
    return expit_sql(f"-0.5e0*ln({kappa}) - ({beta})*({beta})/(2*{sigma2})*(1e0/{kappa}-1) + {xi0} + {xi1}*{wr}")

def theta_pmom_sql(beta: str, sigma2: str, tau: str, xi0: str, xi1: str, wr: str, eps: float = 1e-6) -> str:
    """Inclusion probability under the product-moment slab, as SQL text; ``eps`` bounds only the logarithm's argument."""
    b2 = f"(({beta})*({beta}))"
    return expit_sql(f"ln(greatest({b2}, {eps!r})) - 1.5e0*ln({tau}) - ln({sigma2}) + {b2}/(2*{sigma2})*(1-1e0/{tau}) + {xi0} + {xi1}*{wr}")

def ndtr(x: Column) -> Column:
    """Normal distribution function."""
    a = F.abs(x)
    tail = F.exp(-a * a / 2)
    middle = tail * _horner(NDTR_N, a) / _horner(NDTR_D, a)
    far = tail / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    low = F.when(a > 37, 0.0).when(a < 7.07106781186547, middle).otherwise(far)
    return F.when(x > 0, 1 - low).otherwise(low)

def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))

def ndtri(p: Column) -> Column:
    """Inverse normal distribution function; null outside (0, 1)."""
    q = p - 0.5
    r = 0.180625 - q * q
    t = F.sqrt(-F.ln(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(t <= 5, _horner(NDTRI_C, t - 1.6) / _horner(NDTRI_D, t - 1.6)).otherwise(_horner(NDTRI_E, t - 5) / _horner(NDTRI_F, t - 5))
    inside = F.when(F.abs(q) <= 0.425, q * _horner(NDTRI_A, r) / _horner(NDTRI_B, r)).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), inside)

def expit(x: Column) -> Column:
    """Logistic function."""
    return 1 / (1 + F.exp(-x))

def half_up(x: Column, digits: int = 6) -> Column:
    """A small number >= 0 rounded, halves up, without the decimals that ``round`` makes of each."""
    return F.when(F.isnan(x), x).otherwise(F.floor(x * 10.0**digits + 0.5) / 10.0**digits)

def held(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within its bounds; null stays null (greatest and least would give the bound)."""
    out = x if low is None else F.greatest(x, F.lit(low))
    return F.when(x.isNotNull(), out if high is None else F.least(out, F.lit(high)))

def softplus(x: Column) -> Column:
    """ln(1 + exp(x)), without overflow."""
    return held(x, 0.0) + F.log1p(F.exp(-F.abs(x)))

def clipped_exp(x: Column, bound: float = 30.0) -> Column:
    """exp with its argument held within the bound."""
    return F.exp(held(x, -bound, bound))

def lgamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5 (Lanczos)."""
    z = x - 1
    series = reduce(lambda acc, k: acc + LANCZOS[k] / (z + k), range(1, len(LANCZOS)), F.lit(LANCZOS[0]))
    t = z + 7.5
    return 0.9189385332046727 + (z + 0.5) * F.ln(t) - t + F.ln(series)

def binomial_loglik(x: Column, n: Column | float, p: Column) -> Column:
    """x ln p + (n - x) ln(1 - p), p held within 1e-7 of its ends."""
    q = held(p, 1e-7, 1 - 1e-7)
    return x * F.ln(q) + (n - x) * F.ln(1 - q)

def theta_local(beta: Column, sigma2, kappa, xi0, xi1, wr) -> Column:
    """Inclusion probability under the local spike and slab."""
    s, k = (F.lit(v) if not isinstance(v, Column) else v for v in (sigma2, kappa))
    return expit(-0.5 * F.ln(k) - beta * beta / (2 * s) * (1 / k - 1) + xi0 + xi1 * wr)

def theta_pmom(beta: Column, sigma2, tau, xi0, xi1, wr, eps: float = 1e-6) -> Column:
    """Inclusion probability under the product-moment slab."""
    s, t = (F.lit(v) if not isinstance(v, Column) else v for v in (sigma2, tau))
    b2 = beta * beta
    return expit(F.ln(held(b2, eps)) - 1.5 * F.ln(t) - F.ln(s) + b2 / (2 * s) * (1 - 1 / t) + xi0 + xi1 * wr)

def precision(theta: Column, kappa: Column | float) -> Column:
    """Prior precision of a coefficient with inclusion probability theta."""
    return theta / kappa + 1 - theta

def xi_bounds(kappa: float, s: float, gamma: float = 1.0):
    """(xi0 -> largest xi1, largest xi0) that still exclude coefficients below s standard deviations at odds gamma."""
    import math

    top = 0.5 * math.log(kappa) + 0.5 * s * s * (1 / kappa - 1) - math.log(gamma)
    return (lambda xi0: top - xi0), top

def dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)

def squared_distance(x: Column, y: Column) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, b: a + b)

def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays, with 1e-12 added to the denominator."""
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)) + 1e-12)

def ppl(y: Column, mu: Column, family: str, sigma2: float | Column = 1.0, r: float | Column = 1.0) -> Column:
    """Posterior predictive loss, as an aggregate: squared error plus the family's variance."""
    variance = {"bernoulli": mu * (1 - mu), "gaussian": F.lit(sigma2) if not isinstance(sigma2, Column) else sigma2, "poisson": mu, "negbin": mu + mu * mu / r}[family]
    return F.sum((y - mu) * (y - mu) + variance)
