"""Statistical Column expressions: t and proportion intervals, normal CDF.

Everything here is a built-in expression over aggregates, so Catalyst keeps
it inside whole-stage code generation.  The only driver-side computation is
the table of Student-t critical values, a fixed 100-entry constant built
once per process in plain Python (no scipy in the image).
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided 95 % level, z = Phi^-1(0.975).
Z975 = 1.959963984540054
T_TABLE_MAX_DF = 100


# --------------------------------------------------------------------------
# Student t quantiles (driver side, once)

def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_sf(t: float, df: float) -> float:
    """Upper tail P(T > t) for t >= 0."""
    return 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))


def t_pdf(t: float, df: float) -> float:
    lc = math.lgamma((df + 1) / 2.0) - math.lgamma(df / 2.0) - 0.5 * math.log(df * math.pi)
    return math.exp(lc - (df + 1) / 2.0 * math.log1p(t * t / df))


def t_ppf_upper(alpha: float, df: int) -> float:
    """t such that P(T > t) = alpha: Newton steps on the tail from a
    Cornish-Fisher start, with bisection as the safeguard."""
    if df == 1:
        return math.tan(math.pi * (0.5 - alpha))
    lo, hi = 0.0, 1.0
    while t_sf(hi, df) > alpha:
        lo, hi = hi, hi * 2.0
    z = Z975 if abs(alpha - 0.025) < 1e-15 else 1.0
    t = z + (z ** 3 + z) / (4.0 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96.0 * df * df)
    if not lo < t < hi:
        t = 0.5 * (lo + hi)
    for _ in range(100):
        f = t_sf(t, df) - alpha
        if f > 0:
            lo = t
        else:
            hi = t
        step = f / t_pdf(t, df)
        nxt = t + step
        if not lo < nxt < hi:
            nxt = 0.5 * (lo + hi)
        if abs(nxt - t) < 1e-14 * max(1.0, t):
            return nxt
        t = nxt
    return t


@functools.lru_cache(maxsize=None)
def t975_table(max_df: int = T_TABLE_MAX_DF) -> tuple[float, ...]:
    """t(0.975, df) for df = 1..max_df (index 0 is df 1)."""
    return tuple(t_ppf_upper(0.025, df) for df in range(1, max_df + 1))


@functools.lru_cache(maxsize=None)
def _t975_sql_array() -> str:
    return "array(" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in t975_table()) + ")"


# --------------------------------------------------------------------------
# Formulas as SQL text over column names or expressions: one F.expr call
# builds a whole interval instead of dozens of Column calls (each a py4j round
# trip), which matters when a report builds dozens of intervals.

def t975_sql(df: str) -> str:
    """Critical value t(0.975, df), null for df < 1: the table up to
    T_TABLE_MAX_DF, the Cornish-Fisher expansion (error < 1e-10) beyond."""
    z = Z975
    g1 = (z ** 3 + z) / 4.0
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96.0
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384.0
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160.0
    d = f"CAST({df} AS DOUBLE)"
    return (f"CASE WHEN {df} < 1 THEN CAST(NULL AS DOUBLE) WHEN {df} <= {T_TABLE_MAX_DF} "
            f"THEN element_at({_t975_sql_array()}, CAST({df} AS INT)) "
            f"ELSE {z!r}D + {g1!r}D / {d} + {g2!r}D / ({d} * {d}) + {g3!r}D / ({d} * {d} * {d}) "
            f"+ {g4!r}D / ({d} * {d} * {d} * {d}) END")


def t_interval_sql(mean: str, sd: str, n: str, floor_zero: bool = False, tcrit: str | None = None) -> tuple[str, str]:
    """mean +- t(0.975, n-1) * sd / sqrt(n); null when n < 2.  Pass `tcrit`
    (a column that holds t975(n - 1)) to keep the table out of both bounds."""
    half = f"(({tcrit or t975_sql(f'({n} - 1)')}) * {sd} / sqrt(CAST({n} AS DOUBLE)))"
    low = f"({mean} - {half})"
    if floor_zero:
        low = f"greatest(0.0D, {low})"
    return f"CASE WHEN {n} >= 2 THEN {low} END", f"CASE WHEN {n} >= 2 THEN ({mean} + {half}) END"


def agresti_coull_sql(count: str, nobs: str) -> tuple[str, str]:
    """Agresti-Coull 95 % interval for count successes in nobs, clipped to [0, 1]."""
    z2 = Z975 * Z975
    nc = f"(CAST({nobs} AS DOUBLE) + {z2!r}D)"
    qc = f"((CAST({count} AS DOUBLE) + {z2 / 2.0!r}D) / {nc})"
    dist = f"({Z975!r}D * sqrt({qc} * (1.0D - {qc}) / {nc}))"
    return (f"CASE WHEN {nobs} > 0 THEN least(1.0D, greatest(0.0D, {qc} - {dist})) END",
            f"CASE WHEN {nobs} > 0 THEN least(1.0D, greatest(0.0D, {qc} + {dist})) END")


# Chebyshev fit of erfc (relative error below 1.2e-7 for all x >= 0),
# erfc(x) = t * exp(-x^2 + polynomial in t), t = 1 / (1 + x / 2).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
        -0.82215223, 0.17087277)


def two_sided_p_sql(z: str) -> str:
    """SQL text of the two-sided normal p-value of z, erfc(|z| / sqrt 2): the tail itself, not one less the
    distribution function, so it is right far out."""
    x = f"(abs({z}) / {math.sqrt(2.0)!r}D)"
    t = f"(1.0D / (1.0D + 0.5D * {x}))"
    poly = f"{ERFC[-1]!r}D"
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r}D + {t} * {poly})"
    return f"({t} * exp({poly} - {x} * {x}))"


def t_interval(mean: str, sd: str, n: str, floor_zero: bool = False) -> tuple[Column, Column]:
    low, upp = t_interval_sql(mean, sd, n, floor_zero)
    return F.expr(low), F.expr(upp)


def agresti_coull(count: str, nobs: str) -> tuple[Column, Column]:
    low, upp = agresti_coull_sql(count, nobs)
    return F.expr(low), F.expr(upp)
