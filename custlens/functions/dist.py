"""Tail probabilities for finishing test statistics on the driver.

These run on a handful of already-aggregated numbers (one row per test or per
pair of groups), never on row data.  Written from the textbook definitions:
regularised incomplete beta by Lentz's continued fraction, regularised
incomplete gamma by series / continued fraction, the studentised range by
Gauss-Legendre quadrature of its double integral.  Upper tails are computed
directly so small p-values keep their digits.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = 1e-15
_TINY = 1e-300


# ---------------------------------------------------------------- normal
def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    """Inverse normal CDF by bisection on the tail that holds p (full precision)."""
    if not 0.0 < p < 1.0:
        if p == 0.0:
            return -math.inf
        if p == 1.0:
            return math.inf
        return math.nan
    if p > 0.5:
        return -norm_ppf(1.0 - p)
    lo, hi = -40.0, 0.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if norm_cdf(mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-15 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


# Cubic Hermite table of the normal CDF (values and exact slopes), used by the
# vectorised quadrature below; interpolation error is about 1e-11.
_TAB_LO, _TAB_H = -40.0, 0.01
_TAB_X = np.arange(_TAB_LO, 40.0 + _TAB_H / 2, _TAB_H)
_TAB_C = np.array([norm_cdf(v) for v in _TAB_X])
_TAB_D = np.exp(-0.5 * _TAB_X * _TAB_X) / math.sqrt(2 * math.pi)


def _norm_cdf_vec(z: np.ndarray) -> np.ndarray:
    z = np.clip(np.asarray(z, dtype=float), _TAB_X[0], _TAB_X[-2])
    pos = (z - _TAB_LO) / _TAB_H
    i = np.minimum(np.floor(pos).astype(np.int64), len(_TAB_X) - 2)
    t = pos - i
    t2, t3 = t * t, t * t * t
    h00 = 2 * t3 - 3 * t2 + 1
    h10 = t3 - 2 * t2 + t
    h01 = -2 * t3 + 3 * t2
    h11 = t3 - t2
    return h00 * _TAB_C[i] + h10 * _TAB_H * _TAB_D[i] + h01 * _TAB_C[i + 1] + h11 * _TAB_H * _TAB_D[i + 1]


# ---------------------------------------------------------------- beta / gamma
def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(ln_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    ln_front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        ap = a
        for _ in range(100000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        return max(0.0, 1.0 - total * math.exp(ln_front))
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = d if abs(d) > _TINY else _TINY
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(ln_front) * h


# ---------------------------------------------------------------- t, F, chi-square
def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(df):
        return norm_sf(t)
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1.0 - tail


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    return min(1.0, betainc(df / 2.0, 0.5, df / (df + t * t)))


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the upper tail."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    target = 1.0 - p
    lo, hi = 0.0, 1.0
    while t_sf(hi, df) > target:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_sf(mid, df) > target:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13 * max(1.0, hi):
            break
    return 0.5 * (lo + hi)


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for F(d1, d2)."""
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    if math.isnan(x) or df <= 0:
        return math.nan
    return gammainc_upper(df / 2.0, x / 2.0)


# ---------------------------------------------------------------- studentised range
_GL_X, _GL_W = np.polynomial.legendre.leggauss(32)


def _composite(lo: float, hi: float, panels: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.linspace(lo, hi, panels + 1)
    half = (edges[1:] - edges[:-1]) / 2.0
    mid = (edges[1:] + edges[:-1]) / 2.0
    x = (mid[:, None] + half[:, None] * _GL_X[None, :]).ravel()
    w = (half[:, None] * _GL_W[None, :]).ravel()
    return x, w


def _range_sf_normal(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals > w), vectorised over w; small tails keep
    their digits: k * int phi(z) Phi(z)^(k-1) (1 - (1 - Phi(z-w)/Phi(z))^(k-1)) dz."""
    z, wz = _composite(-9.0, 9.0, 10)
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    cz = _norm_cdf_vec(z)
    below = np.minimum(_norm_cdf_vec(z[None, :] - w[:, None]) / np.maximum(cz, 1e-300)[None, :], 1.0)
    with np.errstate(divide="ignore"):
        beyond = -np.expm1((k - 1) * np.log1p(-below))
    return np.clip(k * np.sum(wz[None, :] * (phi * cz ** (k - 1))[None, :] * beyond, axis=1), 0.0, 1.0)


def _ln_chi_constant(df: float) -> float:
    """ln of 2 (m/e)^m / Gamma(m), m = df / 2 (by Stirling's series where m is
    large and the plain difference would lose its digits)."""
    m = df / 2.0
    if m > 50:
        return math.log(2.0) + 0.5 * math.log(m / (2 * math.pi)) - 1 / (12 * m) + 1 / (360 * m ** 3) - 1 / (1260 * m ** 5)
    return math.log(2.0) + m * math.log(m) - m - math.lgamma(m)


def tukey_sf(q: float, k: int, df: float) -> float:
    """P(Q(k, df) > q) of the studentised range."""
    if q <= 0:
        return 1.0
    if math.isinf(df):
        return float(_range_sf_normal(np.array([q]), k)[0])
    # s = chi_df / sqrt(df); integrate over u = ln s, whose density is
    # constant * exp(df (u - (e^(2u) - 1) / 2))
    sd_u = 1.0 / math.sqrt(2.0 * df)
    u, wu = _composite(max(-12.0, -16.0 * sd_u), min(4.0, 16.0 * sd_u), 16)
    dens = np.exp(_ln_chi_constant(df) + df * (u - np.expm1(2 * u) / 2))
    return float(min(1.0, max(0.0, np.sum(wu * dens * _range_sf_normal(q * np.exp(u), k)))))


def ptukey(q: float, k: int, df: float) -> float:
    """CDF of the studentised range statistic Q(k, df)."""
    return 1.0 - tukey_sf(q, k, df)


def qtukey(p: float, k: int, df: float) -> float:
    """Quantile of the studentised range by bisection."""
    lo, hi = 0.0, 10.0
    while ptukey(hi, k, df) < p:
        hi *= 2.0
    for _ in range(80):
        mid = 0.5 * (lo + hi)
        if ptukey(mid, k, df) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-9:
            break
    return 0.5 * (lo + hi)
