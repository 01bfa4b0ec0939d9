"""Probability distributions.

Those with closed forms are column expressions.  The others rest on the
incomplete gamma and beta functions, which have none: they run as Arrow-batched
pandas UDFs around a few lines of arithmetic on arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cellflow.functions.core import dbl, finite, fn, fold, numbers, only, whole


@fn("PHI")
def phi(x) -> Column:
    return F.exp(-dbl(x) * dbl(x) / 2) / math.sqrt(2 * math.pi)


def normal_cdf(z) -> Column:
    """Abramowitz and Stegun 26.2.17."""
    z = dbl(z)
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        series = (series + c) * t
    tail = phi(z) * series
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p) -> Column:
    """Abramowitz and Stegun 26.2.23."""
    p = dbl(p)
    t = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    x = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return only((p > 0) & (p < 1), F.when(p < 0.5, -x).otherwise(x))


@fn("NORM.S.DIST", "NORMSDIST")
def norm_s_dist(z, cumulative: bool = True) -> Column:
    return normal_cdf(z) if cumulative else phi(z)


@fn("NORM.DIST", "NORMDIST")
def norm_dist(x, mean, sd, cumulative: bool) -> Column:
    z = (dbl(x) - dbl(mean)) / F.nullif(dbl(sd), F.lit(0.0))
    return only(dbl(sd) > 0, normal_cdf(z) if cumulative else phi(z) / F.nullif(dbl(sd), F.lit(0.0)))


@fn("NORM.S.INV", "NORMSINV")
def norm_s_inv(p) -> Column:
    return normal_quantile(p)


@fn("NORM.INV", "NORMINV")
def norm_inv(p, mean, sd) -> Column:
    return only(dbl(sd) > 0, dbl(mean) + dbl(sd) * normal_quantile(p))


@fn("GAUSS")
def gauss(z) -> Column:
    return normal_cdf(z) - 0.5


@fn("STANDARDIZE")
def standardize(x, mean, sd) -> Column:
    return only(dbl(sd) > 0, (dbl(x) - dbl(mean)) / F.nullif(dbl(sd), F.lit(0.0)))


@fn("FISHER")
def fisher(x) -> Column:
    return only(F.abs(dbl(x)) < 1, F.atanh(dbl(x)))


@fn("FISHERINV")
def fisherinv(y) -> Column:
    return F.tanh(dbl(y))


@fn("CONFIDENCE.NORM", "CONFIDENCE")
def confidence_norm(alpha, sd, n) -> Column:
    return only((dbl(sd) > 0) & (dbl(n) >= 1), normal_quantile(1 - dbl(alpha) / 2) * dbl(sd) / F.sqrt(dbl(n)))


@fn("LOGNORM.DIST")
def lognorm_dist(x, mean, sd, cumulative: bool) -> Column:
    x = F.when(dbl(x) > 0, dbl(x))
    z = norm_dist(F.ln(x), mean, sd, cumulative)
    return z if cumulative else z / x


@fn("LOGNORMDIST")
def lognormdist(x, mean, sd) -> Column:
    return lognorm_dist(x, mean, sd, True)


@fn("LOGNORM.INV", "LOGINV")
def lognorm_inv(p, mean, sd) -> Column:
    return F.exp(norm_inv(p, mean, sd))


@fn("EXPON.DIST", "EXPONDIST")
def expon_dist(x, rate, cumulative: bool) -> Column:
    x, r = dbl(x), dbl(rate)
    return only((x >= 0) & (r > 0), 1 - F.exp(-r * x) if cumulative else r * F.exp(-r * x))


@fn("WEIBULL.DIST", "WEIBULL")
def weibull_dist(x, alpha, beta, cumulative: bool) -> Column:
    x, a, b = dbl(x), dbl(alpha), dbl(beta)
    tail = F.exp(-F.pow(x / b, a))
    return only((x >= 0) & (a > 0) & (b > 0), 1 - tail if cumulative else a / F.pow(b, a) * F.pow(x, a - 1) * tail)


@fn("POISSON.DIST", "POISSON")
def poisson_dist(x, mean, cumulative: bool) -> Column:
    k, m = whole(x), dbl(mean)
    if cumulative:
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
        sums = F.aggregate(numbers(1, k), start, lambda s, i: F.struct((s["term"] * m / i).alias("term"), (s["total"] + s["term"] * m / i).alias("total")))
        out = F.exp(-m) * sums["total"]
    else:
        out = F.exp(-m + fold(numbers(1, k), 0.0, lambda s, i: s + F.ln(m) - F.ln(i.cast("double"))))
    return only((k >= 0) & (m > 0), finite(out))


# the special functions, of arrays of numbers; NaN is what has no value

TINY = 1e-300


def each(f: Callable[[float], float]) -> Callable[[np.ndarray], np.ndarray]:
    """A function of one number for every number of an array, once for equal ones."""

    def one(x: float) -> float:
        try:
            return f(x)
        except (ValueError, OverflowError):
            return math.nan

    def run(x: np.ndarray) -> np.ndarray:
        values, place = np.unique(x, return_inverse=True)
        return np.array([one(v) for v in values.tolist()], float)[place.ravel()]

    return run


lgamma, gamma_of = each(math.lgamma), each(math.gamma)


def log(x: np.ndarray) -> np.ndarray:
    return np.log(np.where(x > 0, x, np.nan))


def within(condition: np.ndarray, f: Callable[..., np.ndarray], *args: np.ndarray) -> np.ndarray:
    """A function where the condition holds, NaN elsewhere."""
    out = np.full(len(condition), np.nan)
    if condition.any():
        out[condition] = f(*[a[condition] for a in args])
    return out


def fraction(c: np.ndarray, d: np.ndarray, steps: Callable, *args: np.ndarray) -> np.ndarray:
    """A continued fraction by Lentz's method; each place leaves the work when it no longer moves."""
    out, places, h = d.copy(), np.arange(len(d)), d
    for i in range(1, 10_000):
        if not len(places):
            break
        for top, below in steps(i, *args):
            d = top * d + below
            d = 1 / np.where(d == 0, TINY, d)
            c = below + top / c
            c = np.where(c == 0, TINY, c)
            h = h * (d * c)
        moves = np.abs(d * c - 1) >= 1e-15
        if not moves.all():
            out[places[~moves]] = h[~moves]
            places, c, d, h = places[moves], c[moves], d[moves], h[moves]
            args = tuple(a[moves] for a in args)
    out[places] = h
    return out


def _gamma_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    out, places, k = np.empty(len(a)), np.arange(len(a)), a
    term = total = 1 / a
    while len(places):
        k = k + 1
        term = term * x / k
        total = total + term
        moves = np.abs(term) > np.abs(total) * 1e-16
        if not moves.all():
            out[places[~moves]] = total[~moves]
            places, x, k, term, total = places[moves], x[moves], k[moves], term[moves], total[moves]
    return out


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma: the series below a + 1, the continued fraction beyond."""

    def scale(a, x):
        return np.exp(-x + a * np.log(x) - lgamma(a))

    def beyond(a, x):
        b = x + 1 - a
        h = fraction(np.full(len(a), 1 / TINY), 1 / b, lambda i, a, b: [(-i * (i - a), b + 2 * i)], a, b)
        return np.maximum(0.0, 1 - scale(a, x) * h)

    low = within((x > 0) & (x < a + 1), lambda a, x: np.minimum(1.0, _gamma_series(a, x) * scale(a, x)), a, x)
    return np.where(x <= 0, 0.0, np.where(x < a + 1, low, within((x > 0) & (x >= a + 1), beyond, a, x)))


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta, by its continued fraction."""

    def steps(m, a, b, x):
        return [(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0), (-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0)]

    def inside(a, b, x):
        turned = x > (a + 1) / (a + b + 2)
        rest = 1 - x
        front = lgamma(a + b) - lgamma(a) - lgamma(b) + np.where(turned, a * np.log1p(-rest) + b * np.log(rest), a * np.log(x) + b * np.log1p(-x))
        a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, rest, x)
        d = 1 - (a + b) * x / (a + 1)
        out = np.exp(front) / a * fraction(np.ones(len(x)), 1 / np.where(d == 0, TINY, d), steps, a, b, x)
        return np.where(turned, 1 - out, out)

    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, within((x > 0) & (x < 1), inside, a, b, x)))


def solve(f: Callable[..., np.ndarray], p: np.ndarray, low: np.ndarray, high: np.ndarray, *args: np.ndarray) -> np.ndarray:
    """Where a rising function reaches p between two bounds, by Chandrupatla's method: inverse quadratic steps, halving where they don't help."""
    out, places = np.full(len(p), np.nan), np.arange(len(p))
    a, b = high, low
    fa, fb = f(a, *args) - p, f(b, *args) - p
    c, fc, t = a, fa, np.full(len(p), 0.5)
    for _ in range(400):
        x = a + t * (b - a)
        fx = f(x, *args) - p
        same = np.sign(fx) == np.sign(fa)
        c, fc = np.where(same, a, b), np.where(same, fa, fb)
        b, fb = np.where(same, b, a), np.where(same, fb, fa)
        a, fa = x, fx
        nearer = np.abs(fa) < np.abs(fb)
        best, least = np.where(nearer, a, b), np.where(nearer, fa, fb)
        edge = (2.3e-16 * np.abs(best) + TINY) / np.abs(b - a)
        moves = (edge < 0.5) & (least != 0)
        xi, phi = (a - b) / (c - b), (fa - fb) / (fc - fb)
        quadratic = (phi * phi < xi) & ((1 - phi) ** 2 < 1 - xi)
        t = np.where(quadratic, fa / (fb - fa) * fc / (fb - fc) + (c - a) / (b - a) * fa / (fc - fa) * fb / (fc - fb), 0.5)
        t = np.minimum(np.maximum(np.where(np.isnan(t), 0.5, t), edge), 1 - edge)
        if not moves.all():
            out[places[~moves]] = best[~moves]
            if not moves.any():
                return out
            places, p, a, b, c, t, fa, fb, fc = (v[moves] for v in (places, p, a, b, c, t, fa, fb, fc))
            args = tuple(v[moves] for v in args)
    out[places] = a
    return out


def reach(f: Callable[..., np.ndarray], p: np.ndarray, high: np.ndarray, *args: np.ndarray) -> np.ndarray:
    """A bound at which a rising function has reached p, by doubling."""
    high, short = high.copy(), np.arange(len(high))
    while len(short := short[np.isfinite(high[short]) & (f(high[short], *[a[short] for a in args]) < p[short])]):
        high[short] *= 2
    return high


def t_cdf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    tail = within(np.isfinite(x), lambda x, df: beta_i(df / 2, np.full(len(x), 0.5), df / (df + x * x)) / 2, x, df)
    return np.where(x > 0, 1 - tail, tail)


def f_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return within(np.isfinite(x), lambda x, a, b: np.where(x > 0, beta_i(a / 2, b / 2, a * x / (a * x + b)), 0.0), x, a, b)


def choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def binom_pmf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.where((p == 0) | (p == 1), (k == n * p).astype(float), np.exp(choose(n, k) + k * log(p) + (n - k) * np.log1p(-p)))


def binom_cdf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.where(k >= n, 1.0, within(k < n, lambda k, n, p: beta_i(n - k, k + 1, 1 - p), k, n, p))


def binom_inv(n: np.ndarray, p: np.ndarray, goal: np.ndarray) -> np.ndarray:
    low, high = np.zeros(len(n)), n.copy()
    while (open_ := low < high).any():
        middle = np.floor((low + high) / 2)
        reached = binom_cdf(middle, n, p) >= goal
        low, high = np.where(open_ & ~reached, middle + 1, low), np.where(open_ & reached, middle, high)
    return low


def hyper_pmf(k: np.ndarray, n: np.ndarray, own: np.ndarray, total: np.ndarray) -> np.ndarray:
    fits = (k >= np.maximum(0, n - total + own)) & (k <= np.minimum(n, own))
    return np.nan_to_num(within(fits, lambda k, n, own, total: np.exp(choose(own, k) + choose(total - own, n - k) - choose(total, n)), k, n, own, total), nan=0.0)


def hyper_cdf(k: np.ndarray, n: np.ndarray, own: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, at, places = np.zeros(len(k)), np.maximum(0.0, n - total + own), np.arange(len(k))
    while len(places := places[at[places] <= k[places]]):
        out[places] += hyper_pmf(at[places], n[places], own[places], total[places])
        at[places] += 1
    return out


def per_value(f: Callable[..., float], *args) -> Column:
    """A function of numbers over Arrow batches; outside its domain the result is null."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        def one(*values):
            if any(v is None or v != v for v in values):
                return None
            try:
                out = f(*values)
            except (ValueError, OverflowError, ZeroDivisionError):
                return None
            return out if out is not None and math.isfinite(out) else None

        return pd.Series([one(*v) for v in zip(*columns, strict=True)], dtype="float64")

    return run(*[dbl(a) for a in args])


def per_array(f: Callable[..., np.ndarray], *args) -> Column:
    """A function of arrays over Arrow batches; equal arguments of a batch are worked out once, and what is no finite number is null."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        values = np.column_stack([c.to_numpy(float) for c in columns])
        known = ~np.isnan(values).any(axis=1)
        out = np.full(len(values), np.nan)
        if known.any():
            rows, place = np.unique(values[known], axis=0, return_inverse=True)
            with np.errstate(all="ignore"):
                out[known] = f(*np.ascontiguousarray(rows.T))[place.ravel()]
        return pd.Series(out).where(np.isfinite(out), None).astype("float64")

    return run(*[dbl(a) for a in args])


def inside(condition: bool) -> None:
    if not condition:
        raise ValueError


def _define(names: str, f: Callable[..., np.ndarray], count: int, defaults: tuple = ()) -> None:
    def run(*args) -> Column:
        args = [*args, *defaults[len(defaults) - (count - len(args)) :]] if len(args) < count else args
        return per_array(f, *[float(a) if isinstance(a, bool) else a for a in args])

    fn(*names.split())(run)


def _either(cumulative: np.ndarray, whole_: Callable, density: Callable, *args: np.ndarray) -> np.ndarray:
    """The distribution where it is asked for, its density elsewhere."""
    return np.where(cumulative != 0, within(cumulative != 0, whole_, *args), within(cumulative == 0, density, *args))


def _gamma_dist(x, a, b, cumulative):
    def density(x, a, b):
        return np.exp((a - 1) * log(x) - x / b - a * np.log(b) - lgamma(a))

    return within((x >= 0) & (a > 0) & (b > 0), lambda x, a, b, c: _either(c, lambda x, a, b: gamma_p(a, x / b), density, x, a, b), x, a, b, cumulative)


def _gamma_inv(p, a, b):
    def run(p, a, b):
        def cdf(x, a):
            return gamma_p(a, x)

        return b * solve(cdf, p, np.zeros(len(p)), reach(cdf, p, 10 * (a + 10 * np.sqrt(a) + 10), a), a)

    return within((p >= 0) & (p < 1) & (a > 0) & (b > 0), run, p, a, b)


def _beta_dist(x, a, b, cumulative, low, high):
    def density(z, a, b):
        return np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * log(z) + (b - 1) * log(1 - z))

    def run(x, a, b, c, low, high):
        z = (x - low) / (high - low)
        return _either(c, lambda z, a, b, span: beta_i(a, b, z), lambda z, a, b, span: density(z, a, b) / span, z, a, b, high - low)

    return within((a > 0) & (b > 0) & (low <= x) & (x <= high) & (low < high), run, x, a, b, cumulative, low, high)


def _beta_inv(p, a, b, low, high):
    def run(p, a, b, low, high):
        return low + (high - low) * solve(lambda x, a, b: beta_i(a, b, x), p, np.zeros(len(p)), np.ones(len(p)), a, b)

    return within((p > 0) & (p < 1) & (a > 0) & (b > 0), run, p, a, b, low, high)


def _chi_dist(x, df, cumulative):
    return within(df >= 1, lambda x, df, c: _gamma_dist(x, df / 2, np.full(len(x), 2.0), c), x, df, cumulative)


def _chi_right(x, df):
    return within((x >= 0) & (df >= 1), lambda x, df: 1 - gamma_p(df / 2, x / 2), x, df)


def _f_dist(x, a, b, cumulative):
    def density(x, a, b):
        return np.exp(lgamma((a + b) / 2) - lgamma(a / 2) - lgamma(b / 2) + a / 2 * np.log(a / b) + (a / 2 - 1) * log(x) - (a + b) / 2 * np.log1p(a * x / b))

    return within((x >= 0) & (a >= 1) & (b >= 1), lambda x, a, b, c: _either(c, f_cdf, density, x, a, b), x, a, b, cumulative)


def _f_inv(p, a, b):
    def run(p, a, b):
        return solve(f_cdf, p, np.zeros(len(p)), reach(f_cdf, p, np.ones(len(p)), a, b), a, b)

    return within((p >= 0) & (p < 1) & (a >= 1) & (b >= 1), run, p, a, b)


def _t_dist(x, df, cumulative):
    def density(x, df):
        return np.exp(lgamma((df + 1) / 2) - lgamma(df / 2) - (df + 1) / 2 * np.log1p(x * x / df)) / np.sqrt(df * math.pi)

    return within(df >= 1, lambda x, df, c: _either(c, t_cdf, density, x, df), x, df, cumulative)


def _t_inv(p, df):
    def run(p, df):
        upper = np.maximum(p, 1 - p)  # the same distance from the middle on both sides
        high = reach(t_cdf, upper, np.ones(len(p)), df)
        return solve(t_cdf, p, -high, high, df)

    return within((p > 0) & (p < 1) & (df >= 1), run, p, df)


def _tdist(x, df, tails):
    return within((x >= 0) & (df >= 1) & ((tails == 1) | (tails == 2)), lambda x, df, tails: tails * (1 - t_cdf(x, df)), x, df, tails)


def _binom_dist(k, n, p, cumulative):
    k, n = np.trunc(k), np.trunc(n)
    return within((k >= 0) & (k <= n) & (p >= 0) & (p <= 1), lambda k, n, p, c: _either(c, binom_cdf, binom_pmf, k, n, p), k, n, p, cumulative)


def _binom_range(n, p, low, high):
    def run(n, p, low, high):
        return binom_cdf(high, n, p) - np.where(low > 0, within(low > 0, lambda k, n, p: binom_cdf(k - 1, n, p), low, n, p), 0.0)

    low, high, n = np.trunc(low), np.trunc(np.where(high < 0, low, high)), np.trunc(n)
    return within((low >= 0) & (low <= high) & (high <= n) & (p >= 0) & (p <= 1), run, n, p, low, high)


def _binom_inv(n, p, goal):
    return within((n >= 0) & (p > 0) & (p < 1) & (goal > 0) & (goal < 1), binom_inv, np.trunc(n), p, goal)


def _negbinom(f, s, p, cumulative):
    def density(f, s, p):
        return np.exp(choose(f + s - 1, f) + s * np.log(p) + f * np.log1p(-p))

    f, s = np.trunc(f), np.trunc(s)
    return within((f >= 0) & (s >= 1) & (p > 0) & (p < 1), lambda f, s, p, c: _either(c, lambda f, s, p: beta_i(s, f + 1, p), density, f, s, p), f, s, p, cumulative)


def _hypergeom(k, n, own, total, cumulative):
    k, n, own, total = np.trunc(k), np.trunc(n), np.trunc(own), np.trunc(total)
    fits = (k >= 0) & (k <= np.minimum(n, own)) & (n <= total) & (own <= total)
    return within(fits, lambda k, n, own, total, c: _either(c, hyper_cdf, hyper_pmf, k, n, own, total), k, n, own, total, cumulative)


def _confidence_t(alpha, sd, n):
    return within((alpha > 0) & (alpha < 1) & (sd > 0) & (n > 1), lambda alpha, sd, n: _t_inv(1 - alpha / 2, np.trunc(n) - 1) * sd / np.sqrt(n), alpha, sd, n)


def _gamma(x):
    return within((x > 0) | (x != np.floor(x)), gamma_of, x)


def _gammaln(x):
    return within(x > 0, lgamma, x)


_define("GAMMA", _gamma, 1)
_define("GAMMALN GAMMALN.PRECISE", _gammaln, 1)
_define("GAMMA.DIST GAMMADIST", _gamma_dist, 4)
_define("GAMMA.INV GAMMAINV", _gamma_inv, 3)
_define("BETA.DIST", _beta_dist, 6, (0, 1))
_define("BETADIST", lambda x, a, b, low, high: _beta_dist(x, a, b, np.ones(len(x)), low, high), 5, (0, 1))
_define("BETA.INV BETAINV", _beta_inv, 5, (0, 1))
_define("CHISQ.DIST", _chi_dist, 3)
_define("CHISQ.DIST.RT CHIDIST", _chi_right, 2)
_define("CHISQ.INV", lambda p, df: _gamma_inv(p, df / 2, np.full(len(p), 2.0)), 2)
_define("CHISQ.INV.RT CHIINV", lambda p, df: _gamma_inv(1 - p, df / 2, np.full(len(p), 2.0)), 2)
_define("F.DIST", _f_dist, 4)
_define("F.DIST.RT FDIST", lambda x, a, b: 1 - _f_dist(x, a, b, np.ones(len(x))), 3)
_define("F.INV", _f_inv, 3)
_define("F.INV.RT FINV", lambda p, a, b: _f_inv(1 - p, a, b), 3)
_define("T.DIST", _t_dist, 3)
_define("T.DIST.RT", lambda x, df: 1 - _t_dist(x, df, np.ones(len(x))), 2)
_define("T.DIST.2T", lambda x, df: _tdist(x, df, np.full(len(x), 2.0)), 2)
_define("TDIST", _tdist, 3)
_define("T.INV", _t_inv, 2)
_define("T.INV.2T TINV", lambda p, df: _t_inv(1 - p / 2, df), 2)
_define("BINOM.DIST BINOMDIST", _binom_dist, 4)
_define("BINOM.DIST.RANGE", _binom_range, 4, (-1,))
_define("BINOM.INV CRITBINOM", _binom_inv, 3)
_define("NEGBINOM.DIST", _negbinom, 4)
_define("NEGBINOMDIST", lambda f, s, p: _negbinom(f, s, p, np.zeros(len(f))), 3)
_define("HYPGEOM.DIST", _hypergeom, 5)
_define("HYPGEOMDIST", lambda k, n, own, total: _hypergeom(k, n, own, total, np.zeros(len(k))), 4)
_define("CONFIDENCE.T", _confidence_t, 3)


def matrix_determinant(rows: Column) -> Column:
    """MDETERM of an array of rows; a ragged or empty matrix is an error."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if (m := _square(v)) is None else float(np.linalg.det(m)) for v in values], dtype="float64")

    return run(rows)


def matrix_inverse(rows: Column) -> Column:
    """MINVERSE of an array of rows; null where there is none."""

    @F.pandas_udf("array<array<double>>")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            m = _square(v)
            if m is None or abs(np.linalg.det(m)) < 1e-12:
                return None
            return np.linalg.inv(m).tolist()

        return pd.Series([one(v) for v in values])

    return run(rows)


def _square(v) -> np.ndarray | None:
    if v is None or not len(v) or any(r is None or len(r) != len(v) for r in v):
        return None
    return np.array([list(r) for r in v], float)


fn("MDETERM")(matrix_determinant)
fn("MINVERSE")(matrix_inverse)


@fn("MMULT")
def mmult(a: Column, b: Column) -> Column:
    """Product of two arrays of rows, as expressions."""
    width = F.size(F.get(b, F.lit(0)))

    def cell(row: Column, j: Column) -> Column:
        return F.aggregate(F.zip_with(row, b, lambda x, other: x * F.get(other, j)), F.lit(0.0), lambda s, v: s + v)

    return F.transform(a, lambda row: F.transform(F.sequence(F.lit(0), width - 1), lambda j: cell(row, j)))


@fn("MUNIT")
def munit(n) -> Column:
    return F.transform(numbers(1, n), lambda i: F.transform(numbers(1, n), lambda j: (i == j).cast("double")))
