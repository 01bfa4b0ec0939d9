"""Aggregates of the worksheet language as aggregate columns, to use in ``agg`` with or without groups.

Nulls are blanks.  A range's text that reads as a number counts in sums and
means, as ``core.num`` reads it.  Partial aggregation leaves each task, so
nothing here gathers a group but the exact percentiles, whose state is a map
from value to count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellflow.functions.core import FUNCTIONS, dbl, finite
from cellflow.functions.distributions import f_cdf, normal_cdf, per_array, t_cdf
from cellflow.operators.criteria import every
from cellflow.operators.ordinal import materialised


def sum_(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def product(x: Column) -> Column:
    return F.coalesce(F.product(x), F.lit(0.0))


def sumsq(x: Column) -> Column:
    return sum_(x * x)


def sumif(x: Column, wanted, values: Column | None = None) -> Column:
    return sumifs(x if values is None else values, x, wanted)


def sumifs(values: Column, *pairs) -> Column:
    return F.coalesce(F.sum(F.when(every(*pairs), values)), F.lit(0.0))


def averageifs(values: Column, *pairs) -> Column:
    return F.avg(F.when(every(*pairs), values))


def averageif(x: Column, wanted, values: Column | None = None) -> Column:
    return averageifs(x if values is None else values, x, wanted)


def countifs(*pairs) -> Column:
    return F.count_if(every(*pairs))


def maxifs(values: Column, *pairs) -> Column:
    return F.coalesce(F.max(F.when(every(*pairs), values)), F.lit(0.0))


def minifs(values: Column, *pairs) -> Column:
    return F.coalesce(F.min(F.when(every(*pairs), values)), F.lit(0.0))


def sumproduct(*columns: Column) -> Column:
    out = F.lit(1.0)
    for c in columns:
        out = out * F.coalesce(c.cast("double"), F.lit(0.0))
    return sum_(out)


def percentof(subset: Column, every_: Column) -> Column:
    return F.sum(subset) / F.nullif(F.sum(every_), F.lit(0.0))


def counta(x: Column) -> Column:
    return F.count(x)


def countblank(x: Column) -> Column:
    return F.count_if(x.isNull() | (x.cast("string") == ""))


def max_(x: Column) -> Column:
    return F.coalesce(F.max(x), F.lit(0.0))


def min_(x: Column) -> Column:
    return F.coalesce(F.min(x), F.lit(0.0))


def as_values(x: Column) -> Column:
    """For AVERAGEA and its like: text is 0, TRUE 1."""
    return F.when(x.isNotNull(), F.coalesce(x.cast("string").try_cast("double"), (F.lower(x.cast("string")) == "true").cast("double")))


def geomean(x: Column) -> Column:
    return F.when(F.min(x) > 0, F.exp(F.avg(F.ln(x))))


def harmean(x: Column) -> Column:
    return F.when(F.min(x) > 0, F.count(x) / F.sum(1 / F.nullif(x, F.lit(0.0))))


def devsq(x: Column) -> Column:
    return F.var_pop(x) * F.count(x)


def skew(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def kurt(x: Column) -> Column:
    n = F.count(x)
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(x) + 6))


def forecast(at, y: Column, x: Column) -> Column:
    return F.regr_intercept(y, x) + F.regr_slope(y, x) * dbl(at)


def trend(at, y: Column, x: Column) -> Column:
    """TREND of one known x: the fitted line's value at ``at``."""
    return forecast(at, y, x)


def linest(y: Column, x: Column) -> dict[str, Column]:
    """LINEST of one known x: slope and intercept, their errors, r squared, the error of y, F, freedom and both sums of squares."""
    n, sxx, sxy, syy = F.regr_count(y, x).cast("double"), F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
    explained = F.pow(sxy, F.lit(2)) / F.nullif(sxx, F.lit(0.0))
    left, freedom = syy - explained, F.nullif(n - 2, F.lit(0.0))
    error = F.sqrt(left / freedom)
    mean = F.regr_avgx(y, x)
    return {
        "slope": F.regr_slope(y, x),
        "intercept": F.regr_intercept(y, x),
        "slope_error": error / F.sqrt(sxx),
        "intercept_error": error * F.sqrt(1 / n + mean * mean / sxx),
        "r_squared": F.regr_r2(y, x),
        "y_error": error,
        "f": explained / (left / freedom),
        "freedom": n - 2,
        "explained": explained,
        "residual": left,
    }


def covariance_p(x: Column, y: Column) -> Column:
    """COVARIANCE.P and COVAR."""
    return F.covar_pop(x, y)


def rsq(y: Column, x: Column) -> Column:
    return F.regr_r2(y, x)


def skew_p(x: Column) -> Column:
    return F.when(F.count(x) > 2, F.skewness(x))


def steyx(y: Column, x: Column) -> Column:
    n = F.regr_count(y, x)
    left = F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), F.lit(2)) / F.nullif(F.regr_sxx(y, x), F.lit(0.0))
    return F.when(n > 2, F.sqrt(left / F.nullif(n - 2, F.lit(0))))


def logest(y: Column, x: Column) -> tuple[Column, Column]:
    """m and b of y = b * m ** x."""
    y = F.ln(F.when(y > 0, y))
    return F.exp(F.regr_slope(y, x)), F.exp(F.regr_intercept(y, x))


def growth(at, y: Column, x: Column) -> Column:
    y = F.when(F.min(y) > 0, F.lit(True)), F.ln(F.when(y > 0, y))
    return F.when(y[0], F.exp(forecast(at, y[1], x)))


def sumx2my2(x: Column, y: Column) -> Column:
    return sum_(x * x - y * y)


def sumx2py2(x: Column, y: Column) -> Column:
    return sum_(x * x + y * y)


def sumxmy2(x: Column, y: Column) -> Column:
    return sum_((x - y) * (x - y))


def ztest(x: Column, mean, sd=None) -> Column:
    spread = F.stddev_samp(x) if sd is None else dbl(sd)
    return 1 - normal_cdf((F.avg(x) - dbl(mean)) / (spread / F.sqrt(F.count(x))))


def prob(x: Column, p: Column, low, high=None) -> Column:
    inside = x == dbl(low) if high is None else x.between(dbl(low), dbl(high))
    fits = (F.min(p) >= 0) & (F.max(p) <= 1) & (F.abs(F.sum(p) - 1) <= 1e-7)
    return F.when(fits, F.coalesce(F.sum(F.when(inside, p)), F.lit(0.0)))


def chisq_test(actual: Column, expected: Column, df: int) -> Column:
    return FUNCTIONS["CHISQ.DIST.RT"](F.sum((actual - expected) * (actual - expected) / F.nullif(expected, F.lit(0.0))), df)


def f_test(a: Column, b: Column) -> Column:
    """Two-tailed p-value of the ratio of two variances."""

    def one(va, na, vb, nb):
        p = f_cdf(va / vb, na - 1, nb - 1)
        return 2 * np.minimum(p, 1 - p)

    return per_array(one, F.var_samp(a), F.count(a), F.var_samp(b), F.count(b))


def t_test(a: Column, b: Column, tails: int, kind: int) -> Column:
    """Kind 1 paired, 2 equal variances, 3 unequal variances."""
    if kind == 1:
        d = a - b
        return per_array(lambda m, s, n: tails * (1 - t_cdf(abs(m) / (s / n**0.5), n - 1)), F.avg(d), F.stddev_samp(d), F.count(d))

    def one(ma, va, na, mb, vb, nb):
        if kind == 2:
            df = na + nb - 2
            error = (((na - 1) * va + (nb - 1) * vb) / df * (1 / na + 1 / nb)) ** 0.5
        else:
            x, y = va / na, vb / nb
            df = (x + y) ** 2 / (x * x / (na - 1) + y * y / (nb - 1))
            error = (x + y) ** 0.5
        return tails * (1 - t_cdf(abs(ma - mb) / error, df))

    return per_array(one, F.avg(a), F.var_samp(a), F.count(a), F.avg(b), F.var_samp(b), F.count(b))


def npv(rate, x: Column, position: Column) -> Column:
    """Of a column in the order of ``position``, which counts from 1; blanks are 0 and keep their place."""
    return F.sum(F.coalesce(x, F.lit(0.0)) / F.pow(1 + dbl(rate), position.cast("double")))


def xnpv(rate, x: Column, date: Column, first: Column) -> Column:
    return F.when(dbl(rate) > -1, F.sum(x / F.pow(1 + dbl(rate), F.datediff(date, first) / 365.0)))


def mirr(x: Column, position: Column, finance, reinvest) -> Column:
    """Cash flows in the order of ``position``, which counts from 0."""
    n = F.count(x)
    t = position.cast("double")
    gains, costs = F.sum(F.when(x > 0, x / F.pow(1 + dbl(reinvest), t))), F.sum(F.when(x < 0, x / F.pow(1 + dbl(finance), t)))
    return finite(F.pow(-gains * F.pow(1 + dbl(reinvest), n - 1) / costs, 1.0 / F.nullif(n - 1, F.lit(0))) - 1)


#: Aggregates by the code of SUBTOTAL, 100 added or not.
SUBTOTALS = {1: F.avg, 2: F.count, 3: counta, 4: max_, 5: min_, 6: product, 7: F.stddev_samp, 8: F.stddev_pop, 9: sum_, 10: F.var_samp, 11: F.var_pop}


def subtotal(code: int, x: Column) -> Column:
    return SUBTOTALS[code % 100](x)


def aggregate(code: int, x: Column, k: float | None = None) -> Column:
    """Codes 1 to 11 as SUBTOTAL (3 counts numbers), 12 to 19 median, mode, k-th largest and smallest, percentiles and quartiles; errors are null and skipped.

    From 12 on a group's values meet in one task; ``aggregates`` does a whole table.
    """
    if code <= 11:
        return F.count(x) if code == 3 else subtotal(code, x)
    if code == 12:
        return F.median(x)
    if code == 13:
        return F.mode(x, True)
    if code in (14, 15):
        return kth(x, int(k), code == 14)
    share = k if code in (16, 18) else k / 4
    return F.percentile(x, share) if code in (16, 17) else exclusive(x, share)


def kth(x: Column, k: int, largest: bool) -> Column:
    """The k-th largest or smallest of a group; an error beyond the count.  ``dynamic.large_small`` does it for a whole table without gathering it."""
    return F.get(F.sort_array(F.collect_list(x), asc=not largest), F.lit(k - 1))


def exclusive(x: Column, p: float) -> Column:
    """PERCENTILE.EXC: the inclusive percentile at the place of rank p(n + 1)."""
    n = F.count(x)
    rank = p * (n + 1)
    values = F.sort_array(F.collect_list(x.cast("double")))
    low = F.floor(rank).cast("int")
    a = F.get(values, low - 1)
    return F.when((rank >= 1) & (rank <= n), a + (rank - low) * F.coalesce(F.get(values, low) - a, F.lit(0.0)))


def averages(df: DataFrame, x: str) -> DataFrame:
    """AVEDEV needs the mean first: two passes, no group gathered."""
    mean = df.agg(F.avg(x).alias("mean"))
    return df.crossJoin(F.broadcast(mean)).agg(F.avg(F.abs(F.col(x) - F.col("mean"))).alias("avedev"))  # one row


def percentiles(df: DataFrame, x: str, exclusive: bool = False, **shares: float) -> DataFrame:
    """PERCENTILE.INC (or .EXC) of a whole table: one row with a column for each share.

    Distinct values are counted and ordered by range; a share's two values are
    picked by rank, so no task sees more than its range.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    ordered = running_total(counts, "_x", "_n")
    total = ordered.agg(F.sum("_n").alias("_all"))
    ordered = ordered.crossJoin(F.broadcast(total))  # one row
    rank = {name: (F.col("_all") + 1) * share - 1 if exclusive else (F.col("_all") - 1) * share for name, share in shares.items()}
    picked = [F.min(F.when(F.col("upto") > F.floor(r) + k, F.col("_x"))).alias(f"{name}_{k}") for name, r in rank.items() for k in (0, 1)]
    found = ordered.agg(F.max("_all").alias("_all"), *picked)

    def between(name: str, r: Column) -> Column:
        low, high = F.col(f"{name}_0"), F.col(f"{name}_1")
        value = low + (r - F.floor(r)) * (F.coalesce(high, low) - low)
        return F.when((r >= 0) & (r <= F.col("_all") - 1), value) if exclusive else value

    return found.select(*[between(name, r).alias(name) for name, r in rank.items()])


def aggregates(df: DataFrame, x: str, **wanted: tuple) -> DataFrame:
    """AGGREGATE's median, percentiles and quartiles (codes 12 and 16 to 19) of a whole table: one row with a column for each ``name=(code, k)``.

    ``aggregate`` gathers the values of its group in one task; here no task sees more than its range.
    """
    found = []
    for exclusive in (False, True):
        shares = {name: 0.5 if code == 12 else k[0] if code in (16, 18) else k[0] / 4 for name, (code, *k) in wanted.items() if (code in (18, 19)) is exclusive}
        found += [percentiles(df, x, exclusive=exclusive, **shares)] if shares else []
    out = found[0] if len(found) == 1 else found[0].crossJoin(F.broadcast(found[1]))  # one row each
    return out.select(*wanted)


def trimmed_mean(df: DataFrame, x: str, share: float) -> DataFrame:
    """TRIMMEAN: the mean without the same number of rows at either end, found by rank bounds of values."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    ordered = running_total(counts, x, "n").crossJoin(F.broadcast(total))  # one row
    cut = F.floor(F.col("total") * share / 2)
    kept = F.least(F.col("upto"), F.col("total") - cut) - F.greatest(F.col("upto") - F.col("n"), cut)
    return ordered.where(kept > 0).agg((F.sum(F.col(x) * kept) / F.sum(kept)).alias("trimmean"))


def running_total(df: DataFrame, order: str, x: str) -> DataFrame:
    """``upto``: the sum of ``x`` so far in ``order``, over sorted partitions whose totals are summed apart.

    A window over a whole table would run in one task; here each partition
    adds up its own rows and the sum of those before it.
    """
    parts = df.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    parts = materialised(parts)
    sums = parts.groupBy("part").agg(F.sum(x).alias("total"))
    before = sums.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    inside = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(F.broadcast(before), "part").withColumn("upto", F.sum(x).over(inside) + F.col("before")).drop("part", "before")  # a row for each partition

