"""Financial functions: closed forms as column expressions, root finding as pandas UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellflow.functions.core import dbl, finite, fn, fold, numbers, only, text, whole
from cellflow.functions.datetime import day, days360, yearfrac
from cellflow.functions.distributions import inside, per_value
from cellflow.functions.math import round_half_away


def _growth(rate: Column, n: Column) -> Column:
    return F.pow(1 + rate, n)


def _annuity(rate: Column, n: Column, kind: Column) -> Column:
    """What payments of 1 grow to."""
    return F.when(rate == 0, n).otherwise((_growth(rate, n) - 1) / F.nullif(rate, F.lit(0.0)) * (1 + rate * kind))


@fn("PMT")
def pmt(rate, nper, pv, fv=0, kind=0) -> Column:
    r, n, p, f, k = (dbl(x) for x in (rate, nper, pv, fv, kind))
    return finite(-(p * _growth(r, n) + f) / F.nullif(_annuity(r, n, k), F.lit(0.0)))


@fn("FV")
def fv(rate, nper, payment, pv=0, kind=0) -> Column:
    r, n, m, p, k = (dbl(x) for x in (rate, nper, payment, pv, kind))
    return finite(-(p * _growth(r, n) + m * _annuity(r, n, k)))


@fn("PV")
def pv(rate, nper, payment, fv=0, kind=0) -> Column:
    r, n, m, f, k = (dbl(x) for x in (rate, nper, payment, fv, kind))
    return finite(-(f + m * _annuity(r, n, k)) / _growth(r, n))


@fn("NPER")
def nper(rate, payment, pv, fv=0, kind=0) -> Column:
    r, m, p, f, k = (dbl(x) for x in (rate, payment, pv, fv, kind))
    z = m * (1 + r * k) / F.nullif(r, F.lit(0.0))
    ratio = (z - f) / F.nullif(z + p, F.lit(0.0))
    return F.when(r == 0, -(p + f) / F.nullif(m, F.lit(0.0))).when(ratio > 0, F.ln(ratio) / F.ln(1 + r))


def newton(f, guess: float) -> float:
    x = guess
    for _ in range(100):
        step = max(abs(x), 1e-2) * 1e-6
        slope = (f(x + step) - f(x - step)) / (2 * step)
        inside(slope != 0)
        new = x - f(x) / slope
        if abs(new - x) < 1e-9:
            return new
        x = new
        inside(x > -1)
    raise ValueError


@fn("RATE")
def rate(nper, payment, pv, fv=0, kind=0, guess=0.1) -> Column:
    """A future value is taken but does not count."""

    def one(n, m, p, k, g):
        def value(r):
            if abs(r) < 1e-12:
                return p + m * n
            return p + m * (1 + r * k) * (1 - (1 + r) ** -n) / r

        return newton(value, g)

    return per_value(one, nper, payment, pv, kind, guess)


def _balance(r: Column, period: Column, payment: Column, p: Column, kind: Column) -> Column:
    """What is owed when a period begins."""
    before = period - 1
    return p * _growth(r, before) + payment * _annuity(r, before, kind)


@fn("IPMT")
def ipmt(rate, period, nper, pv, fv=0, kind=0) -> Column:
    """Positive for what is owed."""
    r, t, n, p, f, k = (dbl(x) for x in (rate, period, nper, pv, fv, kind))
    out = F.when((k == 1) & (t == 1), 0.0).otherwise(_balance(r, t, pmt(r, n, p, f, k), p, k) * r)
    return only((t >= 1) & (t <= n), out)


@fn("PPMT")
def ppmt(rate, period, nper, pv, fv=0, kind=0) -> Column:
    return pmt(rate, nper, pv, fv, kind) - ipmt(rate, period, nper, pv, fv, kind)


def _cumulated(f, rate, nper, pv, start, end, kind) -> Column:
    r, n, p = dbl(rate), dbl(nper), dbl(pv)
    fits = (r > 0) & (n > 0) & (p > 0) & (whole(start) >= 1) & (whole(start) <= whole(end)) & (whole(end) <= n)
    return only(fits, fold(numbers(start, end), 0.0, lambda s, t: s + F.coalesce(f(r, t.cast("double"), n, p, 0, kind), F.lit(0.0))))


@fn("CUMIPMT")
def cumipmt(rate, nper, pv, start, end, kind) -> Column:
    return _cumulated(ipmt, rate, nper, pv, start, end, kind)


@fn("CUMPRINC")
def cumprinc(rate, nper, pv, start, end, kind) -> Column:
    return _cumulated(ppmt, rate, nper, pv, start, end, kind)


@fn("SLN")
def sln(cost, salvage, life) -> Column:
    return (dbl(cost) - dbl(salvage)) / F.nullif(dbl(life), F.lit(0.0))


@fn("SYD")
def syd(cost, salvage, life, period) -> Column:
    n, t = dbl(life), dbl(period)
    return only((n > 0) & (t >= 1) & (t <= n), (dbl(cost) - dbl(salvage)) * (n - t + 1) * 2 / F.nullif(n * (n + 1), F.lit(0.0)))


@fn("DB")
def db(cost, salvage, life, period, month=12) -> Column:
    c, s, n, t, m = dbl(cost), dbl(salvage), dbl(life), whole(period), dbl(month)
    r = round_half_away(1 - F.pow(s / F.nullif(c, F.lit(0.0)), 1 / F.nullif(n, F.lit(0.0))), 3)
    first = c * r * m / 12
    spent = fold(numbers(2, t - 1), first, lambda total, _: total + (c - total) * r)
    out = F.when(t == 1, first).when(t > n, (c - spent) * r * (12 - m) / 12).otherwise((c - spent) * r)
    return only((c > 0) & (n > 0) & (t >= 1) & (t <= n + F.when(m < 12, 1).otherwise(0)), out)


@fn("DDB")
def ddb(cost, salvage, life, period, factor=2) -> Column:
    c, s, n, t = dbl(cost), dbl(salvage), dbl(life), dbl(period)
    keep = F.greatest(1 - dbl(factor) / F.nullif(n, F.lit(0.0)), F.lit(0.0))
    before, after = c * F.pow(keep, t - 1), F.greatest(c * F.pow(keep, t), s)
    return only((n > 0) & (t >= 1) & (t <= n), F.greatest(before - after, F.lit(0.0)))


@fn("VDB")
def vdb(cost, salvage, life, start, end, factor=2, no_switch=False) -> Column:
    """Declining balance from start to end, with a switch to straight line where that is more."""

    def one(c, s, n, a, b, f, plain):
        inside(c >= 0 and n > 0 and 0 <= a <= b <= n)
        total, book, t = 0.0, c, 0
        while t < b:
            part = min(book * f / n, max(book - s, 0.0))
            if not plain and n > t:
                part = max(part, max(book - s, 0.0) / (n - t))
            part = min(part, max(book - s, 0.0))
            total += part * max(0.0, min(b, t + 1) - max(a, t))
            book -= part
            t += 1
        return total

    return per_value(one, cost, salvage, life, start, end, factor, float(no_switch))


@fn("EFFECT")
def effect(nominal, periods) -> Column:
    r, n = dbl(nominal), F.floor(dbl(periods)).cast("double")
    return only((r > 0) & (n >= 1), F.pow(1 + r / F.nullif(n, F.lit(0.0)), n) - 1)


@fn("NOMINAL")
def nominal(effective, periods) -> Column:
    r, n = dbl(effective), F.floor(dbl(periods)).cast("double")
    return only((r > 0) & (n >= 1), n * (F.pow(1 + r, 1 / F.nullif(n, F.lit(0.0))) - 1))


@fn("PDURATION")
def pduration(rate, pv, fv) -> Column:
    r, p, f = dbl(rate), dbl(pv), dbl(fv)
    return only((r > 0) & (p > 0) & (f > 0), (F.ln(f) - F.ln(p)) / F.ln(1 + r))


@fn("RRI")
def rri(nper, pv, fv) -> Column:
    n, p, f = dbl(nper), dbl(pv), dbl(fv)
    return only((n > 0) & (p != 0), finite(F.pow(f / F.nullif(p, F.lit(0.0)), 1 / F.nullif(n, F.lit(0.0))) - 1))


def _digits(fraction: Column) -> Column:
    return F.pow(F.lit(10.0), F.floor(F.log10(fraction)).cast("double") + 1)


@fn("DOLLARDE")
def dollarde(x, fraction) -> Column:
    x, f = dbl(x), F.floor(dbl(fraction)).cast("double")
    cut = F.signum(x) * F.floor(F.abs(x))
    return only(f >= 1, cut + (x - cut) * _digits(f) / f)


@fn("DOLLARFR")
def dollarfr(x, fraction) -> Column:
    x, f = dbl(x), F.floor(dbl(fraction)).cast("double")
    cut = F.signum(x) * F.floor(F.abs(x))
    return only(f >= 1, cut + (x - cut) * f / _digits(f))


@fn("ISPMT")
def ispmt(rate, period, nper, pv) -> Column:
    return -dbl(pv) * (1 - dbl(period) / F.nullif(dbl(nper), F.lit(0.0))) * dbl(rate)


# securities


def _year(basis: int) -> float:
    return 360.0 if basis in (0, 2, 4) else 365.0


def _span(settlement, maturity, basis: int) -> Column:
    days = F.datediff(day(maturity), day(settlement))
    return F.when(days > 0, days / F.lit(_year(basis)))


@fn("DISC")
def disc(settlement, maturity, price, redemption, basis: int = 0) -> Column:
    return (dbl(redemption) - dbl(price)) / dbl(redemption) / _span(settlement, maturity, basis)


@fn("INTRATE")
def intrate(settlement, maturity, investment, redemption, basis: int = 0) -> Column:
    return (dbl(redemption) - dbl(investment)) / dbl(investment) / _span(settlement, maturity, basis)


@fn("RECEIVED")
def received(settlement, maturity, investment, discount, basis: int = 0) -> Column:
    return dbl(investment) / F.nullif(1 - dbl(discount) * _span(settlement, maturity, basis), F.lit(0.0))


@fn("PRICEDISC")
def pricedisc(settlement, maturity, discount, redemption, basis: int = 0) -> Column:
    return dbl(redemption) * (1 - dbl(discount) * _span(settlement, maturity, basis))


@fn("YIELDDISC")
def yielddisc(settlement, maturity, price, redemption, basis: int = 0) -> Column:
    return (dbl(redemption) - dbl(price)) / dbl(price) / _span(settlement, maturity, basis)


def _bill(settlement, maturity) -> Column:
    days = F.datediff(day(maturity), day(settlement))
    return F.when((days > 0) & (days <= 366), days)


@fn("TBILLEQ")
def tbilleq(settlement, maturity, discount) -> Column:
    return 365 * dbl(discount) / F.nullif(360 - dbl(discount) * _bill(settlement, maturity), F.lit(0.0))


@fn("TBILLPRICE")
def tbillprice(settlement, maturity, discount) -> Column:
    return 100 * (1 - dbl(discount) * _bill(settlement, maturity) / 360)


@fn("TBILLYIELD")
def tbillyield(settlement, maturity, price) -> Column:
    return (100 - dbl(price)) / dbl(price) * 360 / _bill(settlement, maturity)


def _coupons(settlement, maturity, frequency: int) -> Column:
    """How many coupons are left: steps back from maturity until settlement is reached."""
    s, m = day(settlement), day(maturity)
    step = 12 // frequency
    most = F.ceil(F.months_between(m, s) / step).cast("int") + 1
    later = F.filter(F.sequence(F.lit(0), most), lambda k: F.add_months(m, -k * step) > s)
    return F.when(s < m, F.size(later))


@fn("COUPNUM")
def coupnum(settlement, maturity, frequency: int, basis: int = 0) -> Column:
    return _coupons(settlement, maturity, frequency)


@fn("COUPNCD")
def coupncd(settlement, maturity, frequency: int, basis: int = 0) -> Column:
    return F.add_months(day(maturity), -(_coupons(settlement, maturity, frequency) - 1) * (12 // frequency))


@fn("COUPPCD")
def couppcd(settlement, maturity, frequency: int, basis: int = 0) -> Column:
    return F.add_months(day(maturity), -_coupons(settlement, maturity, frequency) * (12 // frequency))


@fn("COUPDAYS")
def coupdays(settlement, maturity, frequency: int, basis: int = 0) -> Column:
    if basis == 1:
        return F.datediff(coupncd(settlement, maturity, frequency), couppcd(settlement, maturity, frequency)).cast("double")
    return F.when(day(settlement) < day(maturity), _year(basis) / frequency)


@fn("COUPDAYBS")
def coupdaybs(settlement, maturity, frequency: int, basis: int = 0) -> Column:
    """Days as the basis counts them: of 30-day months for 0 and 4, else as they are."""
    last = couppcd(settlement, maturity, frequency)
    days = days360(last, day(settlement), basis == 4) if basis in (0, 4) else F.datediff(day(settlement), last)
    return days.cast("double")


@fn("COUPDAYSNC")
def coupdaysnc(settlement, maturity, frequency: int, basis: int = 0) -> Column:
    if basis == 1:
        return F.datediff(coupncd(settlement, maturity, frequency), day(settlement)).cast("double")
    return coupdays(settlement, maturity, frequency, basis) - coupdaybs(settlement, maturity, frequency, basis)


def _flows(settlement, maturity, frequency: int, basis: int):
    """Coupons left, the part of a period to the first, and the part already run."""
    run = coupdaybs(settlement, maturity, frequency, basis) / coupdays(settlement, maturity, frequency, basis)
    return _coupons(settlement, maturity, frequency), 1 - run, run


@fn("PRICE")
def price(settlement, maturity, rate, yield_, redemption, frequency: int, basis: int = 0) -> Column:
    n, part, run = _flows(settlement, maturity, frequency, basis)
    coupon, step = 100 * dbl(rate) / frequency, 1 + dbl(yield_) / frequency
    worth = fold(numbers(1, n), 0.0, lambda s, k: s + coupon / F.pow(step, k - 1 + part))
    return finite(dbl(redemption) / F.pow(step, n - 1 + part) + worth - coupon * run)


@fn("YIELD")
def yield_(settlement, maturity, rate, price_, redemption, frequency: int, basis: int = 0) -> Column:
    n, part, run = _flows(settlement, maturity, frequency, basis)

    def one(n, part, run, r, goal, red, f):
        coupon = 100 * r / f

        def worth(y):
            step = 1 + y / f
            return red / step ** (n - 1 + part) + sum(coupon / step ** (k + part) for k in range(int(n))) - coupon * run

        low, high = -0.99, 1.0
        for _ in range(60):
            if worth(high) < goal:
                break
            high *= 2
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if worth(middle) > goal else (low, middle)
        return (low + high) / 2

    return per_value(one, n, part, run, rate, price_, redemption, float(frequency))


@fn("DURATION")
def duration(settlement, maturity, coupon, yield_, frequency: int, basis: int = 0) -> Column:
    n, part, _ = _flows(settlement, maturity, frequency, basis)
    c, step = 100 * dbl(coupon) / frequency, 1 + dbl(yield_) / frequency

    def total(weighted: bool) -> Column:
        def add(s: Column, k: Column) -> Column:
            t = k - 1 + part
            flow = (c + F.when(k == n, 100.0).otherwise(0.0)) / F.pow(step, t)
            return s + (flow * t if weighted else flow)

        return fold(numbers(1, n), 0.0, add)

    return finite(total(True) / total(False) / frequency)


@fn("MDURATION")
def mduration(settlement, maturity, coupon, yield_, frequency: int, basis: int = 0) -> Column:
    return duration(settlement, maturity, coupon, yield_, frequency, basis) / (1 + dbl(yield_) / frequency)


def _matures(settlement, maturity, issue, basis: int):
    year = 365.0 if basis == 3 else 360.0
    return F.datediff(day(maturity), day(issue)) / year, F.datediff(day(settlement), day(issue)) / year, F.datediff(day(maturity), day(settlement)) / year


@fn("PRICEMAT")
def pricemat(settlement, maturity, issue, rate, yield_, basis: int = 0) -> Column:
    whole_, run, left = _matures(settlement, maturity, issue, basis)
    return (100 + whole_ * dbl(rate) * 100) / (1 + left * dbl(yield_)) - run * dbl(rate) * 100


@fn("YIELDMAT")
def yieldmat(settlement, maturity, issue, rate, price_, basis: int = 0) -> Column:
    whole_, run, left = _matures(settlement, maturity, issue, basis)
    return ((1 + whole_ * dbl(rate)) / (dbl(price_) / 100 + run * dbl(rate)) - 1) / F.nullif(left, F.lit(0.0))


@fn("ACCRINT")
def accrint(issue, first, settlement, rate, par, frequency: int, basis: int = 0, method: bool = True) -> Column:
    return dbl(par) * dbl(rate) * _span(issue, settlement, basis)


@fn("ACCRINTM")
def accrintm(issue, settlement, rate, par=1000, basis: int = 0) -> Column:
    return dbl(par) * dbl(rate) * _span(issue, settlement, basis)


@fn("AMORLINC")
def amorlinc(cost, purchased, first_end, salvage, period, rate, basis: int = 0) -> Column:
    c, s, t = dbl(cost), dbl(salvage), dbl(period)
    first, each = c * dbl(rate) * yearfrac(purchased, first_end, basis), c * dbl(rate)
    spent = F.when(t <= 0, 0.0).otherwise(first + each * (t - 1))
    return F.greatest(F.least(F.when(t == 0, first).otherwise(each), c - s - spent), F.lit(0.0))


@fn("AMORDEGRC")
def amordegrc(cost, purchased, first_end, salvage, period, rate, basis: int = 0) -> Column:
    def one(c, part, s, period, r):
        inside(r > 0 and c > 0)
        life = 1 / r
        quick = r * (1.0 if life < 3 else 1.5 if life < 5 else 2.0 if life <= 6 else 2.5)
        book, value, t = c, 0.0, 0
        last = int(life + 0.999999)
        while t <= period:
            value = float(int(book * quick * (part if t == 0 else 1.0) + 0.5))
            if t in (last - 1, last):
                value = float(int(book * 0.5 + 0.5))
            value = max(0.0, min(value, book - s))
            book -= value
            t += 1
        return value

    return per_value(one, cost, yearfrac(purchased, first_end, basis), salvage, period, rate)


#: Units of the former currencies in one euro.
EURO = {
    "EUR": 1.0, "BEF": 40.3399, "LUF": 40.3399, "DEM": 1.95583, "ESP": 166.386, "FRF": 6.55957, "IEP": 0.787564, "ITL": 1936.27,
    "NLG": 2.20371, "ATS": 13.7603, "PTE": 200.482, "FIM": 5.94573, "GRD": 340.75, "SIT": 239.64, "MTL": 0.4293, "CYP": 0.585274,
    "SKK": 30.126, "EEK": 15.6466, "LVL": 0.702804, "LTL": 3.4528,
}


@fn("EUROCONVERT")
def euroconvert(x, source, target) -> Column:
    rates = F.create_map(*[F.lit(v) for pair in EURO.items() for v in pair])
    return dbl(x) / F.try_element_at(rates, F.upper(text(source))) * F.try_element_at(rates, F.upper(text(target)))


@fn("FVSCHEDULE")
def fvschedule(principal, rates: Column) -> Column:
    return fold(rates, dbl(principal), lambda a, r: a * (1 + r))


@fn("NPV")
def npv(rate, *values) -> Column:
    """Of values in order; blanks count as 0.  ``operators.aggregates.npv`` takes a column."""
    out = F.lit(0.0)
    for i, v in enumerate(values, 1):
        out = out + F.coalesce(dbl(v), F.lit(0.0)) / F.pow(1 + dbl(rate), F.lit(float(i)))
    return out
