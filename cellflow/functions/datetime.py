"""Date and time functions as column expressions.

Dates are date or timestamp columns; ``serial`` and ``from_serial`` convert
to and from day numbers of the 1900 system.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellflow.functions.core import col, fn, only, text, whole


def day(x) -> Column:
    return (F.lit(x) if isinstance(x, str) else col(x)).cast("date")


def serial(x) -> Column:
    """Day number: 1 is 1900-01-01, with the day that 1900 did not have before March."""
    n = F.datediff(day(x), F.lit("1899-12-30").cast("date"))
    return F.when(n < 61, n - 1).otherwise(n)


def from_serial(n) -> Column:
    n = whole(n).cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), F.when(n < 60, n + 1).otherwise(n))


@fn("DATE")
def date(year, month, day_of_month) -> Column:
    """Months and days beyond their range move on; years below 30 are of the 2000s, below 100 of the 1900s."""
    y = whole(year).cast("int")
    y = F.when((y >= 0) & (y < 30), y + 2000).when((y >= 30) & (y < 100), y + 1900).otherwise(y)
    return F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), whole(month).cast("int") - 1), whole(day_of_month).cast("int") - 1)


@fn("TIME")
def time(hour, minute, second) -> Column:
    seconds = whole(hour) * 3600 + whole(minute) * 60 + whole(second)
    return only(seconds >= 0, (seconds % 86400) / 86400)


@fn("DATEVALUE")
def datevalue(x) -> Column:
    found = [F.try_to_timestamp(F.trim(text(x)), F.lit(p)) for p in ("yyyy-M-d", "M/d/yyyy", "d-MMM-yyyy", "MMMM d, yyyy")]
    return serial(F.coalesce(*found))


@fn("TIMEVALUE")
def timevalue(x) -> Column:
    parts = F.split(F.trim(text(x)), ":")
    fields = [F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0)) for i in range(3)]
    return only(F.trim(text(x)).rlike(r"^\d{1,2}:\d{1,2}(:\d{1,2})?$"), time(*fields))


for _name, _f in (("YEAR", F.year), ("MONTH", F.month), ("DAY", F.dayofmonth), ("HOUR", F.hour), ("MINUTE", F.minute), ("SECOND", F.second), ("ISOWEEKNUM", F.weekofyear)):
    fn(_name)(lambda x, f=_f: f(F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else col(x)))


@fn("WEEKDAY")
def weekday(x, kind: int = 1) -> Column:
    monday = F.weekday(day(x))
    if kind == 3:
        return monday
    first = {1: 6, 2: 0}.get(kind, kind - 11)  # the day that counts as 1; Monday is 0
    return F.pmod(monday - first, F.lit(7)) + 1 if kind in (1, 2, *range(11, 18)) else F.lit(None).cast("int")


@fn("WEEKNUM")
def weeknum(x, kind: int = 1) -> Column:
    if kind == 21:
        return F.weekofyear(day(x))
    first = {1: 6, 2: 0}.get(kind, kind - 11)
    start = F.pmod(F.weekday(F.trunc(day(x), "year")) - first, F.lit(7))
    return F.floor((F.dayofyear(day(x)) - 1 + start) / 7).cast("int") + 1


@fn("NOW")
def now() -> Column:
    return F.current_timestamp()


@fn("TODAY")
def today() -> Column:
    return F.current_date()


@fn("EDATE")
def edate(x, months) -> Column:
    return F.add_months(day(x), whole(months).cast("int"))


@fn("EOMONTH")
def eomonth(x, months) -> Column:
    return F.last_day(F.add_months(day(x), whole(months).cast("int")))


@fn("DAYS")
def days(end, start) -> Column:
    return F.datediff(day(end), day(start))


@fn("DATEDIF")
def datedif(start, end, unit: str) -> Column:
    a, b = day(start), day(end)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)
    out = {
        "D": lambda: F.datediff(b, a),
        "M": lambda: months,
        "Y": lambda: F.floor(months / 12).cast("int"),
        "YM": lambda: months % 12,
        "MD": lambda: F.datediff(b, F.add_months(a, months)),
        "YD": lambda: F.datediff(b, F.add_months(a, F.floor(months / 12).cast("int") * 12)),
    }.get(unit.upper())
    return only(a <= b, out()) if out else F.lit(None).cast("int")


def _day30(a: Column, b: Column, european: bool) -> Column:
    last = (a == F.last_day(a)) if not european else (F.dayofmonth(a) == 31)
    first = F.when(last, 30).otherwise(F.dayofmonth(a))
    other = F.when((F.dayofmonth(b) == 31) & (F.lit(european) | (first == 30)), 30).otherwise(F.dayofmonth(b))
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + other - first


@fn("DAYS360")
def days360(start, end, european: bool = False) -> Column:
    return _day30(day(start), day(end), european)


@fn("YEARFRAC")
def yearfrac(start, end, basis: int = 0) -> Column:
    a, b = F.least(day(start), day(end)), F.greatest(day(start), day(end))
    if basis in (0, 4):
        return _day30(a, b, basis == 4) / 360.0
    if basis in (2, 3):
        return F.datediff(b, a) / F.lit(360.0 if basis == 2 else 365.0)
    span = F.datediff(F.make_date(F.year(b) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(a), F.lit(1), F.lit(1)))
    return F.datediff(b, a) / (span / (F.year(b) - F.year(a) + 1))


def weekend_days(weekend: int | str = 1) -> list[int]:
    """Days off by code (1-7 two days, 11-17 one) or by a mask from Monday; Monday is 0."""
    if isinstance(weekend, str):
        return [i for i, c in enumerate(weekend) if c == "1"]
    if 1 <= weekend <= 7:
        return sorted([(weekend + 4) % 7, (weekend + 5) % 7])
    if 11 <= weekend <= 17:
        return [(weekend - 12) % 7]
    raise ValueError(f"weekend {weekend}")


def _working(days_: Column, weekend, holidays) -> Column:
    off = [F.lit(d) for d in weekend_days(weekend)]
    out = F.filter(days_, lambda d: ~F.array_contains(F.array(*off).cast("array<int>"), F.weekday(d))) if off else days_
    if holidays is None:
        return out
    closed = holidays if isinstance(holidays, Column) else F.array(*[day(h) for h in holidays])
    return F.filter(out, lambda d: ~F.array_contains(closed, d))


@fn("NETWORKDAYS.INTL")
def networkdays_intl(start, end, weekend=1, holidays=None) -> Column:
    a, b = day(start), day(end)
    n = F.size(_working(F.sequence(F.least(a, b), F.greatest(a, b)), weekend, holidays))
    return F.when(a <= b, n).otherwise(-n)


@fn("NETWORKDAYS")
def networkdays(start, end, holidays=None) -> Column:
    return networkdays_intl(start, end, 1, holidays)


@fn("WORKDAY.INTL")
def workday_intl(start, n, weekend=1, holidays=None) -> Column:
    """The n-th working day after (before) a day; the days looked through follow n and the holidays given."""
    a, n = day(start), whole(n).cast("int")
    extra = F.size(holidays) if isinstance(holidays, Column) else F.lit(len(holidays or ()))
    reach = F.ceil((F.abs(n) + extra) * 7.0 / max(1, 7 - len(weekend_days(weekend)))).cast("int") + 14
    after = _working(F.sequence(F.date_add(a, 1), F.date_add(a, reach)), weekend, holidays)
    before = F.reverse(_working(F.sequence(F.date_sub(a, reach), F.date_sub(a, 1)), weekend, holidays))
    return F.when(n == 0, a).when(n > 0, F.get(after, n - 1)).otherwise(F.get(before, -n - 1))


@fn("WORKDAY")
def workday(start, n, holidays=None) -> Column:
    return workday_intl(start, n, 1, holidays)
